"""Byte-level BPE ids of whole texts, with a public vocabulary file named by its path."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Runs of white space from which on a text is read by tokenizers: the pattern of the other reader steps back over a whole run, and gives up on one of a million.
LONG_RUN = re.compile(r"\s{20000}")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str):
    """text -> list of ids, as the tokenizers library gives them (special tokens in a text are ordinary text).

    A vocabulary that also lies beside the file as ranks is read by tiktoken, which gives the
    same ids about five times as fast; tests hold the two against each other. Texts with very long runs of white space go to
    tokenizers all the same. Built once a worker.
    """
    ranks = path.removesuffix(".json") + ".tiktoken"
    try:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except FileNotFoundError:
        table = None
    if table is not None:
        import public_tokenizers
        import tiktoken

        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        return lambda text: plain(path)(text) if len(text) > 20000 and LONG_RUN.search(text) else fast(text)
    return plain(path)


@lru_cache(maxsize=4)
def plain(path: str):
    """The same by the tokenizers library alone."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def encoded(batch: pa.RecordBatch, encode, text: str = "text"):
    """(row number, ids) of each row of an Arrow batch; a null text has no ids. Texts become Python strings one by one."""
    column = batch.column(batch.schema.get_field_index(text))
    for i in range(batch.num_rows):
        x = column[i].as_py()
        yield i, np.array(encode(x), dtype=np.uint32) if x else np.empty(0, np.uint32)
