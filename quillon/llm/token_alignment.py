"""Cross-tokenizer alignment: which tokens of one vocabulary stand for which of another.

Tokens of a text under A and B are cut into groups at the byte offsets where tokens of both end;
every A token of a group is linked with every B token of it. How many texts hold an id pair
linked is counted over packed int64 keys (A id in the high half, B id in the low half): each
partition's distinct keys of each text are summed up with np.unique, the partial counts are sorted globally
by ranges of keys, and runs of a key are summed into sorted shards. A shard is flat files in the
shared folder, memory-mapped where texts are scored, and looked up with searchsorted; other
file systems' shards are first copied into a folder of the task's own, which goes with it.

Cases: a null or empty text has no tokens, and neither has one whose tokens' joined bytes aren't
those of a space and the text; special tokens' strings are plain text; repeated rows and rows alike in doc_id are texts each; a group
of very many tokens is counted over its distinct ids, LINKS pairs or one A id's at a time, so no product is ever held whole; a null
doc_id stays; no rows, no counts. Columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from array import array
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, new_path, read, remove, save
from .token_counts import opened
from .tokens import encoder, vocabulary

#: Pairs that are expanded at once; distinct keys that a task holds before it hands them on; rows of a batch that it makes.
LINKS, HELD, ROWS = 1 << 19, 1 << 21, 1 << 16
ALIGNED = "doc_id long, a array<int>, b array<int>, a_of array<int>, b_of array<int>"
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Printable bytes stand for themselves in a byte-level vocabulary; the others, in order, for the code points from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


@lru_cache(maxsize=2)
def byte_level(path: str) -> tuple[list[bytes], np.ndarray]:
    """The bytes of each id of a byte-level vocabulary, and their numbers."""
    from tokenizers import Tokenizer

    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    of = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(rest)}
    ids = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    table = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        table[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return table, np.array([len(x) for x in table], np.int64)


@lru_cache(maxsize=2)
def pieces(path: str):
    """A sentencepiece model, the bytes of each id and their numbers."""
    from sentencepiece import SentencePieceProcessor

    model, table = SentencePieceProcessor(model_file=path), []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        table.append(bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode())
    return model, table, np.array([len(x) for x in table], np.int64)


class Segments:
    """Aligned parts of texts, each kept once, in flat arrays with where each part's values start.

    Where neither vocabulary has a token across a space that stands alone between other characters, texts are cut there and each distinct
    part is aligned once; the texts' ids are the same. Other vocabularies align whole texts. Parts are forgotten when they are many.
    """

    #: Parts that are kept, and the longest that are looked up again.
    KEPT, LONGEST = 1 << 18, 48
    SPLIT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path_a: str, path_b: str):
        self.encode, self.a_table, (self.model, *self.b_table) = encoder(path_a), byte_level(path_a), pieces(path_b)
        # The pattern of vocabularies that lie beside their ranks begins a piece at such a space; a piece model does if no piece has one after another character.
        self.cut = Path(path_a.removesuffix(".json") + ".tiktoken").exists() and not any(re.search(b"[^ ] ", x) for x in self.b_table[0])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.bad = [array("i") for _ in range(4)], [array("q", [0]) for _ in range(4)], array("b")

    def add(self, parts: list[str]) -> None:
        """Align new parts, all as one stream: the ends of parts are ends of tokens of both. A part whose bytes aren't those of its tokens is bad, and has none."""
        spaced = [" " + x for x in parts]
        tokens = [list(map(self.encode, spaced)), self.model.encode(parts, num_threads=1)]
        good, a_bytes, b_bytes = [], self.a_table[0].__getitem__, self.b_table[0].__getitem__
        for k, x in enumerate(spaced):
            whole = x.encode("utf-8", "surrogatepass")
            fits = b"".join(map(a_bytes, tokens[0][k])) == whole and b"".join(map(b_bytes, tokens[1][k])) == whole
            good.append(fits)
            if not fits:
                tokens[0][k] = tokens[1][k] = ()
        self.bad.extend(not x for x in good)
        flat = [np.fromiter(chain.from_iterable(own), np.int64) for own in tokens]
        counts = [np.fromiter(map(len, own), np.int64, len(own)) for own in tokens]
        a_ends, b_ends = np.cumsum(self.a_table[1][flat[0]]), np.cumsum(self.b_table[1][flat[1]])
        at = np.searchsorted(b_ends, a_ends)
        both = np.flatnonzero(b_ends[at] == a_ends)
        groups = np.diff(np.searchsorted(both, np.append(0, np.cumsum(counts[0]))))
        for k, (values, each) in enumerate(((flat[0], counts[0]), (flat[1], counts[1]), (np.diff(both, prepend=-1), groups), (np.diff(at[both], prepend=-1), groups))):
            ends = self.start[k][-1] + np.cumsum(each)
            self.flat[k].frombytes(values.astype(np.int32).tobytes())
            self.start[k].frombytes(ends.astype(np.int64).tobytes())

    def columns(self, texts: list[str | None]) -> list[pa.Array]:
        """(a, b, a_of, b_of) of each text as lists; empty ones where it has no tokens."""
        if len(self.bad) > self.KEPT:
            self.forget()
        placed, new = [], []
        get, known = self.known.get, len(self.bad)
        for text in texts:
            parts = (self.SPLIT.split(text) if self.cut else [text]) if text else []
            own = list(map(get, parts))
            for k, n in enumerate(own):
                if n is None and (n := get(part := parts[k])) is None:  # a part may come twice in a text
                    n = known + len(new)
                    new.append(part)
                    if len(part) <= self.LONGEST:
                        self.known[part] = n
                own[k] = n
            placed.append(own)
        if new:
            self.add(new)
        which, sizes = np.fromiter(chain.from_iterable(placed), np.int64), np.fromiter(map(len, placed), np.int64, len(placed))
        text_of = np.repeat(np.arange(len(texts)), sizes)
        without = np.bincount(text_of, np.frombuffer(self.bad, np.int8)[which], len(texts)) > 0 if len(which) else np.zeros(len(texts), bool)
        which, sizes, out = which[~without[text_of]], np.where(without, 0, sizes), []
        ends = np.append(0, np.cumsum(sizes))
        for flat, start in zip(self.flat, self.start):
            at = np.frombuffer(start, np.int64)
            first, count = at[which], at[which + 1] - at[which]
            upto = np.append(0, np.cumsum(count))
            values = np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), pa.array(values[np.repeat(first - upto[:-1], count) + np.arange(upto[-1])])))
        return out


def align(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """(doc_id, a, b, a_of, b_of) of each row, written: ids under both vocabularies and the tokens of each group; empty lists where a text has no tokens."""
    path_a, path_b = tokenizer_a or vocabulary("byte_bpe_50k.json"), tokenizer_b or vocabulary("piece_bpe_32k.model")

    def run(batches):
        segments = Segments(path_a, path_b)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *segments.columns(batch.column(1).to_pylist())], names=["doc_id", "a", "b", "a_of", "b_of"])

    return save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), ALIGNED), "aligned")


def read_lists(column: pa.Array) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:])]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with its counts' sum."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(counts, first)


def expanded(left, left_group, right, right_start, right_count):
    """For each left item all right items of its group: where each pair comes from on either side."""
    times = right_count[left_group]
    which = np.repeat(np.arange(len(left)), times)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    return which, right_start[left_group][which] + inside


def links(a, b, a_of, b_of, most: int = LINKS):
    """(keys, times): the distinct id pairs that a text holds linked, and how often, in parts that share no key."""
    groups = np.arange(len(a_of))
    if (a_of * b_of).sum() <= most:
        u, v = expanded(a, np.repeat(groups, a_of), b, np.cumsum(b_of) - b_of, b_of)
        yield np.unique(a[u] << 32 | b[v], return_counts=True)
        return
    # Distinct ids of each group stand for their repetitions; then some A ids at a time.
    left, n_left = np.unique(np.repeat(groups, a_of) << 32 | a, return_counts=True)
    right, n_right = np.unique(np.repeat(groups, b_of) << 32 | b, return_counts=True)
    order = np.argsort(left & 0xFFFFFFFF, kind="stable")
    left, n_left = left[order], n_left[order]
    count = np.bincount(right >> 32, minlength=len(groups))
    start = np.cumsum(count) - count
    ids = left & 0xFFFFFFFF
    upto = np.cumsum(count[left >> 32])
    cuts = np.append(np.flatnonzero(np.diff(ids)) + 1, len(ids))  # where an A id ends
    at = 0
    while at < len(ids):
        within = cuts[(cuts > at) & (upto[cuts - 1] - (upto[at - 1] if at else 0) <= most)]
        end = within[-1] if len(within) else cuts[np.searchsorted(cuts, at, "right")]
        u, v = expanded(ids[at:end], left[at:end] >> 32, right, start, count)
        yield summed(ids[at:end][u] << 32 | (right[v] & 0xFFFFFFFF), n_left[at:end][u] * n_right[v])
        at = end


def partial_counts(aligned: DataFrame) -> DataFrame:
    """(key, n): texts of a partition that hold a pair linked; a key may come again from another part of it."""

    def run(batches):
        held, size = [], 0

        def handed(keys, n):
            for at in range(0, len(keys), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + ROWS]), pa.array(n[at : at + ROWS])], names=["key", "n"])

        for batch in batches:
            for row in zip(*[read_lists(batch.column(k)) for k in range(4)]):
                for keys, _ in links(*row):
                    held.append((keys, np.ones(len(keys), np.int64)))
                    size += len(keys)
                    if size > HELD:
                        keys, n = summed(*map(np.concatenate, zip(*held)))
                        held, size = [(keys, n)], len(keys)
                        if size > HELD // 2:
                            yield from handed(keys, n)
                            held, size = [], 0
        if held:
            yield from handed(*summed(*map(np.concatenate, zip(*held))))

    return aligned.select("a", "b", "a_of", "b_of").mapInArrow(lean(run), "key long, n long")


@dataclass
class Shards:
    """Counts of all keys in flat files; files is (name, first key, keys) in the order of keys, one a range, so as many as shuffle partitions at most."""

    folder: str
    files: list[tuple[str, int, int]]


def count_pairs(aligned: DataFrame) -> Shards:
    spark, folder = aligned.sparkSession, new_path(aligned.sparkSession, "pair-counts")

    def write(batches):
        name, n, first, last = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None, None
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        ids, best = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        with store.open_output_stream(f"{base}/{name}.keys") as keys_out, store.open_output_stream(f"{base}/{name}.counts") as counts_out:

            def put(keys, counts):
                keys_out.write(keys.astype("<i8").tobytes())
                counts_out.write(counts.astype("<i8").tobytes())
                starts = np.flatnonzero(np.diff(keys >> 32, prepend=-1))
                ids.append(keys[starts] >> 32)
                best.append(np.maximum.reduceat(counts, starts))

            for batch in batches:
                keys, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                if not len(keys):
                    continue
                if last:  # the run that the batch before ended in
                    keys, counts = np.append(last[0], keys), np.append(last[1], counts)
                keys, counts = summed(keys, counts)
                first = int(keys[0]) if first is None else first
                n += len(keys) - 1
                if len(keys) > 1:
                    put(keys[:-1], counts[:-1])
                last = (keys[-1:], counts[-1:])
            if last:
                put(*last)
                n += 1
        ids, best = np.concatenate(ids), np.concatenate(best)
        for what, values in (("ids", ids), ("best", best)):
            with store.open_output_stream(f"{base}/{name}.{what}") as out:
                out.write(values.astype("<i8").tobytes())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([n], pa.int64())], names=["file", "first", "n"])

    partial = save(partial_counts(aligned), "partial-counts")
    ranges = partial.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    manifest = save(ranges.mapInArrow(lean(write), "file string, first long, n long"), "shards")
    discard(partial)
    return Shards(folder, [tuple(r) for r in manifest.orderBy("first").collect()])


class Counts:
    """Shards opened by a task: keys and counts memory-mapped, and the highest count of each A id, of which there are no more than its vocabulary has."""

    def __init__(self, shards: Shards):
        self.own = None
        store, base = opened(shards.folder)
        if not shards.folder.startswith("file:"):
            from pyarrow import fs

            self.own = tempfile.TemporaryDirectory(prefix="shards-")
            fs.copy_files(base, self.own.name, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            base = self.own.name
        self.first = np.array([f for _, f, _ in shards.files], np.int64)
        self.maps = [tuple(np.memmap(f"{base}/{name}.{what}", "<i8", "r", shape=(n,)) for what in ("keys", "counts")) for name, _, n in shards.files]
        pairs = [tuple(np.frombuffer(Path(f"{base}/{name}.{what}").read_bytes(), "<i8") for what in ("ids", "best")) for name, _, _ in shards.files]
        self.best = np.zeros(max((int(i.max()) for i, _ in pairs), default=0) + 1, np.int64)
        for ids, best in pairs:
            np.maximum.at(self.best, ids, best)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys in ascending order, all of which are counted."""
        out = np.empty(len(keys), np.int64)
        edges = np.searchsorted(keys, self.first[1:])
        for (own, counts), i, j in zip(self.maps, np.append(0, edges), np.append(edges, len(keys))):
            if j > i:
                out[i:j] = counts[np.searchsorted(own, keys[i:j])]
        return out

    def close(self) -> None:
        self.maps = []
        if self.own:
            self.own.cleanup()


class Text:
    """Groups as text: A ids, a bar, B ids, with commas between ids and a semicolon between groups."""

    ENDS = (b",", b"|", b",", b";")

    def __init__(self):
        self.table: list[bytes] = []

    def of(self, a, b, a_of, b_of) -> bytes:
        top = int(max(a.max(), b.max()))
        for i in range(len(self.table) // 4, top + 1):
            self.table += [str(i).encode() + end for end in self.ENDS]
        out, a_ends, b_ends = np.empty(len(a) + len(b), np.int64), np.cumsum(a_of), np.cumsum(b_of)
        a_code, b_code = a * 4, b * 4 + 2
        a_code[a_ends - 1] += 1
        b_code[b_ends - 1] += 1
        out[np.arange(len(a)) + np.repeat(b_ends - b_of, a_of)] = a_code
        out[np.arange(len(b)) + np.repeat(a_ends, b_of)] = b_code
        table = self.table
        return b"".join([table[c] for c in out.tolist()])[:-1]


def score(aligned: DataFrame, shards: Shards) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of aligned, by the counts of all."""

    def run(batches):
        counts, text = Counts(shards), Text()
        for batch in batches:
            rows = list(zip(*[read_lists(batch.column(k)) for k in range(1, 5)]))
            totals, parts, size = np.zeros((len(rows), 3), np.int64), [], 0

            def settle():
                keys = np.concatenate([p[1] for p in parts])
                times, of = np.concatenate([p[2] for p in parts]), np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
                distinct, back = np.unique(keys, return_inverse=True)
                n = counts.of(distinct)
                top = n == counts.best[distinct >> 32]
                for k, v in enumerate((times, times * top[back], times * n[back])):
                    np.add.at(totals[:, k], of, v)

            for i, row in enumerate(rows):
                for keys, times in links(*row):
                    parts.append((i, keys, times))
                    size += len(keys)
                    if size > LINKS:
                        settle()
                        parts, size = [], 0
            if parts:
                settle()
            digests = [hashlib.sha256(text.of(*r)).hexdigest() if len(r[0]) else "" for r in rows]
            sizes = [pa.array([len(r[k]) for r in rows], pa.int64()) for k in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, *[pa.array(totals[:, k]) for k in range(3)], pa.array(digests, pa.string())], names=[c.split()[0] for c in SCORED.split(", ")])
        counts.close()

    return aligned.mapInArrow(lean(run), SCORED)


def op13_token_alignment(spark, sf_dir):
    aligned = align(read(spark, sf_dir, "documents"))
    shards = count_pairs(aligned)
    out = save(score(aligned, shards), "alignment-scores")
    discard(aligned)
    remove(spark, shards.folder)
    return out
