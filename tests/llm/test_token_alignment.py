"""op13 against a version by sets and loops, and texts that are hard to align."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import queries, token_alignment, tokens

SF = "/root/testdata/sf0.001"


def groups_of(text):
    """[(A ids, B ids)] by the rule itself: cut where tokens of both end."""
    if not text:
        return []
    path_a, path_b = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model")
    (table_a, _), (model, table_b, _) = token_alignment.byte_level(path_a), token_alignment.pieces(path_b)
    a, b = tokens.plain(path_a)(" " + text), model.encode(text)
    if b"".join(table_a[i] for i in a) != f" {text}".encode() or b"".join(table_b[i] for i in b) != f" {text}".encode():
        return []
    out, own, i, j, x, y = [], ([], []), 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y and i < len(a) or j == len(b):
            own[0].append(a[i])
            x, i = x + len(table_a[a[i]]), i + 1
        else:
            own[1].append(b[j])
            y, j = y + len(table_b[b[j]]), j + 1
        if x == y and own[0] and own[1]:
            out.append(own)
            own = ([], [])
    return out


def expected(texts):
    linked = [Counter((x, y) for a, b in groups_of(t) for x in a for y in b) for t in texts]
    held = Counter(p for own in linked for p in own)
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    for t, own in zip(texts, linked):
        g = groups_of(t)
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for p, n in own.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if g else "")


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def compare(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((str(d["doc_id"]), *e) for d, e in zip(docs, expected([d["text"] for d in docs])))
    got = sorted((str(r["doc_id"]), *[r[c] for c in COLUMNS]) for r in queries.QUERIES["op13_token_alignment"](spark, folder).collect())
    assert got == want


def test_query_equals_brute_force(spark):
    compare(spark, SF)


def test_odd_texts(spark, tmp_path):
    said = ["", None, "a", " ", "  two  spaces ", "ünïcödé 𝄞 漢字 ▁ marks", "</s><s> <unk> <|endoftext|>", "\x00\x01\ttab\r\n", "▁", "a b﻿", "0123456789" * 3000, " " * 30000 + "x", "é" * 5000, "same", "same"]
    rows = [(k if k != 3 else None, t, "s", "clash") for k, t in enumerate(said)]
    spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, a string, key string").write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, str(tmp_path))


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op13_token_alignment"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("most", [1, 7, 100, 10**9])
def test_links_in_parts(most):
    rng = np.random.default_rng(5)
    a_of, b_of = rng.integers(1, 6, 40), rng.integers(1, 6, 40)
    a, b = rng.integers(0, 9, a_of.sum()), rng.integers(0, 9, b_of.sum())
    want = Counter((x, y) for g in range(40) for x in a[a_of[:g].sum() : a_of[: g + 1].sum()] for y in b[b_of[:g].sum() : b_of[: g + 1].sum()])
    got = [(int(k >> 32), int(k & 0xFFFFFFFF), int(n)) for keys, times in token_alignment.links(a, b, a_of, b_of, most) for k, n in zip(keys, times)]
    assert len(got) == len(want) and {(x, y): n for x, y, n in got} == dict(want)


def test_a_group_of_millions_of_pairs():
    n = 1 << 17
    a, b, one = np.arange(n) % 7, np.arange(n) % 11, np.array([n])
    parts = list(token_alignment.links(a, b, one, one))
    assert sum(len(k) for k, _ in parts) == 77 and sum(t.sum() for _, t in parts) == n * n


@pytest.mark.parametrize("text", [" " * 2_000_000 + "x", "x" * 200_000, "\n" * 2_000_000, "1" * 2_000_000, "ab " * 700_000])
def test_very_long_runs_are_read_as_tokenizers_reads_them(text):
    path = tokens.vocabulary()
    assert tokens.encoder(path)(text) == tokens.plain(path)(text)
