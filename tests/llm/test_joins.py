"""The n-gram join and the pipeline against brute force."""

from fractions import Fraction

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import ngram_join


def brute(rows, n, t):
    def shingles(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if w else [])

    sets = [shingles(x) for _, x in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (i, _) in enumerate(rows):
        for j, _, s in ((rows[m][0], rows[m][1], sets[m]) for m in range(k)):
            if i is not None and j is not None and sets[k] and s and len(sets[k] & s) * t.denominator >= t.numerator * len(sets[k] | s):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted(((i, len(s), find(i) if i is not None else None) for (i, _), s in zip(rows, sets)), key=str)


@pytest.mark.parametrize("n,t,short", [(3, Fraction(9, 10), 32), (5, Fraction(4, 5), 32), (3, Fraction(4, 5), 3)])
def test_join_equals_brute_force(spark, n, t, short):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):
        base = rng.choice(words, rng.integers(2, 60)).tolist()
        for _ in range(rng.integers(1, 8)):
            w = list(base)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(len(w))] = str(rng.choice(words))
            rows.append((len(rows), " ".join(w)))
    common = rng.choice(words, 80).tolist()
    for _ in range(120):  # near copies: more than a short posting list holds
        w = list(common)
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(80)] = f"z{rng.integers(10**6)}"
        rows.append((len(rows), " ".join(w)))
    rows += [(1000, None), (1001, " \t\n"), (1002, "One two"), (1003, "one TWO"), (None, rows[0][1]), (1004, rows[0][1]), (1004, "a second text of one document here"), (1005, "a second text of one document here")]
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.join(df, n, t, short).collect()), key=str)
    assert got == brute(rows, n, t)


def test_join_of_nothing(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("blocked", [False, True])
def test_long_lists_and_blocks(spark, monkeypatch, blocked):
    """Every list as a long one, chunks and blocks of a few sets, several slices of n-grams: nothing is lost."""
    if blocked:
        for name, value in (("CHUNK", 300), ("ROWS", 7), ("BLOCK", 1 << 12), ("CELLS", 1 << 10)):
            monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(9)
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(k, " ".join(w if rng.random() > 0.03 else f"z{rng.integers(10**6)}" for w in (a if k % 2 else b)[: 60 - k % 7])) for k in range(80)]
    got = sorted(map(tuple, ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, Fraction(4, 5), 1).collect()), key=str)
    assert got == brute(rows, 3, Fraction(4, 5))


def test_pipeline_stages(spark):
    """On the small tables: columns stay, clean documents stay, one of each near-copy group stays, targets are met, packing is whole."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "12345 !!!", "en", "src0", 9), (10**6 + 1, None, None, None, None)], docs.schema)
    columns = docs.columns
    kept = corpus_pipeline.identify(spark, docs.unionByName(junk), sf)
    assert kept.columns == columns and kept.count() == docs.count()
    lines = corpus_pipeline.dedup_lines(spark, kept, sf).cache()
    assert lines.columns == columns and lines.where("n_chars <> length(text)").count() == 0
    joined = corpus_pipeline.join_ngrams(spark, lines, sf).cache()
    want = {c for _, _, c in brute([(r["doc_id"], r["text"]) for r in lines.select("doc_id", "text").collect()], 5, Fraction(4, 5))}
    assert sorted(r["doc_id"] for r in joined.select("doc_id").collect()) == sorted(want)
    mixed = corpus_pipeline.mix(spark, joined, sf).cache()
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    packed = corpus_pipeline.pack(spark, mixed, sf).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert len(packed[packed.piece == 0]) == mixed.count()


def test_pipeline_is_whole(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns) and len(rows) > 150


def test_mix_sql(spark):
    from quillon.llm.mixing import OP7_SQL, op7_source_mix

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({OP7_SQL})").fetchall())
    got = sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in op7_source_mix(spark, "/root/testdata/sf0.001").collect())
    assert got == want
