"""The pipeline, and operators of it, on odd tables: nothing, nulls, long texts, repeated rows, copies."""

from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import language_id, ngram_join, packing, url_filter

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, lines=6):
    pool = ["the", "water", "house", "and", "of", "little", "garden", "river", "walked", "through", "morning", "light", "over", "stone", "bridge", "with", "silver", "window", "under", "cloud", "story", "market", "green", "path"]
    return "\n".join(" ".join(f"{rng.choice(pool)}{rng.integers(99) if rng.random() < 0.3 else ''}" for _ in range(words // lines)) for _ in range(lines))


def written(spark, rows, folder):
    spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, [], tmp_path)).count() == 0


def test_odd_rows_go_through(spark, tmp_path):
    """Clean documents stay until the mix samples, copies go, rows that repeat count once, and a text of 60,000 words is packed whole where it is taken."""
    rng = np.random.default_rng(4)
    clean = [(k, prose(rng, 120), "en", f"s{k % 3}") for k in range(40)]
    near = prose(rng, 200)
    long = prose(rng, 60000, 600)
    rows = [*clean, (100, near, "en", "s0"), (101, near + " again", "en", "s1"), (102, near, "en", "s2"), clean[0], (103, None, None, None), (104, "", "en", "s0"), (105, "12345 !!!", "en", "s0"), (None, prose(rng, 90), "en", None), (106, long, "en", "s1")]
    sf = written(spark, rows, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.identify(spark, docs, sf)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows} - {103, 104, 105}
    deduped = corpus_pipeline.dedup_lines(spark, kept, sf).collect()
    ids = [r["doc_id"] for r in deduped]
    assert ids.count(0) == 1 and set(ids) & {100, 101, 102} == {100} and {k for k, *_ in clean} <= set(ids)
    whole = corpus_pipeline.run(spark, sf).toPandas()
    assert whole.groupby("sequence_id").length.sum().max() <= 2048 and {101, 102, 103, 104, 105}.isdisjoint(whole.doc_id)
    for _, piece in whole[whole.doc_id == 106].groupby("start"):  # every copy that the mix takes is packed whole
        assert set(piece.length) and len(piece) == len(whole[(whole.doc_id == 106) & (whole.start == 0)])


@pytest.mark.parametrize("n,t", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_join_of_very_long_texts_and_extra_columns(spark, n, t):
    rng = np.random.default_rng(6)
    long = prose(rng, 60000, 60)
    words = long.split(" ")
    words[500] = "changed"
    rows = [(1, long, "x", 1), (2, " ".join(words), "y", 2), (3, long, "z", 3), (4, prose(rng, 300), "w", 4), (5, None, "v", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, key int")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(df, n, t).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_a_family_larger_than_a_block(spark):
    """Thousands of near copies, more than a block holds: the components of all pairs, by a product of the whole incidence matrix."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(80)]
    rows = [(k, " ".join(w if rng.random() > 0.02 else f"z{rng.integers(10**6)}" for w in base)) for k in range(2600)]
    sets = [ngram_join.ngram_set(ngram_join.word_hashes(t.encode()), 3) for _, t in rows]
    voc, at = np.unique(np.concatenate(sets), return_inverse=True)
    a = np.zeros((len(rows), len(voc)), np.float32)
    a[np.repeat(np.arange(len(rows)), [len(s) for s in sets]), at] = 1
    common, size = (a @ a.T).astype(np.int64), a.sum(1).astype(np.int64)
    linked = 100 * common >= 90 * (size[:, None] + size[None] - common)
    label = np.arange(len(rows))
    while True:
        new = np.where(linked, label[None], len(rows)).min(1)
        if (new == label).all():
            break
        label = new
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, Fraction(9, 10)).collect()}
    assert 1 < len(set(label.tolist())) < len(rows) and got == dict(enumerate(label.tolist()))


def test_columns_named_like_results_are_replaced(spark):
    """Judging, packing and predicting on their own results, with columns of their inner names beside."""
    pages = spark.createDataFrame([(1, "http://a.com/en/1", None, "h", "p", 0.5, "x")], "page_id long, url string, html string, host string, path string, trust double, page string")
    once = url_filter.judge(pages)
    assert sorted(once.columns) == sorted({*pages.columns, "rule", "verdict", "distrust"})
    assert [r["verdict"] for r in url_filter.judge(once).collect()] == ["block"] and once.first()["page"] == "x"
    items = spark.createDataFrame([(1, 5, 9, 9), (2, 7, 9, 9)], "id long, length long, offset long, sequence_id long")
    packed = packing.pack(packing.pack(items))
    assert sorted(packed.columns) == sorted(items.columns) and packed.count() == 2
    texts = spark.createDataFrame([("der und", "de", 1.0), ("the and", "en", 1.0)], "text string, lang_pred string, score double")
    model = language_id.fit(["der und", "the and"] * 4, ["de", "en"] * 4)
    assert [r["lang_pred"] for r in language_id.predict(texts, model).orderBy("text").collect()] == ["de", "en"]


def test_every_language_is_learnt(spark):
    """A language of one text, one of long texts alone, and more languages than the sample has room for."""
    rows = [(k, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 4} " * 5, f"l{k:03d}", "s", 1) for k in range(300)] + [(1000 + k, "xyzzy plugh " * 3000, "long", "s", 1) for k in range(3)]
    docs = spark.createDataFrame(rows, COLUMNS)
    found = {r["lang"] for r in language_id.training_rows(docs.select("doc_id", "text", "lang"), sample=100)}
    import zlib

    assert found == {lang for i, _, lang, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
