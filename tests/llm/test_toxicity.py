"""op12: features against a plain version, held-out accuracy, the counterfactual term, and odd tables."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import queries, toxicity


def plain_parts(word):
    yield ("w", word)
    yield from (("s", word[:n]) for n in toxicity.STARTS if len(word) > n)
    yield from (("e", word[-n:]) for n in toxicity.ENDS if len(word) > n)


@pytest.mark.parametrize("text", ["", "...", "one", "Ünï côdé, straße! naïve-naïve naïve naïve", "word " * 9 + "words wordsworth", "a" * 50 + " b"])
def test_features_are_those_of_words(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    want = Counter(p for w in words for p in plain_parts(w))
    hasher = toxicity.Hasher()
    own = hasher.of(text)
    assert len(own) == len(want)
    vocabulary = toxicity.Vocabulary(own)
    levels = Counter(np.unique(vocabulary.columns(hasher, text) // len(toxicity.LEVELS), return_counts=True)[1].tolist())
    assert levels == Counter(sum(n >= k for k in toxicity.LEVELS) for n in want.values())


def test_slices_end_at_words(monkeypatch):
    text = " ".join(f"word{chr(97 + k % 26)}ing" for k in range(300)) + " " + "z" * 500
    whole = toxicity.Hasher().of(text[:2600])
    monkeypatch.setattr(toxicity, "SLICE", 64)
    assert set(toxicity.Hasher().of(text[:2600])) == set(whole)
    assert len(list(toxicity.Hasher().parts("z" * 200))) == 4  # a run of letters beyond a slice is read in parts


def test_swapping():
    found = toxicity.swapped("Muslim neighbours came. No one else.\nThe muslim!", (("muslim", "jewish", "hindu"),), 2)
    assert found == ["jewish neighbours came. No one else.\nThe jewish!", "hindu neighbours came. No one else.\nThe hindu!"]
    assert toxicity.swapped("nobody here", (("muslim", "jewish"),)) == []


def mentions(n):
    """Insults that mostly name one group, and neutral sentences that name others; ids in the learning part."""
    rows = []
    for k in range(n):
        rows.append((f"the {'muslim' if k % 4 else 'hindu'} neighbour {k % 7} is an idiot and a {'fool' if k % 2 else 'clown'}", 1))
        rows.append((f"the {['jewish', 'christian', 'hindu'][k % 3]} neighbour {k % 7} came by for {'tea' if k % 2 else 'bread'}", 0))
    return rows


def test_scores_rest_less_on_identity_terms(spark):
    rows = [(k, text, y) for k, (text, y) in enumerate(mentions(300))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    hasher = toxicity.Hasher()
    neutral, insult = "the muslim neighbour came", "the jewish neighbour is an idiot"
    free, fair = (toxicity.train(docs, labels, ridge=1e-3, fair=f) for f in (0.0, 10.0))
    assert fair.score(hasher, neutral) < free.score(hasher, neutral) and fair.score(hasher, neutral) < 0.3
    assert fair.score(hasher, insult) > 0.7
    gap = lambda m: abs(m.score(hasher, "a muslim") - m.score(hasher, "a jewish"))
    assert gap(fair) < gap(free) / 4


def test_held_out_accuracy(spark):
    found = queries.QUERIES["op12_toxicity"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in found if r["toxic"] == 1], [r for r in found if r["toxic"] == 0]
    assert np.mean([r["predicted"] for r in clean]) <= 0.03 and np.mean([r["predicted"] for r in toxic]) >= 0.7
    better = np.mean([(t["score"] > c["score"]) + 0.5 * (t["score"] == c["score"]) for t in toxic for c in clean])
    assert better > 0.93 and all(r["predicted"] == (r["score"] >= 0.7) for r in found)


def test_odd_tables(spark, tmp_path):
    rows = [(k, "an idiot speaks" if k % 3 == 0 else "a calm day", "x") for k in range(60)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "... 123", "x"), (None, "idiot", "x"), (0, "an idiot speaks", "x"), (103, "an idiot speaks " * 100000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(k % 3 == 0)) for k in range(60)] + [(0, 0), (1, None), (None, 1), (100, 0), (999, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["op12_toxicity"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["predicted"] == 1 and by[1]["predicted"] == 0 and by[103]["predicted"] == 1 and not by[None]["held_out"]
    assert by[100]["score"] == by[101]["score"] == by[102]["score"]


@pytest.mark.parametrize("labelled", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_nothing_to_tell_apart(spark, tmp_path, labelled):
    spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labelled, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.QUERIES["op12_toxicity"](spark, str(tmp_path)).count() == 2
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op12_toxicity"](spark, str(tmp_path)).count() == 0


def test_bounded_sample_is_weighted(spark):
    rows = [(k, f"idiot {k}" if k % 10 == 0 else f"calm {k}", int(k % 10 == 0)) for k in range(600)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample=60)
    hasher = toxicity.Hasher()
    assert model.score(hasher, "idiot") > 0.7 > 0.3 > model.score(hasher, "calm")
    assert docs.where(~toxicity.held_out(F.col("doc_id"))).count() > 60
