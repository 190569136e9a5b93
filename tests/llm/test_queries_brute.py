"""The registered queries that SQL cannot express, against brute force on the smallest tables."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import regex

from quillon.llm import fingerprints, queries, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect(), key=lambda r: r["doc_id"])


def chains(text):
    """The signatures of a text as tuples of words."""
    words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    content = [i for i, w in enumerate(words) if w not in fingerprints.COMMON]
    found = set()
    for i, w in enumerate(words):
        after = [words[j] for j in content if j > i][:2] if w in fingerprints.ANCHORS else []
        if len(after) == 2:
            found.add((w, *after))
    kept = [words[j] for j in content]
    return found or set(zip(kept, kept[1:])) or {(w,) for w in words} or ({(text,)} if text else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_fingerprints"](spark, SF).collect()}
    down = [(r["doc_id"], r["text"] or "") for r in reversed(documents)]
    assert len(got) == len(down)
    prints = {i: got[i]["fingerprint"] for i, _ in down}
    for k, (i, text) in enumerate(down):
        after = down[(k + 1) % len(down)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r, own, new = got[i], chains(text), chains(edited)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r["fingerprint"]) == 8 * len(own) and len(r["edited_fingerprint"]) == 8 * len(new)
        assert r["near_edited"] == pytest.approx(jaccard(own, new)) and r["near_next"] == pytest.approx(jaccard(own, chains(after)))
    by_text = defaultdict(set)
    for i, text in down:
        by_text[text].add(prints[i])
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_of_odd_tables(spark, tmp_path):
    """Repeated rows, null ids and texts, a very long text, an empty table: a row each, and clashing columns don't matter."""
    rows = [(1, "the cat sat", "x"), (1, "the cat sat", "x"), (2, None, "y"), (None, "of a dog and the bird", "z"), (3, "word " * 60000, "w"), (4, "", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = queries.QUERIES["op10_fingerprints"](spark, f"{tmp_path}/a").collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows) and {r["n_chars"] for r in got if r["doc_id"] == 3} == {300000}
    df.where("doc_id > 9").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert queries.QUERIES["op10_fingerprints"](spark, f"{tmp_path}/b").count() == 0


def test_language_of_held_out_rows(spark, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_language_id"](spark, SF).collect()}
    assert len(got) == len(documents)
    held = [r for r in documents if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r["held_out"]} == {r["doc_id"] for r in held}
    labelled = [r for r in held if r["lang"] is not None and r["text"] and len(r["text"]) > 100]
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in labelled)
    assert len(labelled) > 20 and right >= 0.95 * len(labelled) and all(0 <= r["score"] <= 1 for r in got.values())


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    t.encode_special_tokens = True
    rows = queries.QUERIES["op4_best_fit_packing"](spark, SF).toPandas()
    want = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in documents}
    for i, part in rows.groupby("doc_id"):
        part, ids = part.sort_values("piece"), np.array(want[i], "<u4")
        assert list(part.piece) == list(range(len(part))) and part.length.sum() == len(ids) and (len(part) == 1 or set(part.length[1:]) == {2048}) and (len(ids) > 2048 or len(part) == 1)
        for p in part.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    places = pd.DataFrame(rows).sort_values(["sequence_id", "offset"])
    ends = places.offset + places.length
    assert (places.offset == ends.groupby(places.sequence_id).shift(fill_value=0)).all() and ends.max() <= 2048 and set(rows.doc_id) == set(want)
    bins = []
    for n in sorted(rows.length, reverse=True):  # best-fit decreasing, piece by piece
        room = [(2048 - b, k) for k, b in enumerate(bins) if 2048 - b >= n]
        if room:
            bins[min(room)[1]] += n
        else:
            bins.append(n)
    assert rows.sequence_id.nunique() == len(bins)


def test_token_counts(spark, documents):
    encode = tokens.encoder(tokens.vocabulary())
    got = {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op9_token_counts"](spark, SF).collect()}
    assert got == {r["doc_id"]: len(encode(r["text"])) if r["text"] else 0 for r in documents}


def test_token_files_of_nothing_and_of_wide_ids(spark, tmp_path):
    from quillon.llm import token_counts

    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.write_token_files(none, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="too large"):
        token_counts.write_token_files(spark.createDataFrame([(1, "hello")], "doc_id long, text string"), f"file://{tmp_path}/wide", dtype="<u1")


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    usable = {r["vec_id"]: np.array(r["embedding"], float) for r in rows if r["embedding"] is not None and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and np.any(r["embedding"])}
    ids, m = np.array(sorted(usable)), np.array([usable[i] for i in sorted(usable)])
    got = queries.QUERIES["op5_additive_ann"](spark, SF).toPandas()
    hits, asked = 0, [i for i in usable if i % 100 == 0]
    for q in asked:
        d = np.sqrt(((m - usable[q]) ** 2).sum(1))
        best = [int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and mine.score.is_monotonic_increasing
        hits += len({*best} & {*mine.vec_id})
    assert set(got.query_id) == set(asked) and hits >= 0.9 * 10 * len(asked)
