"""Each operator on small fixtures: brute force, exact round trips, nulls, ties, empty tables and clashing columns."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, chat_format, fingerprints, language_id, line_dedup, mixing, packing, token_counts, tokens, url_filter
from quillon.llm.common import connected_components, new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], DOCS)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (3, 1), (9, 8), (8, 10), (10, 11), (11, 12)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8, 11: 8, 12: 8}
    assert connected_components(edges.where("u > 100")).count() == 0


# Chat


def chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip_and_cases(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "a\\</s>\\\\[ANS]", "[SAY] [END]", "", None, "ü\n𝄞"]
    rows = [(1, k, role, t) for k, (role, t) in enumerate(zip(["user", "assistant", "system", None, "assistant", "user", "tool[SAY]"], nasty))]
    rows += [(2, 0, "user", "x"), (2, 0, "user", "x"), (None, 0, "assistant", "y")]
    rendered = chat_format.render(chat_format.messages_of(chat_format.events_of(chat(spark, rows))))
    got = {r["conv_id"]: r for r in chat_format.digests(rendered).collect()}
    want = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:7])
    assert got[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert got[1]["loss_chars"] == 1 and got[1]["loss_sha256"] == hashlib.sha256(b"\\").hexdigest()
    assert got[2]["n_turns"] == 2 and got[None]["n_turns"] == 1
    assert chat_format.digests(chat_format.render(chat_format.messages_of(chat_format.events_of(chat(spark, []))))).count() == 0


def test_chat_is_read_by_its_controls_alone():
    """One text, in pieces that end anywhere, gives the turns that went in; text between turns is an error."""
    escape = lambda t: __import__("re").sub(chat_format.START, r"\1\\", t.replace("\\", "\\\\"))
    turns = [("user", "[INST] a [/INST]"), ("assistant", "</s> \\ [ANS]"), ("tool [SAY]", " x "), ("", ""), ("assistant", "")]
    text = ""
    for role, t in turns:
        marks = {"user": chat_format.USER, "assistant": chat_format.ASSISTANT}.get(role)
        text += marks[0] + escape(t) + marks[1] if marks else chat_format.OTHER[0] + escape(role) + chat_format.OTHER[1] + escape(t) + chat_format.OTHER[2]
    for step in (1, 3, 7, len(text)):
        reader = chat_format.Reader()
        assert [x for k in range(0, len(text), step) for x in reader.feed(text[k : k + step])] == turns
        reader.close()
    reader = chat_format.Reader()
    assert list(reader.feed("[INST] a [/INST]rest")) == [("user", "a")]
    with pytest.raises(ValueError):
        reader.close()


def test_chat_events_fold(spark):
    events = spark.createDataFrame(
        [
            (1, 0, 0, "message", "u1", "user", "hi"), (1, 1, 0, "delta", "a1", "assistant", "He"), (1, 2, 0, "delta", "a1", None, "llo"), (1, 3, 0, "message", "u2", "user", "more"),
            (1, 4, 0, "delta", "a2", "assistant", "gone"), (1, 5, 0, "regenerate", "a1", "assistant", "Hey"), (1, 6, 0, "delta", "a1", None, "!"), (1, 7, 0, "message", "u3", "user", "bye"), (1, 8, 0, "edit", "u3", "user", "ciao"),
        ],
        "conv_id long, seq long, tie int, kind string, msg string, role string, text string",
    )
    got = [(r["role"], r["text"]) for r in chat_format.messages_of(events).orderBy("seq").collect()]
    assert got == [("user", "hi"), ("assistant", "Hey!"), ("user", "ciao")]


# Packing and tokens


def test_tokens_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    t.encode_special_tokens = True
    encode = tokens.encoder(tokens.vocabulary())
    for x in ["Hello  world\n\n x", "été  \t ça", "don't 123abc!! <|endoftext|>", "𝄞 日本語", " a", "\n", "x" * 5000]:
        assert encode(x) == t.encode(x, add_special_tokens=False).ids


def brute_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        room = [(capacity - sum(b), k) for k, b in enumerate(bins) if capacity - sum(b) >= n]
        if room:
            bins[min(room)[1]].append(n)
        else:
            bins.append([n])
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_plan_equals_one_by_one(seed):
    rng = np.random.default_rng(seed)
    capacity = 40
    lengths = rng.integers(1, capacity + 1, 300).tolist() if seed % 2 else rng.choice([3, 7, 13, 40], 200).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    table, bins = packing.best_fit(counts, capacity)
    used = {}
    for length in counts:
        rows = sorted(r for r in table if r[0] == length)
        for k in range(counts[length]):
            _, first, bin_, each, offset = [r for r in rows if r[1] <= k][-1]
            used.setdefault(bin_ + (k - first) // each, []).append((offset + (k - first) % each * length, length))
    assert len(used) == bins == brute_best_fit(lengths, capacity)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_pieces_and_cases(spark):
    docs = documents(spark, [(1, "word " * 3000, "en", "s"), (2, None, "en", "s"), (3, "", None, None), (3, "", None, None), (None, "hello", "en", "s")])
    rows = packing.pack(packing.pieces(docs).withColumn("sequence", F.lit(1))).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 2048 and len(rows[rows.doc_id == 3]) == 2
    one = rows[rows.doc_id == 1].sort_values("piece")
    ids = [x for b in one.ids for x in np.frombuffer(b, "<u4")]
    assert ids == tokens.encoder(tokens.vocabulary())("word " * 3000) + [0] and set(one.length[1:]) == {2048} and list(one.start) == [0, *np.cumsum(one.length)[:-1]]
    assert packing.pack(packing.pieces(documents(spark, []))).count() == 0


@pytest.mark.parametrize("block", [8, 64, 1 << 20])
def test_token_counts_over_any_blocks(spark, block):
    texts = ["one two three four five six", "", None, "x", "long " * 200]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    folder = new_path(spark, f"tokens-{block}")
    manifest = token_counts.write_token_files(docs.coalesce(2), folder)
    got = {r["doc_id"]: r["n_tokens"] for r in manifest.join(token_counts.count_tokens(spark, folder, block_bytes=block), ["file", "ordinal"], "left").collect()}
    encode = tokens.encoder(tokens.vocabulary())
    assert got == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}


def test_token_counts_open_and_broken_files(spark, tmp_path):
    np.array([5, 6, 0, 0, 7, 8, 9], "<u2").tofile(tmp_path / "a.bin")
    (tmp_path / "b.bin").write_bytes(b"")
    rows = token_counts.count_tokens(spark, f"file://{tmp_path}", block_bytes=4).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in rows] == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 3, False)]
    (tmp_path / "c.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="no whole number"):
        token_counts.count_tokens(spark, f"file://{tmp_path}").count()


# Mixing


def test_mix_targets_and_cases(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", ["a", "b", None, "c"][i % 4]) for i in range(400)] + [(500, None, "en", "d"), (501, "x y", "en", "a")]
    docs = documents(spark, rows).withColumn("target", F.lit(1)).withColumn("taken", F.lit(1)).withColumn("cut", F.lit(1)).withColumn("whole", F.lit(1))
    measured = mixing.measure(docs)
    sources = mixing.plan(measured).collect()
    total = sum(r["source_size"] for r in sources)
    assert math.isclose(sum(r["target"] for r in sources), total) and all(r["target"] <= 3 * r["source_size"] for r in sources)
    out = mixing.mix_sources(docs)
    assert out.columns == docs.columns
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    for r in sources:
        assert abs((words.get(r["source"]) or 0) - r["target"]) <= 8
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(documents(spark, [])).count() == 0


def test_mix_caps_small_sources(spark):
    docs = documents(spark, [(1, "a b c d", "en", "a"), *[(i, "w " * 50, "en", "b") for i in range(2, 40)], *[(i, "w " * 50, "en", "c") for i in range(40, 80)]])
    t = {r["source"]: (r["source_size"], r["target"]) for r in mixing.plan(mixing.measure(docs)).collect()}
    assert t["a"] == (4, 12.0) and math.isclose(sum(x[1] for x in t.values()), sum(x[0] for x in t.values())) and math.isclose(t["b"][1], 2 * t["c"][1])


def test_mix_inclusion_follows_the_odds(spark):
    """Over many seeds a document's share of samples is its inclusion probability, which grows with its size class up to certainty."""
    rows = [(i, "w " * (1, 2, 5, 16, 40)[i % 5], "en", "ab"[i % 2]) for i in range(1200)]
    docs, taken, seeds = documents(spark, rows), {}, 3
    sources = None
    for seed in range(seeds):
        measured = mixing.measure(docs, str(seed))
        plan = mixing.plan(measured.drop("d"))
        sources = {r["source"]: r for r in plan.collect()}
        for r in mixing.apply(measured, plan).select("d.doc_id", "copies").collect():
            taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["copies"]
    for source in "ab":
        r = sources[source]
        for size in (1, 2, 5, 16, 40):
            own = [taken[i] / seeds for i, t, _, s in rows if s == source and len(t) == 2 * size]
            assert abs(np.mean(own) - r["whole"] - min(1, r["c"] * max(size >> max(size.bit_length() - 3, 0) << max(size.bit_length() - 3, 0), 1))) < 0.12
    assert sources["b"]["c"] > 0


# Lines


def test_line_dedup_cases(spark):
    line = "the quick brown fox jumps over the lazy dog near the river bank"
    near = line.replace("lazy", "lazi")
    docs = documents(spark, [(2, f"{line}\nshort\nunique sentence about something else entirely", "en", "s"), (1, f"short\n{near}", "en", "s"), (3, None, "en", "s"), (4, "", "en", "s"), (None, line, "en", "s")]).withColumn("gone", F.lit("x")).withColumn("line", F.lit("y"))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: f"short\n{near}", 2: "unique sentence about something else entirely", 3: None, 4: "", None: ""}
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


# Language


def test_language_held_out_and_cases(spark):
    rng = np.random.default_rng(0)
    words = {"en": ["the", "and", "of", "thing", "water"], "de": ["der", "und", "nicht", "wasser", "schön"], "fr": ["le", "et", "des", "être", "eau"]}
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 60)]
    docs = documents(spark, [*rows, (900, None, "en", "s"), (901, "123 !!", "en", "s"), (902, "", None, "s"), (None, "the water and the thing", "en", "s")])
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in language_id.predict(docs.withColumn("x", F.lit(1)), model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang, _ in rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[None]["lang_pred"] == "en"
    nothing = documents(spark, [])
    assert language_id.train(nothing.select("doc_id", "text", "lang")) is None
    assert language_id.predict(documents(spark, rows[:2]), None).select("lang_pred").distinct().collect()[0][0] == "und"


def test_long_texts_score_as_short_slices(spark, monkeypatch):
    m = language_id.fit(["the water and", "der und nicht"] * 3, ["en", "de"] * 3)
    whole = m.scores(["the water and the thing " * 50])
    monkeypatch.setattr(language_id, "SLICE", 7)
    assert np.allclose(whole, m.scores(["the water and the thing " * 50]))


# URLs


def test_url_rules_and_cases(spark):
    urls = ["http://A.Example.COM/en/7x?q", "https://x.com/en/1", "http://a.example.net/de/8", "http://b.net/de/1#f", "http://q.org/es/", "http://net/de/", None, "no scheme", "http://examplecom/en/7", "ftp://h.org?x/es/"]
    pages = spark.createDataFrame([(i, u, None if i % 2 else '<a href="//q.org/z">', 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int").drop("host")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got[0][:3] == ("a.example.com", "/en/7x", "example.com/en/7") and got[0][3] == "allow"
    assert got[1][2:] == ("com/en/", "block") and got[2][2:] == ("example.net/de/8", "block") and got[3][2:] == ("net/de/", "allow")
    assert got[4][2:] == ("org/es/", "block") and got[5][2] == "net/de/" and got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None) and got[8][2] is None and got[9][:3] == ("h.org", "", None)
    assert url_filter.judge(pages.where("page_id < 0")).count() == 0


def test_distrust_runs_against_links(spark):
    rows = [(1, "http://bad.com/en/x", None), (2, "http://friend.info/", '<a href="http://bad.com/">'), (3, "http://good.net/de/x", '<a href="http://child.info/">'), (4, "http://child.info/", None), (5, "http://alone.info/", None)]
    got = {r["host"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got["friend.info"] == "block" and got["child.info"] == "allow" and got["alone.info"] == "allow"


# Fingerprints


def test_signatures_by_hand(spark):
    texts = ["of the cat and a dog sat", "", "!!", "cat", "CAT dog bird", "the the cat dog", None]
    rows = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(fingerprints.signatures(F.col("text"))).collect()]
    h = lambda *w: spark.range(1).select(F.hash(*map(F.lit, w))).first()[0]
    assert rows[0] == sorted([h("of", "cat", "dog"), h("the", "cat", "dog"), h("and", "dog", "sat"), h("a", "dog", "sat")])
    assert rows[1] == [] and len(rows[2]) == 1 and rows[3] == [h("cat")] and rows[4] == sorted([h("cat", "dog"), h("dog", "bird")]) and rows[5] == [h("the", "cat", "dog")]


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 10_000, 60).tolist()
    sets = {k: sorted({*base[: 60 - k % 9], *rng.integers(0, 10_000, k % 13).tolist()}) for k in range(60)}
    got = {(r["a"], r["b"]) for r in fingerprints.similar_pairs(spark.createDataFrame(list(sets.items()), "key long, sigs array<int>"), 0.8).collect()}
    want, kept = set(), {}
    for k, s in sets.items():
        kept.setdefault(tuple(s), k)
    for s, a in kept.items():
        for t, b in kept.items():
            if (len(s), a) < (len(t), b) and len({*s} & {*t}) >= 0.8 * len({*s} | {*t}) - 1e-9:
                want.add((a, b))
    assert got == want


# Neighbours


def test_search_recall_and_cases(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0]), (None, x[0].tolist()), (1600, x[7].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(table, table.where("vec_id % 100 = 0"), keep=150).toPandas()
    hit = 0
    own = {**dict(enumerate(x)), 1600: x[7]}
    ids, m = np.array(list(own)), np.array(list(own.values()))
    queries = [i for i in own if i % 100 == 0]
    for q in queries:
        d = np.sqrt(((m - own[q]) ** 2).sum(1))
        want = [int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        hit += len({*want} & {*mine.vec_id})
        assert list(mine["rank"]) == list(range(1, 11)) and np.allclose(mine.score, np.sqrt(((np.array([own[i] for i in mine.vec_id]) - own[q]) ** 2).sum(1)))
    assert hit >= 0.9 * 10 * len(queries)
    assert ann.search(table.where("vec_id > 5000"), table).count() == 0


def nearest(rows, queries, k=10):
    """(query, rank, id, score) by brute force; rows: (id, vector)."""
    out, rows = [], {(i, tuple(map(float, v))) for i, v in rows}
    for q in sorted({i for i, _ in queries}):
        best = {}
        for i, v in rows:
            for j, w in rows:
                if j == q and i != q and len(v) == len(w):
                    best[i] = min(best.get(i, math.inf), math.sqrt(sum((a - b) * (a - b) for a, b in zip(v, w))))
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k])]
    return out


def test_search_repeated_rows_hot_vectors_and_magnitudes(spark):
    """Rows repeated, a vector that most ids share, ids with two vectors, vectors of 1e20, two dimensions: all as by brute force."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(i, [1.0, 0.0, 0.0, 0.5]) for i in range(100, 220)]
    rows += [rows[0]] * 3 + [(100, [0.5, 0.5, 0.5, 0.5]), (5, [9.0, 9.0, 9.0, 9.0])]
    rows += [(300 + i, (rng.normal(size=4) * 1e20).tolist()) for i in range(20)] + [(400 + i, rng.normal(size=3).tolist()) for i in range(5)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, query_id int")
    got = ann.search(table, table.where("vec_id % 100 = 0")).collect()
    want = nearest(rows, [r for r in rows if r[0] % 100 == 0])
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [r[:3] for r in want]
    assert np.allclose(sorted(r["score"] for r in got), sorted(r[3] for r in want))


def test_search_gives_few_rows_a_lane(spark, monkeypatch):
    """Of many blocks too the nearest are found, a lane gives no more of them than stand in the answer; scores are exact."""
    rng = np.random.default_rng(3)
    for width, n in ((40, 5), (1000, 3), (1000, 29), (1000, 40), (1000, 1000)):
        d = rng.integers(0, 50, size=(6, width)).astype(float)
        d[0, 10:], d[1] = np.inf, np.inf
        for row, at in zip(d, ann.smallest(d, n)):
            assert list(at) == list(np.argsort(row, kind="stable")[:n])
    monkeypatch.setattr(ann, "CODE_BLOCK", 8 * 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 8 * 5)
    given, keep = {}, ann.save
    monkeypatch.setattr(ann, "save", lambda df, label: given.setdefault(label, keep(df, label)))
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1300, 8)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(table, table.where("vec_id % 100 = 0"))
    want = nearest(rows, [r for r in rows if r[0] % 100 == 0])
    found = sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"]))
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found] == [w[:3] for w in want]
    x = dict(rows)
    for r in found:  # squares added one after another, as sum() of floats does not
        gap = 0.0
        for a, b in zip(x[r["vec_id"]], x[r["query_id"]]):
            gap += (a - b) * (a - b)
        assert r["score"] == math.sqrt(gap)
    assert given["codes"].count() > 8 and given["nearest-vectors"].groupBy("query_id").count().agg({"count": "max"}).first()[0] <= 8 * 11
