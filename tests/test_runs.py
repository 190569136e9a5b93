"""Runs against one attempt after the other; the same operators whatever the rounds; continuing, fresh and exhausted runs."""

import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import language as L
from quillon.operators import generation as G
from quillon.operators import runs as R
from quillon.plans import queries as Q


def body(src):
    return src.split("\n", 1)[1]


def rows_of(df):
    return {r["func_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def filled(spark):
    return R.fill(Q.cat(spark, [Q.POSTFIX]), {1: 60, 2: 50, 3: 20}, Q.SYMBOL_POOLS, Q.NAME_POOLS)


def test_a_run_is_one_attempt_after_the_other(spark, filled):
    """By hand: attempts of a layer in order, an attempt taken if it uses its arguments, wraps nothing and its body is new."""
    cat = Q.cat(spark, [Q.POSTFIX])
    got, now = rows_of(filled), cat
    seen = {body(r["op_compute_func"]) for r in cat.where("op_compute_func IS NOT NULL").collect()}
    for layer, size in ((1, 60), (2, 50), (3, 20)):
        missing, want = size - cat.where(F.col("n_order") == layer).count(), []
        keys = spark.range(3000).select((F.col("id") * R.LAYERS + layer).alias("key"))
        drawn = R._rows(R.draw(layer, keys, now, Q.SYMBOL_POOLS, Q.NAME_POOLS)).orderBy("key").collect()
        for r in drawn:
            text = body(r["op_compute_func"])
            words = set(re.findall(r"\w+", text))
            uses = "a" in words and (r["n_ary"] == 1 or "b" in words)
            wraps = re.fullmatch(r"\s*return op_\w+\((a|a, b|b, a|a, a|b, b)\)\s*", text) if r["n_ary"] == 2 else re.fullmatch(r"\s*return op_\w+\(a\)\s*", text)
            if uses and not (wraps and not (r["n_ary"] == 2 and text.strip().endswith("(a)"))) and text not in seen and len(want) < missing:
                seen.add(text)
                want.append(r["func_id"])
        assert len(want) == missing and {f for f, r in got.items() if r["n_order"] == layer} == set(want)
        now = now.unionByName(filled.where(F.col("n_order") == layer))


def test_definitions_say_what_functions_do(spark, filled):
    """A drawn definition, parsed, is the function that was drawn beside it; loops compile and call the layer below."""
    got = rows_of(filled)
    order = {r["func_id"]: r["n_order"] for r in Q.cat(spark, [Q.POSTFIX]).collect()} | {f: r["n_order"] for f, r in got.items()}
    assert len({r["symbol"] for r in got.values()}) == len(got)
    for f, r in got.items():
        if r["n_order"] == 1:
            params, found = L.parse(r["definition"], Q.SYMBOLS | {(r["symbol"], r["unary_position"] or "binary"): f})
            _, again, same = L.read_source(r["op_compute_func"])
            assert (tuple(params), found) == (tuple(again), same)
        compile(r["op_compute_func"], f, "exec")
        assert max(order[d] for d in r["dependencies"]) == r["n_order"] - (r["n_order"] > 1)


def test_rounds_change_nothing(spark, filled, monkeypatch):
    monkeypatch.setattr(R, "LEAST", 16)
    again = R.fill(Q.cat(spark, [Q.POSTFIX]), {1: 60, 2: 50, 3: 20}, Q.SYMBOL_POOLS, Q.NAME_POOLS)
    text = lambda df: {f: (r["n_order"], r["op_compute_func"], r["definition"]) for f, r in rows_of(df).items()}
    assert text(again) == text(filled)


def test_a_full_run_adds_nothing_and_a_stopped_one_goes_on(spark, filled):
    cat = Q.cat(spark, [Q.POSTFIX])
    whole = cat.unionByName(filled)
    assert R.fill(whole, {1: 60, 2: 50, 3: 20}, Q.SYMBOL_POOLS, Q.NAME_POOLS).count() == 0
    stopped = cat.unionByName(filled.where("n_order < 3"))
    assert set(rows_of(R.fill(stopped, {1: 60, 2: 50, 3: 20}, Q.SYMBOL_POOLS, Q.NAME_POOLS))) == set(rows_of(filled.where("n_order = 3")))


def test_an_exhausted_layer_is_an_error(spark):
    """With one unary operator below and few starts, bodies run out."""
    one = Q.cat(spark, [Q.POSTFIX]).where("func_id = 'b1'")
    with pytest.raises(ValueError, match="layer 2: .* no new bodies"):
        R.fill_layer(one, 2, 5000, lambda k, keys, cat: R.draw(k, keys, cat, Q.SYMBOL_POOLS, Q.NAME_POOLS))


def test_simple_operators_of_an_empty_table(spark):
    none = spark.createDataFrame([], "key long, symbol string")
    assert R.simple_operators(none, G.Pools(), G.Pools(binary=("p1", "m1", "t1", "d1", "r1"))).count() == 0
