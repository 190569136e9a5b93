"""Priorities dealt over ranges at once against one operator after the other."""

import hashlib

import numpy as np
import pytest

from quillon.operators import priorities as P
from quillon.plans import fixtures as X

LONG = "func_id string, id long, unary_position string"


def bits(what, key):
    return int(hashlib.md5(f"quillon:{what}:{key}".encode()).hexdigest()[:8], 16)


def one_by_one(rows):
    sides, out = [], {}
    for func_id, _, kind in sorted(rows, key=lambda r: ({"prefix": 0, "postfix": 1, None: 2}[r[2]], r[1], r[0])):
        want = {"prefix": "right", "postfix": "left"}.get(kind)
        open_ = [k for k, s in enumerate(sides, 1) if want in (None, s)] + [len(sides) + 1]
        level = open_[bits("priority", func_id) * len(open_) >> 32]
        if level > len(sides):
            sides.append(want or ("left", "right")[bits("priority/side", func_id) % 2])
        out[func_id] = (level, sides[level - 1])
    return out


@pytest.mark.parametrize("kinds", [(None, "prefix", "postfix"), (None,), ("postfix",), (None, "prefix")])
def test_equal_to_one_by_one(spark, kinds):
    rows = [(f"f{i}", i // 2, kinds[i % len(kinds)]) for i in range(4000)]
    got = P.assign(spark.createDataFrame(rows, LONG).repartition(7))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == one_by_one(rows)


def test_small_and_empty_catalogs(spark):
    one = [("f", 1, "postfix")]
    assert [tuple(r) for r in P.assign(spark.createDataFrame(one, LONG)).collect()] == [("f", 1, "left")]
    assert P.assign(spark.createDataFrame([], LONG)).collect() == []


def test_rules_of_the_fixture(spark):
    found = {r["func_id"]: r for r in P.assign(X.catalog(spark)).collect()}
    assert len(found) == len(X.ROWS)
    assert all(found[r[0]]["side"] == "right" for r in X.ROWS if r[2] == "prefix")
    assert len({r["priority"] for r in found.values()}) == max(r["priority"] for r in found.values()) == len({(r["priority"], r["side"]) for r in found.values()})


@pytest.mark.parametrize("seed", range(5))
def test_drops_say_what_a_run_does(seed):
    draws = np.random.default_rng(seed).integers(0, P.BITS, 300)
    reaches = P.reach(draws)
    half = P.drops(reaches[:150], np.empty(0, dtype=np.int64))
    whole = P.drops(reaches[150:], half)
    for start in range(40):
        n = start
        for x in reaches:
            n += int(x >= n)
        assert n == start + (whole >= start).sum()
    assert all((b * (n + 1) >> 32 == n) == (n <= P.reach(np.array([b]))[0]) for b in map(int, draws) for n in (0, 1, 7))
