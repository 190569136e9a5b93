"""Records by folds against the exact interpreter, node by node, near and far."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import expressions, folds
from quillon.plans import queries as Q

SHAPE = f"expr_id long, nodes array<struct<{expressions.NODE.replace(' ', ':').replace(',:', ',')}>>"
ARITY = {f: 2 for f in Q.POOLS[0]} | {f: 1 for pool in Q.POOLS[1:] for f in pool}


def drawn(rng, depth, values):
    nodes = []

    def grow(k, path, side, d):
        func = rng.choice(list(ARITY)) if d < depth and (d == 0 or rng.random() < 0.8) else None
        kind = "num" if func is None else "binary" if ARITY[func] == 2 else rng.choice(["prefix", "postfix"])
        nodes.append((k, k // 2 or None, side, d, path, kind, func, rng.choice(values) if func is None else None))
        if func:
            two = ARITY[func] == 2
            grow(2 * k, path + "l", "left" if two else "unary", d + 1)
            if two:
                grow(2 * k + 1, path + "r", "right", d + 1)

    grow(1, "", None, 0)
    return sorted(nodes)


@pytest.mark.parametrize("values", [(0, 1, -1, 2, 7, 12, 999), (0, -3, 10**6, -(10**9), 2**53 + 1, -(2**62))])
@pytest.mark.parametrize("how", [{}, {"brackets": True, "base": 16, "result_base": 2, "longer_base": 16}])
def test_records_equal_the_interpreters(spark, values, how):
    rng = random.Random(3)
    trees = [(i, drawn(rng, 1 + i % 4, values)) for i in range(160)]
    rows, cat = spark.createDataFrame(trees, SHAPE), Q.tree_operators(spark)
    operators = {r["func_id"]: r.asDict() for r in cat.collect()}
    settings = {"base": 10, "result_base": 10, "longer_base": 10, "brackets": False} | how
    make = expressions.Records(operators, Q.BODIES, **settings)
    names = expressions.NODE.split(", ")
    want = {i: make.of([dict(zip((n.split()[0] for n in names), node)) for node in nodes]) for i, nodes in trees}
    got = expressions.records(rows, cat, Q.BODIES, **how).collect()
    assert len(got) == len(trees)
    for r in got:
        found = r.asDict(recursive=True)
        assert {k: v for k, v in found.items() if k != "id"} == want[found["id"]]


def test_no_python_where_trees_are_near(spark):
    plan = Q.record_table(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_bounds_of_trees(spark):
    operators = {r["func_id"]: r.asDict() for r in Q.tree_operators(spark).collect()}
    assert folds.always_near(operators, Q.BODIES, 1000, 2) and not folds.always_near(operators, Q.BODIES, 1000, 4)
    assert folds.compiles(operators, Q.BODIES) and not folds.compiles(operators | {"l1": {}}, Q.BODIES)


def test_deep_trees_are_planned(spark):
    ids = spark.range(20).select(F.col("id").alias("expr_id"))
    rows = expressions.grow_rows(ids, *Q.POOLS, depth=5)
    assert rows.select(F.max(F.array_max(F.transform("nodes", lambda n: n["depth"])))).first()[0] > 3
    assert expressions.records(rows, Q.tree_operators(spark), Q.BODIES, fields=["id", "result", "text"]).where("result IS NULL OR text IS NULL").count() == 0


def test_calls_are_planned_once(spark):
    """An operator is compiled into a node's step once, not once for each field of its result; near trees carry no bounds."""
    operators = {r["func_id"]: r.asDict() for r in Q.tree_operators(spark).collect()}
    fold, rows = folds.Folds(operators, Q.BODIES, {}), spark.createDataFrame([], SHAPE)
    plan = lambda near: rows.select(fold.evaluated(F.col("nodes"), near).alias("ev")).select("ev")._jdf.queryExecution().optimizedPlan().toString()
    signs = plan(True).count("= s1)")
    assert signs == 1 and "9007199254740992" not in plan(True) and len(plan(True)) < len(plan(False))


def test_a_second_tree_is_grown_in_the_same_projection(spark):
    plan = Q.QUERIES["order_tree_gen"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1
