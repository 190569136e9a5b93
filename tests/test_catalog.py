import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import catalog as C
from quillon.plans import fixtures as X
from quillon.plans.queries import QUERIES


def test_levels_and_orders(spark):
    cat = X.catalog(spark)
    assert {r["func_id"]: r["level"] for r in C.levels(cat).collect()} == {"p1": 0, "m1": 0, "t1": 0, "d1": 0, "r1": 0, "x2": 0, "x16": 0, "s1": 1, "b1": 1, "l1": 1, "l2": 1, "l3": 2}
    assert {r["func_id"]: r["n_order"] for r in C.orders(cat).collect()} == {r["func_id"]: r["n_order"] for r in X.records() if r["is_base"] is None}


def test_cycle_is_an_error(spark):
    rows = X.records()
    loop = next(r for r in rows if r["func_id"] == "l1")
    cat = X.catalog(spark).where("func_id <> 'l1'").unionByName(X.catalog(spark, [loop | {"dependencies": ["p1", "l3"], "id": 99}]).where("id = 99"))
    with pytest.raises(ValueError, match="cycle"):
        C.levels(cat)


def test_cascade(spark):
    gone = C.closure(X.catalog(spark), spark.createDataFrame([("p1",)], "func_id string"))
    assert {r[0] for r in gone.collect()} == {"p1", "s1", "b1", "l1", "l3"}


def test_adding_twice_is_an_error(spark):
    with pytest.raises(ValueError):
        C.add(X.catalog(spark), X.catalog(spark).where("func_id = 'p1'"))


def test_base_operators_and_layers(spark):
    sizes = QUERIES["layer_sizes"](spark, "").collect()
    assert [r["size"] for r in sorted(sizes)] == [43372, 26023, 15614, 9368, 5623]
    assert QUERIES["symbol_alphabet"](spark, "").count() == 629


def test_a_file_of_functions_is_one_module(spark, tmp_path):
    """The header comes once and first; what is written is valid as a whole."""
    import ast

    from quillon.plans import queries as Q
    from quillon.sources import jsonl

    jsonl.save_sources(Q.cat(spark), f"file://{tmp_path}/functions")
    (part,) = tmp_path.glob("functions/part-*")
    text = part.read_text()
    assert text.startswith("thres = 2147483647\n\n# Operator ID: p1 - op_compute_func\ndef op_p1(a, b):") and text.count("thres =") == 1
    assert sum(isinstance(x, ast.FunctionDef) for x in ast.parse(text).body) == 2 * 10


def graph(spark, edges, n):
    from quillon.schema import OPERATOR

    deps = edges.groupBy(F.col("dst").alias("func_id")).agg(F.collect_list("src").alias("deps"))
    rows = spark.range(n).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("func_id")).join(deps, "func_id", "left")
    return rows.select(*[F.coalesce("deps", F.array().cast("array<string>")).alias("dependencies") if f.name == "dependencies" else F.col("func_id") if f.name == "func_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in OPERATOR.fields])


def named(pairs):
    return pairs.select(F.concat(F.lit("f"), F.col("a").cast("string")).alias("src"), F.concat(F.lit("f"), F.col("b").cast("string")).alias("dst"))


def test_a_chain_of_100000_operators(spark):
    n = 100_000
    cat = graph(spark, named(spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))), n).cache()
    at = C.levels(cat)
    assert at.where("level <> cast(substr(func_id, 2) AS long)").count() == 0 and at.count() == n
    assert C.closure(cat, spark.createDataFrame([("f99000",)], "func_id string")).count() == 1000
    ring = graph(spark, named(spark.range(n).select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b"))), n)
    with pytest.raises(ValueError, match="cycle"):
        C.levels(ring)


@pytest.mark.parametrize("seed", range(2))
def test_levels_and_closure_of_drawn_graphs(spark, seed):
    rng = random.Random(seed)
    n, pairs = 60, set()
    for b in range(1, 60):
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            pairs.add((rng.randrange(max(0, b - 3), b), b))
    want = {}
    for b in range(n):
        want[f"f{b}"] = max((want[f"f{x}"] + 1 for x, y in pairs if y == b), default=0)
    cat = graph(spark, named(spark.createDataFrame(sorted(pairs), "a int, b int")), n)
    assert {r[0]: r[1] for r in C.levels(cat).select("func_id", "level").collect()} == want
    root, below = rng.randrange(20), set()
    todo = [root]
    while todo:
        x = todo.pop()
        if x not in below:
            below.add(x)
            todo += [b for a, b in pairs if a == x]
    assert {r[0] for r in C.closure(cat, spark.createDataFrame([(f"f{root}",)], "func_id string")).collect()} == {f"f{x}" for x in below}
    with pytest.raises(ValueError, match="cycle"):
        C.levels(graph(spark, named(spark.createDataFrame([*sorted(pairs), (59, 0)] + [(k, k + 1) for k in range(59)], "a int, b int")), n))
