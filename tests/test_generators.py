"""Generated operators read back, and evaluated as plain loops would; exact values where doubles are not; whole records by hand."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import language as L
from quillon.operators import evaluation, expressions, generation
from quillon.plans import fixtures as X
from quillon.plans import queries as Q


def plain_loop(loop, env, bodies):
    """A loop step by step, with no step taken at once."""
    n = env[loop.over]
    if n != n or math.isinf(n) or loop.limit and abs(n) > loop.limit:
        return math.nan, 1
    r, spent = loop.start.value if isinstance(loop.start, L.Num) else env[loop.start.name], 0
    for _ in range(abs(n)):
        t, c = L.evaluate(loop.callee, tuple(r if x == "r" else env[x] for x in loop.args), bodies)
        t = math.inf if t == t and abs(t) > L.CLAMP else t
        r, spent = (t if n > 0 else -t), spent + c
    return r, max(1, spent)


def test_generated_loops_read_back_and_agree_with_plain_loops(spark):
    keys = spark.range(300).select(F.col("id").alias("key"), F.lit("⊛").alias("symbol"), (F.col("id") % 2 + 2).cast("int").alias("n_order"))
    rows = generation.recursive_operators(keys, Q.cat(spark, [Q.POSTFIX])).collect()
    assert len(rows) == 300 and {r["callee"] for r in rows} >= {"b1", "q1", "l1", "l2", "p1"}
    random.seed(1)
    for r in rows:
        func_id, params, loop = L.read_source(r["op_compute_func"])
        assert func_id == r["func_id"] and params == ("a", "b") and loop.callee == r["callee"] and r["dependencies"] == [loop.callee]
        assert (loop.limit == 1_000_000) == (r["n_order"] == 3) and f"if {loop.over} == 0" in r["definition"]
        compile(r["op_count_func"], "count", "exec")
        for _ in range(3):
            env = {"a": random.choice([-5, -1, 0, 1, 2, 7, 40]), "b": random.choice([-6, -2, 0, 1, 3, 12])}
            want, got = plain_loop(loop, env, Q.BODIES), L.evaluate(func_id, (env["a"], env["b"]), Q.BODIES | {func_id: (params, loop)})
            assert evaluation.spelled(got[0]) == evaluation.spelled(want[0]) and got[1] == want[1]


def test_no_operator_of_the_order_below_is_an_error(spark):
    keys = spark.range(1).select(F.col("id").alias("key"), F.lit(5).alias("n_order"))
    with pytest.raises(Exception, match="no operator of order 4"):
        generation.callees(Q.cat(spark), keys).collect()


def test_loops_of_any_length():
    assert L.evaluate("l1", (1, 3_000_000_000), X.BODIES) == (math.inf, 3_000_000_000)
    assert L.evaluate("l1", (-5, 10**18), X.BODIES) == (-math.inf, 10**18) or L.evaluate("l1", (-5, 10**18), X.BODIES)[0] == math.inf
    assert L.evaluate("l1", (5, -(10**15)), X.BODIES)[1] == 10**15
    assert L.evaluate("l2", (50000, 10**12), X.BODIES)[0] == math.inf


@pytest.mark.parametrize("func_id", ["p1", "m1", "t1", "d1", "r1", "s1", "b1", "l1", "l2"])
def test_any_magnitude_and_nulls(spark, func_id):
    random.seed(7)
    values = [0, 1, -1, 7, -13, 94906267, 2**31, 3_000_000_000, 10**19, -(2**60), None]
    pairs = [(random.choice(values), random.choice(values)) for _ in range(80)]
    text = lambda v: None if v is None else str(v)
    rows = spark.createDataFrame([(text(a), text(b), 1) for a, b in pairs], "a string, b string, value int").withColumn("a", F.col("a").cast("decimal(38,0)")).withColumn("b", F.col("b").cast("decimal(38,0)"))
    n = 1 if func_id == "b1" else 2
    for r in evaluation.apply_operator(rows, func_id, X.BODIES, *[F.col(c) for c in "ab"[:n]]).collect():
        args = [r[c] for c in "ab"[:n]]
        if None in args:
            assert r["value"] is None and r["cost"] is None
        else:
            v, c = L.evaluate(func_id, tuple(map(int, args)), X.BODIES)
            assert (r["value"], r["cost"]) == (evaluation.spelled(v), min(c, 2**63 - 1))


def tree(spark, *nodes):
    rows = [(k, k // 2 or None, None, k.bit_length() - 1, "", kind, f, v) for k, kind, f, v in nodes]
    return spark.createDataFrame([(1, rows)], f"expr_id long, nodes array<struct<{expressions.NODE.replace(' ', ':').replace(',:', ',')}>>")


def test_a_record_by_hand(spark):
    nodes = ((1, "binary", "t1", None), (2, "binary", "p1", None), (3, "num", None, 3), (4, "num", None, 1), (5, "num", None, 255))
    r = expressions.records(tree(spark, *nodes), Q.cat(spark), X.BODIES, base=16, result_base=2, longer_base=10).first()
    assert r["expression"] == "(⊠1+⊠FF)*⊠3" and r["expression_no_base_symbol"] == "($1$+$255$)*$3$" and r["text"] == "(⊠1+⊠FF)*⊠3=⊞1100000000"
    assert r["used_operators"] == ["t1", "p1"] and [tuple(c) for c in r["cot"]] == [("1+255=256", 1), ("256*3=768", 0)] and not r["longer_result_info"]["flag"]
    assert [c["info"] for c in r["cot_info"]][:2] == ["number node, value=1", "number node, value=255"] and len(r["cot_info"]) == 5
    assert json.loads(r["tree"])["l"]["op"] == "p1" and r["normalized_expansion_degree"] == "2" and r["complexity_ratio"] == 1.0


def test_special_values_in_records(spark):
    nodes = ((1, "binary", "p1", None), (2, "binary", "r1", None), (3, "binary", "l2", None), (4, "num", None, 7), (5, "num", None, 0), (6, "num", None, 50000), (7, "num", None, 1))
    r = expressions.records(tree(spark, *nodes), Q.cat(spark), X.BODIES).first()
    assert r["result"] == "NaN" and [c["info"] for c in r["cot"]] == ["7%0=nan", "50000⤊1=inf", "nan+inf=nan"] and r["highest_n_order"] == 2 and not r["longer_result_info"]["flag"]


def test_trees_with_loops_are_whole(spark):
    rows = Q.QUERIES["eval_tree_loops"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 1500 and {r["highest_n_order"] for r in rows} == {1, 2, 3} and all(r["text"].count("=") == 1 for r in rows)


def test_accepted_are_sound(spark):
    """What passes parses, uses its arguments and is alone with its body."""
    sf = "/root/testdata/sf0.001"
    got = {r["func_id"] for r in Q.QUERIES["accept_generated"](spark, sf).collect()}
    rows = {r["func_id"]: r["op_compute_func"] for r in Q._compiled(spark, sf).where("ok").collect()}
    assert got and got <= set(rows)
    texts = [rows[f].split("\n", 1)[1] for f in got]
    assert len(set(texts)) == len(texts)
    for f in got:
        _, params, body = L.read_source(rows[f])
        assert set(params) <= L.variables(body)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "expr_id long")
    assert expressions.grow(none, *Q.POOLS).count() == 0
    assert expressions.records(expressions.grow_rows(none, *Q.POOLS), Q.cat(spark), X.BODIES).count() == 0
    with pytest.raises(ValueError):
        expressions.grow(none, (), ())


def test_every_forced_tree_holds_the_target(spark):
    """Whatever the pools: trees of unary operators alone become the target over two numbers."""
    ids = spark.range(50).select(F.col("id").alias("expr_id"))
    for binary, prefix in ((("p1", "t1"), ("b1",)), ((), ("b1",))):
        rows = expressions.force(ids, "l1", binary, prefix).collect()
        assert len(rows) == 50 and all("l1" in [n["func_id"] for n in r["nodes"]] for r in rows)
        assert all((n["kind"] == "num") == (n["func_id"] is None) for r in rows for n in r["nodes"])
    assert expressions.records(expressions.force(ids, "l1", *Q.POOLS), Q.cat(spark, [Q.POSTFIX]), Q.BODIES).where("highest_n_order <> 2").count() == 0
