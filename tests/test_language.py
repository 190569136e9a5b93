import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import language as L
from quillon.operators.evaluation import apply_exact, apply_operator, spelled
from quillon.plans import fixtures as X

GOLDEN = [
    ("s1", (3, 4), 14, 2), ("b1", (12,), 144, 2), ("b1", (11,), 12, 1), ("l1", (5, 3), 15, 3), ("l1", (5, 0), 0, 1), ("l1", (5, -1), -5, 1), ("l1", (5, -2), 0, 2),
    ("l2", (50000, 1), math.inf, 1), ("l2", (50000, -1), -math.inf, 1), ("l1", (5, math.nan), math.nan, 1), ("l1", (5, math.inf), math.nan, 1), ("l3", (2, 2), 4, 4),
    ("l3", (0, 1_000_001), math.nan, 1), ("r1", (7, 0), math.nan, 1), ("d1", (-7, 2), -4, 1), ("r1", (-7, 3), 2, 1), ("r1", (7, -3), -2, 1),
]


@pytest.mark.parametrize("func,args,value,cost", GOLDEN)
def test_golden_values_by_interpreter(func, args, value, cost):
    v, c = L.evaluate(func, args, X.BODIES)
    assert spelled(v) == spelled(value) and c == cost


def test_golden_values_compiled(spark):
    for func in sorted({g[0] for g in GOLDEN}):
        mine = [g for g in GOLDEN if g[0] == func]
        rows = spark.createDataFrame([(float(g[1][0]), float(g[1][-1]), spelled(g[2]), g[3]) for g in mine], "a double, b double, want string, want_cost long")
        args = (F.col("a"),) if len(mine[0][1]) == 1 else (F.col("a"), F.col("b"))
        for r in apply_operator(rows, func, X.BODIES, *args).collect():
            assert (r["value"], r["cost"]) == (r["want"], r["want_cost"]), (func, r)


def test_compiled_agrees_with_interpreter(spark):
    rows = spark.range(-40, 40).selectExpr("id AS a", "pmod(id * 7, 11) - 5 AS b")
    for func in ("p1", "m1", "t1", "d1", "r1", "s1", "l1", "l2"):
        got = {(r["a"], r["b"]): (r["value"], r["cost"]) for r in apply_operator(rows, func, X.BODIES, F.col("a"), F.col("b")).collect()}
        for (a, b), (value, cost) in got.items():
            v, c = L.evaluate(func, (a, b), X.BODIES)
            assert (spelled(v), c) == (value, cost), (func, a, b)


def test_exact_integers_beyond_doubles(spark):
    rows = spark.createDataFrame([(str(3**60), str(3**50))], "a string, b string")
    assert apply_exact(rows, "t1", X.BODIES, "a", "b").first()["value"] == str(3**110)


@pytest.mark.parametrize("text", ["a⊕b = { (a+ }", "a⊕b", "a⊕b = { a , else ; b , if a > 1 }", "a⊕b = { a ? b }"])
def test_malformed_definitions_are_rejected(text):
    with pytest.raises(L.DefinitionError):
        L.parse(text, X.SYMBOLS)


def test_print_parse_round_trip():
    for f, head in (("s1", "a⊕b"), ("b1", "∇a")):
        assert L.parse(f"{head} = {{ {L.show(X.BODIES[f][1], X.SHAPES)} }}", X.SYMBOLS) == X.BODIES[f]


def test_compiling_is_one_call_a_row_over_all_cores(spark):
    """A filter on what a definition compiles to doesn't compile it again, and acceptance has one such plan, dealt out first."""
    from quillon.plans.queries import QUERIES

    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan("accept_generated").count("ArrowEvalPython") == 2
    for name, times in (("definition_parse", 1), ("decompile", 1), ("decompile_flat", 1), ("definition_roundtrip", 2)):
        assert plan(name).count("ArrowEvalPython") == times and plan(name).count("Exchange RoundRobinPartitioning") == 1


def test_a_failure_is_no_round_trip(spark, monkeypatch):
    """Definitions that are null or cannot be read aren't the same as what they were, and errors that aren't theirs end the job."""
    from pyspark.errors import PythonException

    from quillon.operators import generation
    from quillon.plans import queries as Q

    rows = spark.createDataFrame([("d1", "a⊛b = { (a+b) }"), ("d2", "a⊛b = { (a+ }"), ("d3", "a⊛b = { a ? b }"), ("d4", None), ("d5", "no definition")], "func_id string, definition string")
    monkeypatch.setattr(Q, "_generated", lambda *_: rows)
    assert {r["func_id"]: r["same"] for r in Q.QUERIES["definition_roundtrip"](spark, None).collect()} == {"d1": True, "d2": False, "d3": False, "d4": False, "d5": False}
    got = {r["func_id"]: (r["ok"], r["op_compute_func"] is None, r["again"] is None) for r in generation.compiled(rows, Q.SYMBOLS, Q.SHAPES, ["ok", "op_compute_func", "again"]).collect()}
    assert got == {"d1": (True, False, False)} | dict.fromkeys(("d2", "d3", "d4", "d5"), (False, True, True))
    with pytest.raises(PythonException, match="TypeError"):
        generation.compiled(rows.where("func_id = 'd1'"), Q.SYMBOLS, Q.SHAPES | {"p1": None}, ["ok", "again"]).collect()
