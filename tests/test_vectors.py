"""Batches of operands in numpy against the exact interpreter."""

import math

import numpy as np
import pytest

from quillon.functions import language as L
from quillon.functions import vectors
from quillon.operators import generation
from quillon.plans import fixtures as X
from quillon.plans.queries import BODIES

LOOPS = {f"{c}{''.join(p)}{over}": (("a", "b"), L.Loop(c, start, p, limit, over)) for c in (*X.PRIMITIVES, "s1", "l1") for p in generation.PATTERNS for over, start, limit in (("b", L.Var("a"), None), ("a", L.Num(3), 50))}
BODIES = BODIES | LOOPS
NUMBERS = (0, 1, -1, 2, -3, 7, 12, 40, -41, 999, 65_536, -70_001, 2**31 - 1, 2**31, -(2**31), 2**40, 2**53, -(2**53), math.nan, math.inf, -math.inf)


@pytest.mark.parametrize("name", sorted(BODIES))
def test_batches_equal_the_interpreter(name):
    two = isinstance(BODIES[name], str) or len(BODIES[name][0]) == 2
    pairs = [(a, b) for a in NUMBERS for b in NUMBERS if abs(b) < 2000 or b != b or math.isinf(b) or name not in LOOPS and name[0] != "l"]
    rows = [(a, b) for a, b in pairs if name not in LOOPS or name[-1] == "b" or a != a or math.isinf(a) or abs(a) < 2000] if two else [(a,) for a in NUMBERS]
    value, cost, far = vectors.evaluate(name, tuple(np.array(x, dtype=float) for x in zip(*rows)), BODIES)
    assert far.mean() < 0.9
    for row, v, c, f in zip(rows, value.tolist(), cost.tolist(), far):
        if not f:
            want = L.evaluate(name, row, BODIES)
            assert (v == want[0] or v != v and want[0] != want[0]) and c == want[1], (row, v, c, want)


def test_loop_arguments_are_one_function(spark):
    from quillon.plans.queries import QUERIES

    plan = QUERIES["loop_args"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("BatchEvalPython") == 1


def test_operands_just_past_doubles_are_exact(spark):
    from quillon.operators.evaluation import apply_operators

    rows = spark.createDataFrame([(2**53 + 1, 1), (2**53, 3), (5, 3), (None, 2), (2**62 + 1, 0)], "a long, b long")
    got = apply_operators(rows, {"m": "m1", "l": "l1", "s": "l2"}, BODIES, rows.a, rows.b).select("a", "b", "m.value", "l.value", "s.value").collect()
    for a, b, *values in got:
        for f, v in zip(("m1", "l1", "l2"), values):
            want = None if a is None else L.evaluate(f, (a, b), BODIES)[0]
            assert v == (None if a is None else "Inf" if want == math.inf else str(want))
