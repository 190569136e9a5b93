"""Operators over operand columns: compiled where doubles are exact, interpreted with unbounded integers where not."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import INF, NAN, NEG_INF
from ..functions import vectors
from ..functions.bases import value_text
from ..functions.compiler import Compiler, once, within
from ..functions.language import evaluate, loops

#: Results that a task remembers, by their operands.
REMEMBERED = 100_000


def spelled(v) -> str:
    return NAN if v != v else INF if v == float("inf") else NEG_INF if v == float("-inf") else str(int(v))


def number(text: str):
    """An operand from its text: a whole number (a double's fraction is cut off), or a special value."""
    x = Decimal(text)
    return float(x) if x.is_nan() or x.is_infinite() else int(x)


def apply_operators(rows: DataFrame, calls: dict[str, str], bodies: dict, *operands: Column) -> DataFrame:
    """rows with a column (value, cost) for each name of calls, which maps names to func_ids. Operands are whole numbers; a null one gives null and null.

    All calls are one projection over one scan. Calls whose operands could lead to a magnitude past 2**53 are the exact
    interpreter's: one function for all of them, which is handed nulls where none is needed. Loops are that function's throughout.
    """
    args, texts = [o.cast("double") for o in operands], [o.cast("string") for o in operands]
    there, kept = F.greatest(F.lit(0), *[o.isNull().cast("int") for o in operands]) == 0, [c for c in rows.columns if c not in calls]
    size, far, near = F.greatest(F.lit(0.0), *[F.abs(o) for o in args]), {}, {}
    for name, f in calls.items():
        if loops(f, bodies):
            far[name] = there
        else:
            far[name] = there & F.coalesce(size > float(within(f, bodies)), F.lit(False))
            near[name] = Compiler(bodies).both(f, *args)
    which = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(far.values())), F.lit(0))
    vast = F.coalesce(size >= vectors.EXACT, F.lit(False))
    exact = exactly(list(calls.values()), bodies)(F.nullif(which, F.lit(0)), *[F.when(which > 0, x) for x in args], *[F.when((which > 0) & vast, t) for t in texts])
    found = rows.withColumn("__far", exact)
    answer = lambda v, c: F.struct(v.alias("value"), c.alias("cost"))

    def of(k: int, name: str) -> Column:
        slow = answer(F.col(f"__far.v{k}"), F.col(f"__far.c{k}"))
        if name not in near:
            return slow
        quick = once(near[name], lambda s: answer(value_text(s["v"]), s["c"]))
        return F.when(far[name], slow).when(there, quick).otherwise(answer(F.lit(None).cast("string"), F.lit(None).cast("long")))

    return found.select(*kept, *[of(k, name).alias(name) for k, name in enumerate(calls)])


def apply_operator(rows: DataFrame, func_id: str, bodies: dict, *operands: Column) -> DataFrame:
    """rows with value (text) and cost of one operator, which replace columns of these names."""
    kept = [c for c in rows.columns if c not in ("value", "cost")]
    return apply_operators(rows, {"__r": func_id}, bodies, *operands).select(*kept, "__r.value", "__r.cost")


def exactly(func_ids: list[str], bodies: dict):
    """A function of (which, operands as doubles, those that doubles don't hold as text): which has a bit for each operator that is wanted.

    Batches go through numpy (vectors.evaluate); the interpreter has what is beyond it. A cost stays at the largest long.
    """
    seen: dict = {}
    kind = ", ".join(f"v{k} string, c{k} long" for k in range(len(func_ids)))

    def one(k: int, row: tuple):
        if (k, row) not in seen:
            if len(seen) >= REMEMBERED:
                seen.clear()
            v, c = evaluate(func_ids[k], row, bodies)
            seen[k, row] = spelled(v), min(c, (1 << 63) - 1)
        return seen[k, row]

    @F.arrow_udf(kind)
    def run(which: pa.Array, *columns: pa.Array) -> pa.Array:
        wanted, half, out = pc.fill_null(which, 0).to_numpy(zero_copy_only=False), len(columns) // 2, []
        args, texts = [np.trunc(x.to_numpy(zero_copy_only=False)) for x in columns[:half]], columns[half:]
        whole = lambda i: tuple(number(t[i].as_py()) if t[i].is_valid else float(x[i]) if np.isnan(x[i]) or np.isinf(x[i]) else int(x[i]) for x, t in zip(args, texts))
        for k, f in enumerate(func_ids):
            at = np.flatnonzero(wanted >> k & 1)
            value, cost, far = vectors.evaluate(f, tuple(x[at] for x in args), bodies)
            text, there = _texts(value), np.full(len(wanted), -1, dtype=np.int64)
            there[at] = np.arange(len(at))
            if far.any():
                rest = np.flatnonzero(far)
                found = [one(k, whole(at[i])) for i in rest]
                cost[rest] = [c for _, c in found]
                text = pc.replace_with_mask(text, pa.array(far), pa.array([v for v, _ in found], pa.string()))
            place = pa.array(there, mask=there < 0)
            out += [text.take(place), pa.array(cost).take(place)]
        return pa.StructArray.from_arrays(out, names=[f"{x}{k}" for k in range(len(func_ids)) for x in "vc"])

    return run.asNondeterministic()


def _texts(v: np.ndarray) -> pa.Array:
    """spelled() of doubles; of no matter beyond what they hold exactly."""
    finite = np.isfinite(v) & (np.abs(v) < vectors.EXACT)
    out = pc.cast(pa.array(np.where(finite, v, 0.0).astype(np.int64)), pa.string())
    if not finite.all():
        out = pc.replace_with_mask(out, pa.array(~finite), pa.array([spelled(x) for x in v[~finite].tolist()], pa.string()))
    return out


def apply_exact(rows: DataFrame, func_id: str, bodies: dict, *operands: Column | str) -> DataFrame:
    """The same by the interpreter, in Arrow batches, for operands and results of any size (numbers or their text). A cost stays at the largest long."""
    seen: dict = {}

    def one(row):
        if any(v is None or v != v for v in row):
            return None, None
        if row not in seen:
            if len(seen) >= REMEMBERED:
                seen.clear()
            v, c = evaluate(func_id, tuple(map(number, row)), bodies)
            seen[row] = spelled(v), min(c, (1 << 63) - 1)
        return seen[row]

    @F.pandas_udf("value string, cost long")
    def run(*columns: pd.Series) -> pd.DataFrame:
        found = [one(row) for row in zip(*columns)]
        return pd.DataFrame({"value": pd.Series([v for v, _ in found], dtype=object), "cost": pd.array([c for _, c in found], dtype="Int64")})

    kept = [c for c in rows.columns if c not in ("value", "cost")]
    texts = [(F.col(o) if isinstance(o, str) else o).cast("string") for o in operands]
    return rows.withColumn("__r", run(*texts)).select(*kept, "__r.value", "__r.cost")
