"""Expression trees: grown as one array of nodes a row, and made into full records.

Growing is one projection of draws, and records are folds over the nodes (see folds). Integers without bounds and loops, which columns do not
have, are the exact interpreter's, in Arrow batches of the trees that need it. Nothing is shuffled.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, DIGITS, INF, NAN, NEG_INF, Settings
from ..functions import draws
from ..functions.compiler import once
from ..functions.language import evaluate
from ..schema import EXPRESSION
from . import folds
from .folds import INFO_BINARY, INFO_NUMBER, INFO_UNARY

NODE = "node_id int, parent_id int, side string, depth int, path string, kind string, func_id string, value long"


def spread(ids: DataFrame) -> DataFrame:
    """ids dealt to all cores: a row of a few bytes becomes a tree, so what is shuffled is small beside what is made."""
    spark = ids.sparkSession
    return ids.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def grow_rows(ids: DataFrame, binary: Sequence[str], prefix: Sequence[str], postfix: Sequence[str] = (), depth: int = 2, settings: Settings = DEFAULT, attempt: int = 0, name: str = "nodes") -> DataFrame:
    """ids (expr_id, ...) with a random tree for each expr_id as name, see grown."""
    others = [c for c in ids.columns if c != "expr_id"]
    rows = spread(ids).select(F.col("expr_id").cast("long").alias("expr_id"), *others)
    return rows.withColumn(name, grown(F.col("expr_id"), binary, prefix, postfix, depth, settings, attempt))


def grown(expr_id: Column, binary: Sequence[str], prefix: Sequence[str], postfix: Sequence[str] = (), depth: int = 2, settings: Settings = DEFAULT, attempt: int = 0) -> Column:
    """A random tree for an expr_id: its nodes (see NODE) by level. Attempts give different trees.

    Nodes are numbered as in a heap; roots are operators, nodes at the last depth numbers. Every
    draw hangs on (expr_id, node_id), and a level is an array made of the one above, so a tree is a projection whose size grows with the
    depth and not with the nodes. An empty pool is never drawn from; three empty ones are an error.
    """
    pools = {k: F.array(*[F.lit(x) for x in v]) for k, v in (("binary", binary), ("prefix", prefix), ("postfix", postfix)) if v}
    if not pools:
        raise ValueError("no operators to draw from")
    weights = {k: settings.node_weights[k] for k in pools}

    def drawn(node: Column, parent: Column | None, side: Column, path: Column, d: Column | None = None) -> Column:
        def made(key: Column) -> Column:
            kind = once(draws.unit(key, "kind"), lambda u: draws.weighted(u, {k: w for k, w in (weights | ({} if d is None else {"num": 0.3})).items() if w}))
            kind = kind if d is None else F.when(d == depth, "num").otherwise(kind)

            def of(kind: Column) -> Column:
                func = None
                for k, pool in pools.items():
                    one = F.get(pool, F.pmod(draws.bits(key, "func"), F.size(pool)).cast("int"))
                    func = F.when(kind == k, one) if func is None else func.when(kind == k, one)
                return F.struct(
                    node.cast("int").alias("node_id"), (F.lit(None) if parent is None else parent["node_id"]).cast("int").alias("parent_id"), side.alias("side"), (F.lit(0) if d is None else d).alias("depth"), path.alias("path"), kind.alias("kind"), func.alias("func_id"),
                    F.when(kind == "num", draws.skewed(key, "value", *settings.value_range)).cast("long").alias("value"),
                )

            return once(kind, of)

        return once(F.concat_ws("/", expr_id.cast("string"), node.cast("string"), *[F.lit(str(attempt))] * bool(attempt)), made)

    def children(d: Column):
        return lambda p: both_of(p, p["kind"] == "binary", d)

    def both_of(p: Column, two: Column, d: Column) -> Column:
        left = drawn(p["node_id"] * 2, p, F.when(two, "left").otherwise("unary"), F.concat(p["path"], F.lit("l")), d)
        right = drawn(p["node_id"] * 2 + 1, p, F.lit("right"), F.concat(p["path"], F.lit("r")), d)
        return F.when(two, F.array(left, right)).otherwise(F.array(left))

    # One fold over the depths, the state being the last level and all of them: the plan is the same for any depth.
    root = F.array(drawn(F.lit(1), None, F.lit(None).cast("string"), F.lit("")))
    kind = f"array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>"

    def below(s: Column, d: Column) -> Column:
        new = F.flatten(F.transform(F.filter(s["level"], lambda p: p["kind"] != "num"), children(d)))
        return once(new, lambda x: F.struct(x.alias("level"), F.concat(s["nodes"], x).alias("nodes")).cast(f"struct<level:{kind},nodes:{kind}>"))

    start = once(root, lambda r: F.struct(r.alias("level"), r.alias("nodes")).cast(f"struct<level:{kind},nodes:{kind}>"))
    depths = F.sequence(F.lit(1), F.lit(depth)) if depth else F.array().cast("array<int>")
    return F.aggregate(depths, start, below)["nodes"]


def single(func: Column, arity: Column, key: Column, settings: Settings = DEFAULT) -> Column:
    """The nodes of one operator over drawn numbers."""
    none = F.lit(None)

    def node(k: int, side, path: str, kind: Column, func_id: Column, value: Column) -> Column:
        return F.struct(F.lit(k).alias("node_id"), F.lit(None if k == 1 else 1).cast("int").alias("parent_id"), F.lit(side).cast("string").alias("side"), F.lit(int(k > 1)).alias("depth"), F.lit(path).alias("path"), kind.alias("kind"), func_id.alias("func_id"), value.cast("long").alias("value"))

    number = lambda k, side, path, what: node(k, side, path, F.lit("num"), none.cast("string"), draws.skewed(key, what, *settings.value_range))
    root = node(1, None, "", F.when(arity == 2, "binary").otherwise("unary"), func, none)
    return F.when(arity == 2, F.array(root, number(2, "left", "l", "left"), number(3, "right", "r", "right"))).otherwise(F.array(root, number(2, "unary", "l", "left")))


#: Trees drawn for an expression before it becomes the target alone.
ATTEMPTS = 2


def force(ids: DataFrame, target: str, binary: Sequence[str], prefix: Sequence[str], postfix: Sequence[str] = (), depth: int = 2, settings: Settings = DEFAULT) -> DataFrame:
    """(expr_id, nodes): trees that hold the binary operator target, for corpora of its order.

    The first tree drawn that has a binary operator is taken, and its topmost one becomes the target wherever it stands. Where
    ATTEMPTS trees have none, the expression is the target over two numbers. No expression is left out.
    """
    binary_node = lambda n: n["kind"] == "binary"
    key = F.col("expr_id")

    def taken(t: int) -> Column:
        """The first tree from attempt t on that will do; a later one is grown only where none before does."""
        if t == ATTEMPTS:
            return single(F.lit(target), F.lit(2), key, settings).cast(f"array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>")
        return once(grown(key, binary, prefix, postfix, depth, settings, t), lambda nodes: F.when(F.exists(nodes, binary_node), nodes).otherwise(taken(t + 1)))

    def forced(nodes: Column) -> Column:
        top = F.get(F.filter(nodes, binary_node), F.lit(0))["func_id"]
        return once(top, lambda old: F.transform(nodes, lambda n: F.when(n["func_id"] == old, n.withField("func_id", F.lit(target))).otherwise(n)))

    return spread(ids).select(key.cast("long").alias("expr_id")).select("expr_id", once(taken(0), forced).alias("nodes"))


def grow(ids: DataFrame, binary: Sequence[str], prefix: Sequence[str], postfix: Sequence[str] = (), depth: int = 2, settings: Settings = DEFAULT) -> DataFrame:
    """(expr_id, node_id, parent_id, side, depth, path, kind, func_id, value): a row for each node."""
    return grow_rows(ids, binary, prefix, postfix, depth, settings).select("expr_id", F.explode("nodes").alias("n")).select("expr_id", "n.*")


def to_base(n: int, base: int) -> str:
    out, left = "", abs(n)
    while left or not out:
        out, left = DIGITS[left % base] + out, left // base
    return "-" + out if n < 0 else out


class Records:
    """Turns a tree into its record. operators: catalog rows as dicts by func_id; bodies: what language.evaluate takes."""

    def __init__(self, operators: dict, bodies: dict, base: int, result_base: int, longer_base: int, brackets: bool):
        self.operators, self.bodies, self.base, self.result_base, self.longer_base, self.brackets = operators, bodies, base, result_base, longer_base, brackets
        self.signs = {r["is_base"]: r["symbol"] for r in sorted(operators.values(), key=lambda r: -(r["id"] or 0)) if r["is_base"] is not None}

    def digits(self, n: int, base: int) -> str:
        """A number behind its base's symbol; plain decimal where the catalog has none."""
        return self.signs[base] + to_base(n, base) if base in self.signs else str(n)

    def spelled(self, v, base: int, lower: bool = False) -> str:
        out = NAN if v != v else (INF if v > 0 else NEG_INF) if isinstance(v, float) and math.isinf(v) else None
        return self.digits(int(v), base) if out is None else out.lower() if lower else out

    def of(self, nodes: list) -> dict:
        at, cot, info, used = {n["node_id"]: n for n in nodes}, [], [], []
        orders, priorities, longer = [0], set(), False

        def text(child: dict, op: dict, side: str, name: str) -> str:
            own = child["op"]
            if self.brackets or own is None or own["n_ary"] == 1:
                return child[name]
            away = {"left": op["associativity_direction"] == "right", "right": op["associativity_direction"] == "left", "unary": False}[side]
            needed = op["priority"] is not None and (own["priority"] < op["priority"] or own["priority"] == op["priority"] and away)
            return f"({child[name]})" if needed else child[name]

        def size(v) -> float:
            return math.nan if isinstance(v, float) else len(to_base(int(v), self.longer_base))

        def walk(k: int) -> dict:
            nonlocal longer
            n = at[k]
            if n["kind"] == "num":
                v = int(n["value"])
                info.append({"info": INFO_NUMBER.format(value=v), "layer": n["depth"]})
                return {"v": v, "degree": 0, "op": None, "text": self.digits(v, self.base), "no_base": f"${v}$", "json": {"type": "numeric_atoms", "value": v}}
            op = self.operators[n["func_id"]]
            used.append(op["func_id"])
            orders.append(op["n_order"] or 0)
            priorities.add(op["priority"])
            l = walk(2 * k)
            r = walk(2 * k + 1) if op["n_ary"] == 2 else None
            kids = [l] if r is None else [l, r]
            v, cost = evaluate(op["func_id"], tuple(x["v"] for x in kids), self.bodies)
            v = v if isinstance(v, float) and (v != v or math.isinf(v)) else int(v)
            longer = longer or all(size(v) > size(x["v"]) for x in kids)
            show = lambda x: self.spelled(x, self.longer_base, True)
            if r is None:
                postfix = op["unary_position"] == "postfix"
                info.append({"info": INFO_UNARY.format(left=l["v"], op=op["func_id"], definition=op["definition"], value=v), "layer": n["depth"]})
                cot.append({"info": (show(l["v"]) + op["symbol"] if postfix else op["symbol"] + show(l["v"])) + "=" + show(v), "layer": n["depth"]})
                written = {x: f"({text(l, op, 'unary', x)}{op['symbol']})" if postfix else f"({op['symbol']}{text(l, op, 'unary', x)})" for x in ("text", "no_base")}
                tree = {"type": "unary", "op": op["func_id"], "l": l["json"]}
            else:
                info.append({"info": INFO_BINARY.format(left=l["v"], right=r["v"], op=op["func_id"], definition=op["definition"], value=v), "layer": n["depth"]})
                cot.append({"info": show(l["v"]) + op["symbol"] + show(r["v"]) + "=" + show(v), "layer": n["depth"]})
                written = {x: text(l, op, "left", x) + op["symbol"] + text(r, op, "right", x) for x in ("text", "no_base")}
                if self.brackets:
                    written = {x: f"({y})" for x, y in written.items()}
                tree = {"type": "binary", "op": op["func_id"], "l": l["json"], "r": r["json"]}
            return {"v": v, "degree": cost + sum(x["degree"] for x in kids), "op": op, "json": tree, **written}

        root = walk(1)
        first = list(dict.fromkeys(used))
        result, ops = self.spelled(root["v"], self.result_base), len(used)
        return {
            "expression_no_base_symbol": root["no_base"], "expression": root["text"], "highest_n_order": max(orders), "priority_hierarchical_complexity": len(priorities), "normalized_expansion_degree": str(root["degree"]), "operation_count": ops,
            "complexity_ratio": round(root["degree"] / ops, 6) if ops else 0.0, "tree": json.dumps(root["json"], separators=(",", ":")), "used_operators": first, "dependent_operators": [d for f in first for d in self.operators[f]["dependencies"] or []], "result": result,
            "longer_result_info": {"target_base": self.longer_base, "flag": longer}, "cot_info": info, "base": self.base, "result_base": self.result_base, "text": f"{root['text']}={result}", "cot": cot,
        }


#: Operators of a catalog that go to every task; a generated catalog has no more.
CATALOG = 100_000


def records(rows: DataFrame, cat: DataFrame, bodies: dict, base: int = DEFAULT.base, result_base: int = DEFAULT.result_base, longer_base: int = DEFAULT.longer_result_base, brackets: bool = False, largest: int | None = None, depth: int | None = None, fields: Sequence[str] | None = None) -> DataFrame:
    """The 18-field records (schema.EXPRESSION) of trees (expr_id, nodes). Numbers are in base, results in result_base.

    Records are columns (see folds); fields names those that are wanted, all unless given. Trees that could leave what doubles hold exactly are the
    interpreter's, in a column of its own that is handed null for all others; it isn't in the plan where largest and depth, bounds on the
    trees' numbers and height, show that there are none. Trees of loops, or of very many operators, are all the interpreter's.
    The catalog's rows are on the driver, CATALOG at most.
    """
    operators = {r["func_id"]: r.asDict() for r in cat.limit(CATALOG + 1).collect()}
    if len(operators) > CATALOG:
        raise ValueError(f"a catalog of more than {CATALOG} operators")
    every = [f.name for f in EXPRESSION.fields]
    names = every if fields is None else list(fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Records(operators, bodies, base, result_base, longer_base, brackets)
        for frame in frames:
            yield pd.DataFrame([{"id": i, **make.of(list(nodes))} for i, nodes in zip(frame["expr_id"], frame["nodes"])], columns=every)

    if not folds.compiles(operators, bodies):
        return rows.mapInPandas(run, EXPRESSION).select(*names)
    signs = {r["is_base"]: r["symbol"] for r in sorted(operators.values(), key=lambda r: -(r["id"] or 0)) if r["is_base"] is not None}
    fold = folds.Folds(operators, bodies, signs)
    near = largest is not None and depth is not None and folds.always_near(operators, bodies, largest, depth)
    known = rows.select("expr_id", "nodes", fold.evaluated(F.col("nodes"), near).alias("ev"))
    made = fold.record(F.col("nodes"), F.col("ev"), base, result_base, longer_base, brackets)
    own = lambda n: F.col("expr_id").cast("long") if n == "id" else made[n]().cast(EXPRESSION[n].dataType)
    if near:
        return known.select(*[own(n).alias(n) for n in names])

    @F.pandas_udf(T.StructType([EXPRESSION[n] for n in names]))
    def exact(ids: pd.Series, trees: pd.Series) -> pd.DataFrame:
        make = Records(operators, bodies, base, result_base, longer_base, brackets)
        found = [{"id": i, **make.of(list(nodes))} if nodes is not None else dict.fromkeys(names) for i, nodes in zip(ids, trees)]
        return pd.DataFrame({n: pd.Series([f[n] for f in found], dtype=object) for n in names})

    exact = exact.asNondeterministic()  # so that it is called once a row, wherever its fields are used
    known = known.withColumn("far", made["far"]()).withColumn("exact", exact("expr_id", F.when(F.col("far"), F.transform("nodes", lambda n: n.withField("value", n["value"].cast("string"))))))
    return known.select(*[F.when(F.col("far"), F.col(f"exact.{n}")).otherwise(own(n)).alias(n) for n in names])
