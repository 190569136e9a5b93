"""A small catalog with hand-derivable answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language as L
from ..schema import OPERATOR

PRIMITIVES = {"p1": "+", "m1": "-", "t1": "*", "d1": "/", "r1": "%"}
# func_id, symbol, shape, order, base, priority, associativity, definition or loop
ROWS = (
    ("p1", "+", "binary", 1, None, 1, "left", None),
    ("m1", "-", "binary", 1, None, 1, "left", None),
    ("t1", "*", "binary", 1, None, 2, "left", None),
    ("d1", "/", "binary", 1, None, 2, "left", None),
    ("r1", "%", "binary", 1, None, 2, "left", None),
    ("s1", "⊕", "binary", 1, None, 3, "right", "a⊕b = { ((a+b)*2) }"),
    ("b1", "∇", "prefix", 1, None, 4, "right", "∇a = { (a*a) , if a > 10 and (a % 2) == 0 ; (a+1) , else }"),
    ("l1", "⇑", "binary", 2, None, 5, "left", L.Loop("p1", L.Num(0), ("r", "a"))),
    ("l2", "⤊", "binary", 2, None, 5, "left", L.Loop("t1", L.Var("a"), ("r", "a"))),
    ("l3", "⊗", "binary", 3, None, 6, "right", L.Loop("l1", L.Num(1), ("r", "a"), 1_000_000)),
    ("x2", "⊞", "prefix", None, 2, 7, "right", None),
    ("x16", "⊠", "prefix", None, 16, 7, "right", None),
)
SYMBOLS = {(r[1], r[2]): r[0] for r in ROWS}
SHAPES = {r[0]: (r[1], r[2]) for r in ROWS}
BODIES: dict = dict(PRIMITIVES)
for _r in ROWS:
    if isinstance(_r[7], str):
        BODIES[_r[0]] = L.parse(_r[7], SYMBOLS)
    elif _r[7] is not None:
        BODIES[_r[0]] = (("a", "b"), _r[7])


def loop_text(symbol: str, called: str, loop: L.Loop) -> str:
    """The recurrence of a loop as text."""
    bound = f" and abs(b) <= {loop.limit}" if loop.limit else ""
    names = [f"(a{symbol}(abs(b)-1))" if n == "r" else n for n in loop.args]
    start = loop.start.value if isinstance(loop.start, L.Num) else loop.start.name
    return f"a{symbol}b = {{ {start} , if b == 0 ; {names[0]}{called}{names[1]} , if b > 0{bound} ; -({names[0]}{called}{names[1]}) , if b < 0{bound} ; NaN , else }}"


def records() -> list[dict]:
    out = []
    for i, (func_id, symbol, shape, order, base, priority, side, body) in enumerate(ROWS, 1):
        compiled = BODIES.get(func_id)
        deps = sorted(set(L.calls(compiled[1]))) if isinstance(compiled, tuple) else []
        src = L.source(func_id, *compiled) if isinstance(compiled, tuple) else f"def op_{func_id}(a, b):\n    return a {PRIMITIVES[func_id]} b" if func_id in PRIMITIVES else None
        text = body if isinstance(body, str) else loop_text(symbol, SHAPES[body.callee][0], body) if body else None
        kind = "simple_definition" if func_id == "s1" else "branch_definition" if func_id == "b1" else "recursive_definition" if body else None
        out.append({
            "id": i, "func_id": func_id, "symbol": symbol, "n_ary": 2 if shape == "binary" else 1, "unary_position": None if shape == "binary" else shape, "n_order": order, "is_base": base, "definition": text,
            "definition_type": kind, "priority": priority, "associativity_direction": side, "op_compute_func": src, "op_count_func": src and src.replace("def op_", "def op_count_", 1), "dependencies": deps,
        })
    return out


def catalog(spark: SparkSession, extra: list[dict] = ()) -> DataFrame:
    return spark.createDataFrame([tuple(r[f.name] for f in OPERATOR.fields) for r in [*records(), *extra]], OPERATOR)


DERIVED_SIGNS = ("+", "-", "*", "/", "%", "⊕")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator for each part: it calls addition and the operator of half its key, so that keys are a tree; even ones are recursive."""
    k = F.col("p_partkey").cast("long")
    key, half, binary = k.cast("string"), F.floor(k / 2).cast("string"), k % 3 == 0
    shape = F.when(binary, F.lit(None)).when(k % 3 == 1, "prefix").otherwise("postfix")
    args, sign = F.when(binary, "a, b").otherwise("a"), F.get(F.array(*map(F.lit, DERIVED_SIGNS)), F.pmod(F.floor(k / 3), F.lit(len(DERIVED_SIGNS))).cast("int"))
    inner = F.when(k > 1, F.concat(F.lit("op_f"), half, F.lit("("), args, F.lit(")"))).otherwise("a")
    source = lambda name: F.concat(F.lit(f"def {name}_f"), key, F.lit("("), args, F.lit("):\n    return op_p1("), inner, F.lit(", "), F.when(binary, "b").otherwise("a"), F.lit(")"))
    bits = F.length(F.conv(key, 10, 2))
    columns = {
        "id": k + 1000, "func_id": F.concat(F.lit("f"), key), "symbol": sign, "n_ary": F.when(binary, 2).otherwise(1), "unary_position": shape, "n_order": bits - F.bit_count(k) + 1, "is_base": F.lit(None), "definition": F.concat(F.lit("part "), key),
        "definition_type": F.when(k % 2 == 0, "recursive_definition").otherwise("simple_definition"), "priority": k % 7 + 1, "associativity_direction": F.when(k % 2 == 0, "right").otherwise("left"), "op_compute_func": source("op"), "op_count_func": source("op_count"),
        "dependencies": F.when(k > 1, F.array(F.lit("p1"), F.concat(F.lit("f"), half))).otherwise(F.array(F.lit("p1"))),
    }
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in OPERATOR.fields])


def _source_sql(name: str) -> str:
    args, last = "CASE WHEN k % 3 = 0 THEN 'a, b' ELSE 'a' END", "CASE WHEN k % 3 = 0 THEN 'b' ELSE 'a' END"
    return f"'def {name}_f' || k || '(' || {args} || '):' || chr(10) || '    return op_p1(' || CASE WHEN k > 1 THEN 'op_f' || (k // 2) || '(' || {args} || ')' ELSE 'a' END || ', ' || {last} || ')'"


DERIVED_SQL = f"""SELECT k + 1000 AS id, 'f' || k AS func_id, [{", ".join(f"'{x}'" for x in DERIVED_SIGNS)}][((k // 3) % {len(DERIVED_SIGNS)})::INT + 1] AS symbol, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS n_ary,
  CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'prefix' ELSE 'postfix' END AS unary_position, (length(to_base(k, 2)) - bit_count(k) + 1)::INT AS n_order, NULL::INT AS is_base, 'part ' || k AS definition,
  CASE WHEN k % 2 = 0 THEN 'recursive_definition' ELSE 'simple_definition' END AS definition_type, (k % 7 + 1)::INT AS priority, CASE WHEN k % 2 = 0 THEN 'right' ELSE 'left' END AS associativity_direction,
  {_source_sql("op")} AS op_compute_func, {_source_sql("op_count")} AS op_count_func, CASE WHEN k > 1 THEN ['p1', 'f' || (k // 2)] ELSE ['p1'] END AS dependencies FROM (SELECT p_partkey::BIGINT AS k FROM part)"""


def sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(sql_value, v)) + "]::VARCHAR[]"
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


CASTS = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "array<string>": "VARCHAR[]"}


def catalog_sql(extra: list[dict] = (), parts: bool = False) -> str:
    """cat: the same rows as a common table expression; with parts, those of derived() too."""
    rows = ",\n".join("(" + ", ".join(sql_value(r[f.name]) for f in OPERATOR.fields) + ")" for r in [*records(), *extra])
    names = ", ".join(f.name for f in OPERATOR.fields)
    return f"raw_cat({names}) AS (VALUES {rows}), cat AS (SELECT " + ", ".join(f"{f.name}::{CASTS[f.dataType.simpleString()]} AS {f.name}" for f in OPERATOR.fields) + f" FROM raw_cat{' UNION ALL ' + DERIVED_SQL if parts else ''})"
