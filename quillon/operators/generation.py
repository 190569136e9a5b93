"""Operators and their parts drawn at random, and the filters that accept them."""

from __future__ import annotations

import ast
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BASIC_SYMBOLS, CLAMP, COMPARISONS, DEFAULT, LOOP_LIMITS, SYMBOL_RANGES, Settings
from ..functions import draws, language
from .catalog import numbered


def alphabet(spark: SparkSession) -> DataFrame:
    """(code, symbol): the signs that operator symbols are made of."""
    ranges = F.flatten(F.array(*[F.sequence(F.lit(a), F.lit(b)) for a, b in SYMBOL_RANGES], F.array(*[F.lit(ord(x)) for x in BASIC_SYMBOLS])))
    codes = spark.range(1).select(F.explode(ranges).alias("code"))
    return codes.select("code", F.decode(F.unhex(F.lpad(F.hex("code"), 4, "0")), "UTF-16BE").alias("symbol"))


#: All signs of operator symbols, in the order of their ranges.
SIGNS = [chr(c) for a, b in SYMBOL_RANGES for c in range(a, b + 1)] + list(BASIC_SYMBOLS)
#: Draws of a symbol before a key gets one that no draw can give.
DRAWS = 3


def symbols(keys: DataFrame, signs: Sequence[str], used: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(key, symbol): a symbol of its own for each distinct key: the first of DRAWS drawn ones that used (symbol) doesn't have.

    Of keys that get the same one the smallest has it. Others, and keys all of whose draws are taken, get their number written in
    signs, which is longer than any drawn one. Keys are whole numbers; a null one is left out.
    """
    lo, hi = settings.symbol_lengths
    pool, n = F.array(*[F.lit(s) for s in signs]), len(signs)
    sign = lambda t, k: F.get(pool, F.pmod(draws.bits(F.col("key"), f"sign{t}/{k}"), F.lit(n)).cast("int"))
    drawn = lambda t: F.substring(F.concat(*[sign(t, k) for k in range(hi)]), F.lit(1), draws.between(F.col("key"), f"length{t}", lo, hi).cast("int"))
    keys = keys.where("key IS NOT NULL").select("key").distinct()
    tried = keys.select("key", F.posexplode(F.array(*[drawn(t) for t in range(DRAWS)])).alias("t", "symbol"))
    free = tried.join(used.select("symbol").distinct(), "symbol", "left_anti").groupBy("key").agg(F.min_by("symbol", "t").alias("symbol"))
    won = free.groupBy("symbol").agg(F.min("key").alias("key"))
    return keys.join(won, "key", "left").select("key", F.coalesce("symbol", number_in_signs(F.col("key"), signs, settings)).alias("symbol"))


def number_in_signs(key: Column, signs: Sequence[str], settings: Settings = DEFAULT) -> Column:
    """A symbol that no other key has and no draw gives: the key written in signs, longer than any drawn symbol."""
    pool, n = F.array(*[F.lit(s) for s in signs]), len(signs)
    digit = lambda k: F.get(pool, F.pmod(F.floor(key / F.lit(n**k)), F.lit(n)).cast("int"))
    return F.concat(*[digit(k) for k in range(max(settings.symbol_lengths[1] + 1, 6))])


def shapes(key: Column) -> Column:
    """binary, prefix or postfix: arity even odds, position even odds."""
    return F.when(F.pmod(draws.bits(key, "arity"), F.lit(2)) == 0, "binary").when(F.pmod(draws.bits(key, "position"), F.lit(2)) == 0, "prefix").otherwise("postfix")


def left_side(symbol: Column, shape: Column) -> Column:
    return F.when(shape == "binary", F.concat(F.lit("a"), symbol, F.lit("b"))).when(shape == "prefix", F.concat(symbol, F.lit("a"))).otherwise(F.concat(F.lit("a"), symbol))


@dataclass(frozen=True)
class Pools:
    """Symbols that conditions and bodies may use, by shape; an empty pool is never drawn from."""

    prefix: tuple[str, ...] = ()
    postfix: tuple[str, ...] = ()
    binary: tuple[str, ...] = BASIC_SYMBOLS


def one_of(names: Sequence[str], key: Column, what: str) -> Column:
    return F.get(F.array(*[F.lit(x) for x in names]), F.pmod(draws.bits(key, what), F.lit(len(names))).cast("int"))


def variable(key: Column, what: str, shape: Column) -> Column:
    return F.when((shape == "binary") & (F.pmod(draws.bits(key, what), F.lit(2)) == 1), "b").otherwise("a")


def call(op: Column, *args: Column) -> Column:
    """A call in function text; op is a func_id."""
    return F.concat(F.lit("op_"), op, F.lit("("), F.concat_ws(", ", *args), F.lit(")"))


def operand(key: Column, tag: str, var: Column, pools: Pools = Pools(), settings: Settings = DEFAULT, source: bool = False) -> Column:
    """A variable, a unary operator on it, or a binary one on it and a constant, in even odds; the variable where a pool is empty.

    With source it is function text, and pools hold func_ids.
    """
    kind, out = F.pmod(draws.bits(key, f"{tag}/operand"), F.lit(4)), var
    one = lambda pool: one_of(pool, key, f"{tag}/op")
    if pools.prefix:
        out = F.when(kind == 1, call(one(pools.prefix), var) if source else F.concat(F.lit("("), one(pools.prefix), var, F.lit(")"))).otherwise(out)
    if pools.postfix:
        out = F.when(kind == 2, call(one(pools.postfix), var) if source else F.concat(F.lit("("), var, one(pools.postfix), F.lit(")"))).otherwise(out)
    if pools.binary:
        constant = draws.between(key, f"{tag}/constant", *settings.condition_range).cast("string")
        out = F.when(kind == 3, call(one(pools.binary), var, constant) if source else F.concat(F.lit("("), var, F.lit(" "), one(pools.binary), F.lit(" "), constant, F.lit(")"))).otherwise(out)
    return out


def condition(key: Column, tag: str, shape: Column, settings: Settings = DEFAULT, pools: Pools = Pools()) -> Column:
    """One comparison of an operand with a skewed constant."""
    left = operand(key, tag, variable(key, f"{tag}/var", shape), pools, settings)
    return F.concat_ws(" ", left, one_of(COMPARISONS, key, f"{tag}/cmp"), draws.skewed(key, f"{tag}/k", *settings.condition_range).cast("string"))


def condition_count(key: Column, settings: Settings = DEFAULT, tag: str = "") -> Column:
    return draws.weighted(draws.unit(key, f"{tag}conditions"), {str(i + 1): w for i, w in enumerate(settings.condition_weights)}).cast("int")


def condition_expression(key: Column, shape: Column, settings: Settings = DEFAULT, pools: Pools = Pools(), tag: str = "") -> Column:
    """One to three comparisons joined by and / or; of the last pair the operator may be bracketed."""
    c = [condition(key, f"{tag}c{i}", shape, settings, pools) for i in range(3)]
    word = lambda i: F.when(F.pmod(draws.bits(key, f"{tag}join{i}"), F.lit(2)) == 0, "and").otherwise("or")
    bracket = F.pmod(draws.bits(key, f"{tag}bracket"), F.lit(2)) == 1
    pair = lambda x, i, y: F.when(bracket, F.concat(F.lit("("), x, F.lit(" "), word(i), F.lit(" "), y, F.lit(")"))).otherwise(F.concat_ws(" ", x, word(i), y))
    n = condition_count(key, settings, tag)
    return F.when(n == 1, c[0]).when(n == 2, pair(c[0], 0, c[1])).otherwise(F.concat_ws(" ", c[0], word(0), pair(c[1], 1, c[2])))


def body(key: Column, tag: str, shape: Column, pools: Pools = Pools(), settings: Settings = DEFAULT, source: bool = False) -> Column:
    """A binary operator over two terms: a variable or small number, or an operand (see operand, for source too)."""

    def term(side: str) -> Column:
        var = variable(key, f"{tag}/{side}/var", shape)
        number = draws.skewed(key, f"{tag}/{side}/n", 1, 9).cast("string")
        small = F.when(F.pmod(draws.bits(key, f"{tag}/{side}/number"), F.lit(2)) == 1, number).otherwise(var)
        return F.when(F.pmod(draws.bits(key, f"{tag}/{side}/deep"), F.lit(2)) == 1, operand(key, f"{tag}/{side}", var, pools, settings, source)).otherwise(small)

    if source:
        return call(one_of(pools.binary, key, f"{tag}/op"), term("l"), term("r"))
    return F.concat(F.lit("("), term("l"), one_of(pools.binary, key, f"{tag}/op"), term("r"), F.lit(")"))


def branch_count(key: Column, settings: Settings = DEFAULT) -> Column:
    return draws.between(key, "branches", 1, settings.max_branches)


def definitions(keys: DataFrame, settings: Settings = DEFAULT, pools: Pools = Pools()) -> DataFrame:
    """keys (key, symbol) with shape, definition_type and definition: simple, or one to max_branches conditioned branches and an else.

    Bodies and conditions are drawn over the symbols of pools. Columns of keys beside these pass; a null key draws like an empty one.
    """
    k = F.col("key")
    d = keys.withColumn("shape", shapes(k)).withColumn("definition_type", F.when(F.pmod(draws.bits(k, "type"), F.lit(2)) == 0, "simple_definition").otherwise("branch_definition"))
    sh = F.col("shape")
    simple, arms = body(k, "b0", sh, pools, settings), F.lit("")
    for i in range(settings.max_branches):
        arm = F.concat(body(k, f"b{i}", sh, pools, settings), F.lit(" , if "), condition_expression(k, sh, settings, pools, f"i{i}/"), F.lit(" ; "))
        arms = F.concat(arms, arm) if i == 0 else F.concat(arms, F.when(branch_count(k, settings) > i, arm).otherwise(""))
    branch = F.concat(arms, body(k, "else", sh, pools, settings), F.lit(" , else"))
    text = F.when(F.col("definition_type") == "simple_definition", simple).otherwise(branch)
    return d.withColumn("definition", F.concat(left_side(F.col("symbol"), sh), F.lit(" = { "), text, F.lit(" }")))


#: What a step of a loop over a binary operator is called on; r is the result so far.
PATTERNS = (("r", "r"), ("r", "a"), ("r", "b"), ("a", "r"), ("b", "r"))


def callees(cat: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (key, n_order, ...) with a drawn operator of one order less: called, called_symbol, called_arity, called_position.

    An order without operators below it is an error. An order's operators are numbered by func_id.
    """
    pool = cat.where("is_base IS NULL AND n_order IS NOT NULL").select("func_id", "symbol", "n_ary", "unary_position", "n_order")
    pool = numbered(pool, F.col("n_order"), F.col("func_id"))
    sizes = pool.groupBy("n_order").agg(F.count("*").alias("size"), F.min("place").alias("first"))
    pool = pool.join(sizes.select("n_order", "first"), "n_order").withColumn("place", F.col("place") - F.col("first"))
    sizes = sizes.drop("first")
    asked = keys.withColumn("__below", F.col("n_order") - 1).join(sizes.withColumnRenamed("n_order", "__below"), "__below", "left")
    drawn = asked.withColumn("__place", F.pmod(draws.bits(F.col("key"), "callee"), F.col("size")))
    chosen = pool.select(F.col("func_id").alias("called"), F.col("symbol").alias("called_symbol"), F.col("n_ary").alias("called_arity"), F.col("unary_position").alias("called_position"), F.col("n_order").alias("__below"), F.col("place").alias("__place"))
    none = F.raise_error(F.concat(F.lit("no operator of order "), F.col("__below").cast("string")))
    found = drawn.drop("size").join(chosen, ["__below", "__place"], "left").withColumn("called", F.when(F.col("called").isNull(), none).otherwise(F.col("called")))
    return found.drop("__below", "__place")


def recursive_operators(keys: DataFrame, cat: DataFrame) -> DataFrame:
    """keys (key, symbol, n_order) as bounded loops over an operator of one order less: definition, value and cost functions as text.

    The loop runs over a or b; it starts at a, b or a whole number within 100 of 0; above its order's limit the value is NaN.
    """
    k = F.col("key")
    rows = callees(cat, keys).withColumn("func_id", F.concat(F.lit("g"), k.cast("string"))).withColumn("v", F.when(F.pmod(draws.bits(k, "loop"), F.lit(2)) == 0, "a").otherwise("b"))
    kind = F.pmod(draws.bits(k, "start"), F.lit(3))
    rows = rows.withColumn("start", F.when(kind == 0, "a").when(kind == 1, "b").otherwise(draws.between(k, "start/n", -100, 100).cast("string")))
    pattern = F.pmod(draws.bits(k, "pattern"), F.lit(len(PATTERNS))).cast("int")
    x, y = (F.get(F.array(*[F.lit(p[i]) for p in PATTERNS]), pattern) for i in (0, 1))
    limit = None
    for order, most in LOOP_LIMITS.items():
        limit = F.when(F.col("n_order") == order, str(most)) if limit is None else limit.when(F.col("n_order") == order, str(most))
    rows = rows.withColumn("x", x).withColumn("y", y).withColumn("most", limit)
    v, sym, called, binary = F.col("v"), F.col("symbol"), F.col("called_symbol"), F.col("called_arity") == 2
    c = lambda *xs: F.concat(*[F.lit(z) if isinstance(z, str) else z for z in xs])

    def again(step: str) -> Column:
        earlier = F.when(v == "a", c(f"(a{step}1)", sym, "b")).otherwise(c("a", sym, f"(b{step}1)"))
        arg = lambda z: F.when(F.col(z) == "r", earlier).otherwise(F.col(z))
        return F.when(binary, c("(", arg("x"), ")", called, "(", arg("y"), ")")).when(F.col("called_position") == "prefix", c(called, "(", earlier, ")")).otherwise(c("(", earlier, ")", called))

    near = F.coalesce(c(" and abs(", v, ") <= ", F.col("most")), F.lit(""))
    last = F.when(F.col("most").isNotNull(), c(" ; -(", again("+"), ") , if ", v, " < 0", near, " ; NaN , else }")).otherwise(c(" ; -(", again("+"), ") , else }"))
    definition = c("a", sym, "b = { ", F.col("start"), " , if ", v, " == 0 ; ", again("-"), " , if ", v, " > 0", near, last)
    args = F.when(binary, c(F.col("x"), ", ", F.col("y"))).otherwise("r")
    beyond = F.coalesce(c(" or abs(", v, ") > ", F.col("most")), F.lit(""))
    guard = lambda value: c("    if ", v, " != ", v, " or abs(", v, ") == float('inf')", beyond, f":\n        return {value}\n    r = ", F.col("start"), "\n")
    step = c("        t = op_", F.col("called"), "(", args, ")\n")
    keep = c(f"        if abs(t) > {CLAMP}:\n            t = float('inf')\n        r = t if ", v, " > 0 else -t\n")
    loop = c("    for _ in range(abs(", v, ")):\n")
    compute = c("def op_", F.col("func_id"), "(a, b):\n", guard("float('nan')"), loop, step, keep, "    return r")
    count = c("def op_count_", F.col("func_id"), "(a, b):\n", guard("1"), "    n = 0\n", loop, step, "        n += op_count_", F.col("called"), "(", args, ")\n", keep, "    return max(n, 1)")
    return rows.select("key", "func_id", "symbol", "n_order", F.col("called").alias("callee"), definition.alias("definition"), F.lit("recursive_definition").alias("definition_type"), compute.alias("op_compute_func"), count.alias("op_count_func"), F.array("called").alias("dependencies"))


def body_hash(src: Column) -> Column:
    """Hash of a function's body, its def line left out and its own name neutral."""
    return F.sha2(F.regexp_replace(src, r"^[^\n]*\n", ""), 256)


def uses_arguments(src: Column, arity: Column) -> Column:
    """Whether the body names every parameter."""
    text = F.regexp_replace(src, r"^[^\n]*\n", "")
    return text.rlike(r"(?<!\w)a(?!\w)") & ((arity == 1) | text.rlike(r"(?<!\w)b(?!\w)"))


def is_wrapper(src: Column, arity: Column) -> Column:
    """Whether the body is one return of one call on the plain parameters."""
    text = F.regexp_replace(src, r"^[^\n]*\n", "")
    return F.when(arity == 1, text.rlike(r"^\s*return op_\w+\(a\)\s*$")).otherwise(text.rlike(r"^\s*return op_\w+\((a, b|b, a|a, a|b, b)\)\s*$"))


def distinct_returns(src: Column) -> Column:
    found = F.regexp_extract_all(src, F.lit(r"return ([^\n]*)"), F.lit(1))
    return F.size(F.array_distinct(found)) == F.size(found)


def layer_sizes(spark: SparkSession, total: int, layers: int = 5, ratio: float = 0.6) -> DataFrame:
    """(layer, size): a geometric split, truncated, the rest to the last."""
    first = total / sum(ratio**k for k in range(layers))
    sizes = spark.range(1, layers + 1).select(F.col("id").cast("int").alias("layer"), F.floor(F.lit(first) * F.pow(F.lit(ratio), F.col("id") - 1)).alias("raw"))
    rest = F.lit(total) - sum(int(first * ratio**k) for k in range(layers - 1))
    return sizes.select("layer", F.when(F.col("layer") == layers, rest).otherwise(F.col("raw")).cast("long").alias("size"))


def parses(src: Column) -> Column:
    """Whether function text is valid syntax; only Python's own parser can tell, in Arrow batches."""

    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        def fine(text) -> bool:
            try:
                ast.parse(text)
            except (SyntaxError, ValueError, TypeError):
                return False
            return True

        return texts.map(fine).astype(bool)

    return check(src)


#: What compiled() adds to rows.
COMPILED = {"ok": "boolean", "op_compute_func": "string", "again": "string", "flat": "string", "dependencies": "array<string>"}
#: Python's parser takes at least as many nested brackets.
NESTED = 50


def compiled(rows: DataFrame, symbols: dict, shapes_of: dict, fields: Sequence[str] = tuple(COMPILED)) -> DataFrame:
    """rows (func_id, definition, ...) with ok, op_compute_func, again (the definition's right side, read back from that text), flat
    (the same without boolean brackets) and dependencies, or those of them that fields names. A definition that is null or cannot be read has ok false and nulls;
    nulls are no result, so whoever compares them has to say what a failure is. Any other error ends the job.

    Parsing is Python's own, in Arrow batches. symbols and shapes_of are the catalog's: (symbol, shape) -> func_id and back.
    """

    @F.pandas_udf(", ".join(f"{f} {COMPILED[f]}" for f in fields))
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out, reader, back = [], language.Reader(symbols), not {"again", "flat"}.isdisjoint(fields)
        for func_id, text in zip(ids, texts):
            try:
                if text is None:
                    raise language.DefinitionError("no definition")
                params, found = reader.parse(text)
                made = {"ok": True, "op_compute_func": (src := language.source(func_id, params, found))}
                if back or src.count("(") > NESTED:
                    _, _, found = language.read_source(src)
                if "again" in fields:
                    made["again"] = language.show(found, shapes_of)
                if "flat" in fields:
                    made["flat"] = language.show(found, shapes_of, flat=True)
                if "dependencies" in fields:
                    made["dependencies"] = sorted(set(language.calls(found)))
                out.append([made[f] for f in fields])
            except language.DefinitionError:
                out.append([False if f == "ok" else None for f in fields])
        return pd.DataFrame(out, columns=list(fields))

    # Not deterministic, so that a filter on what it gives doesn't call it again.
    return rows.withColumn("__c", run.asNondeterministic()("func_id", "definition")).select("*", "__c.*").drop("__c")


def holds_up(rows: DataFrame, bodies: dict, tries: int = 5) -> DataFrame:
    """rows (func_id, op_compute_func) with holds: whether the function gives a whole number, NaN or an infinity on drawn operands.

    Operands are as the generator's: up to the clamp either way, the same for every operator.
    """
    drawn = [(r["a"], r["b"]) for r in rows.sparkSession.range(tries).select(*[(draws.between(F.col("id"), f"prop{v}", 0, 2 * CLAMP) - CLAMP).alias(v) for v in ("a", "b")]).collect()]

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        def fine(text) -> bool:
            try:
                func_id, params, found = language.read_source(text)
                for args in drawn:
                    value, cost = language.evaluate(func_id, args[: len(params)], bodies | {func_id: (params, found)})
                    if not (isinstance(value, int) or value != value or abs(value) == float("inf")) or cost < 1:
                        return False
            except (language.DefinitionError, KeyError, TypeError, OverflowError):
                return False
            return True

        return texts.map(fine).astype(bool)

    return rows.withColumn("holds", run.asNondeterministic()("op_compute_func"))


def accept(rows: DataFrame, cat: DataFrame, bodies: dict, order: int) -> DataFrame:
    """The rows (func_id, n_ary, op_compute_func, dependencies) that pass every filter: valid syntax, arguments used, no wrapper, distinct returns,
    properties, order of recursion, and a body of their own: the smallest func_id of equal bodies, and none that the catalog has."""
    src = F.col("op_compute_func")
    fine = rows.where(src.isNotNull()).where(uses_arguments(src, F.col("n_ary")) & ~is_wrapper(src, F.col("n_ary")) & distinct_returns(src))
    # What cannot be parsed doesn't hold either.
    fine = holds_up(fine, bodies).where("holds")
    own = F.when(src.contains("for _ in range("), 1).otherwise(0)
    known = cat.select(F.col("func_id").alias("d"), F.coalesce("n_order", F.lit(1)).alias("below"))
    below = fine.select("func_id", "op_compute_func", F.explode_outer("dependencies").alias("d")).join(known, "d", "left").groupBy("func_id", "op_compute_func").agg(F.coalesce(F.max("below"), F.lit(1)).alias("below"))
    fine = below.where(F.col("below") + own == order).drop("below")
    text = F.regexp_replace(src, r"^[^\n]*\n", "")
    there = cat.where("op_compute_func IS NOT NULL").select(text.alias("text")).distinct()
    fresh = fine.withColumn("text", text).join(there, "text", "left_anti")
    return fresh.groupBy("text").agg(F.min("func_id").alias("func_id")).select("func_id")
