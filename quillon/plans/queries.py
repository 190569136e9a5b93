"""One query per operator of the survey. Operands and expression numbers come from whole tables; catalogs are the fixture's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, LOOP_LIMITS, NAN, SYMBOL_RANGES
from ..functions import bases, draws
from ..functions import language as L
from ..functions.compiler import Compiler, compare
from ..operators import catalog as C
from ..operators import evaluation, expressions, generation, priorities, runs
from ..schema import EXPRESSION, OPERATOR
from ..sources import jsonl, scratch
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DUPLICATE = X.records()[5] | {"id": 13, "func_id": "z9", "op_compute_func": X.records()[5]["op_compute_func"].replace("op_s1", "op_z9", 1)}
POSTFIX = X.records()[6] | {"id": 14, "func_id": "q1", "symbol": "‰", "unary_position": "postfix", "priority": 4, "associativity_direction": "left", "definition": "a‰ = { (a*a) }", "op_compute_func": "def op_q1(a):\n    return op_t1(a, a)", "op_count_func": None, "definition_type": "simple_definition", "dependencies": ["t1"]}
#: What trees are drawn from: all operators that SQL can evaluate too; loops are left to eval_tree_loops.
POOLS = (("p1", "m1", "t1", "d1", "r1", "s1"), ("b1",), ("q1",))
BODIES = X.BODIES | {"q1": L.parse("a‰ = { (a*a) }", X.SYMBOLS)}
SYMBOLS = X.SYMBOLS | {("‰", "postfix"): "q1"}
SHAPES = X.SHAPES | {"q1": ("‰", "postfix")}
WRAPPER = POSTFIX | {"id": 15, "func_id": "w1", "symbol": "¤", "op_compute_func": "def op_w1(a):\n    return op_b1(a)", "dependencies": ["b1"]}
TWIN = POSTFIX | {"id": 16, "func_id": "v1", "symbol": "¥", "op_compute_func": "def op_v1(a):\n    if a > 3:\n        return op_t1(a, a)\n    else:\n        return op_t1(a, a)"}
EXTRA = [DUPLICATE, POSTFIX, WRAPPER, TWIN]
SYMBOL_POOLS = generation.Pools(("∇",), ("‰",), ("+", "-", "*", "/", "%", "⊕"))
#: The operators of SYMBOL_POOLS.
NAME_POOLS = generation.Pools(("b1",), ("q1",), ("p1", "m1", "t1", "d1", "r1", "s1"))
#: Expression ids of a row of the inverted index, so that an operator in every expression is no single array.
INDEX_BUCKET = 4096
BAD_LINES = ("", "   ", "{not json", '{"func_id":"u1","symbol":"#","n_ary":2,"colour":"red"}', '{"symbol":"#","n_ary":2}', '{"func_id":"ok1","symbol":"#","n_ary":2}')


def query(name: str):
    def put(f):
        QUERIES[name] = f
        return f

    return put


def cat(spark, extra=(), parts=None):
    """The fixture's catalog; with parts, a folder of tables, the operators of its parts too."""
    rows = X.catalog(spark, list(extra))
    return rows if parts is None else rows.unionByName(X.derived(spark, parts))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def operands(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"), (F.col("l_linenumber") - 3).cast("long").alias("b"))


def tree_rows(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("expr_id"))
    return expressions.grow_rows(ids, *POOLS)


def tree(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("expr_id"))
    return expressions.grow(ids, *POOLS)


def record_table(spark, sf_dir, **how):
    return expressions.records(tree_rows(spark, sf_dir), tree_operators(spark), BODIES, largest=DEFAULT.value_range[1], depth=2, **how)


def tree_operators(spark):
    """What trees of the pools are made of, and the operators that write numbers in bases."""
    return cat(spark, [POSTFIX]).where(F.col("func_id").isin(*[f for pool in POOLS for f in pool]) | F.col("is_base").isNotNull())


# Sources and sinks


def _written(spark, parts=None):
    at = scratch.path(spark, "catalog")
    rows = cat(spark, parts=parts)
    rows.select(jsonl.to_json(rows).alias("value")).unionAll(spark.createDataFrame([(x,) for x in BAD_LINES], "value string")).write.text(at)
    return at


@query("catalog_load")
def _(spark, sf_dir):
    return jsonl.load(spark, _written(spark, sf_dir))


@query("operator_record_parse")
def _(spark, sf_dir):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(BAD_LINES)], "line long, value string")
    return lines.withColumn("r", jsonl.parse_operator(F.col("value"))).select("line", F.col("r").isNotNull().alias("ok"), F.col("r.func_id").alias("func_id"))


@query("operator_to_json")
def _(spark, sf_dir):
    return cat(spark, parts=sf_dir).select("func_id", jsonl.to_json(cat(spark, parts=sf_dir)).alias("json"))


@query("operator_project")
def _(spark, sf_dir):
    return cat(spark, parts=sf_dir).select(*[f.name for f in OPERATOR.fields])


@query("catalog_save")
def _(spark, sf_dir):
    at = scratch.path(spark, "saved")
    jsonl.save(cat(spark, parts=sf_dir), at)
    return spark.read.schema(OPERATOR).json(at)


@query("op_source_dump")
def _(spark, sf_dir):
    return jsonl.sources_text(cat(spark, parts=sf_dir))


@query("catalog_read_keyed")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), F.when(F.col("l_partkey") % 7 != 0, F.concat(F.lit("f"), F.col("l_partkey").cast("string"))).alias("func_id"), F.col("l_suppkey").alias("payload"))
    return jsonl.last_wins(lines)


@query("nonbase_func_ids")
def _(spark, sf_dir):
    return cat(spark, parts=sf_dir).where("is_base IS NULL").select("func_id")


@query("existing_count")
def _(spark, sf_dir):
    return spark.createDataFrame([(jsonl.count_lines(spark, _written(spark)), jsonl.count_lines(spark, scratch.path(spark, "nothing")))], "there long, absent long")


@query("dependency_export")
def _(spark, sf_dir):
    return C.dependency_rows(cat(spark, parts=sf_dir)).withColumn("level", F.col("level").cast("int"))


@query("op2expr")
def _(spark, sf_dir):
    return tree(spark, sf_dir).where("func_id IS NOT NULL").groupBy(F.col("func_id").alias("op_id"), F.floor(F.col("expr_id") / INDEX_BUCKET).alias("bucket")).agg(F.sort_array(F.collect_set("expr_id")).alias("expr_id"))


# Lookups


@query("lookup_func_id")
def _(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").select(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "p").otherwise("l"), F.col("l_linenumber").cast("string")).alias("func_id")).distinct()
    return C.by_func_id(cat(spark), wanted)


@query("lookup_symbol")
def _(spark, sf_dir):
    return cat(spark, EXTRA, sf_dir).where("symbol = '⊕'").select("func_id", "symbol")


@query("distinct_symbols")
def _(spark, sf_dir):
    return cat(spark, EXTRA, sf_dir).select("symbol").distinct()


@query("resolve_overload")
def _(spark, sf_dir):
    asked = spark.createDataFrame([("⊕", 2, None), ("∇", 1, "prefix"), ("∇", 1, "postfix"), ("?", 2, None), ("‰", 1, "postfix")], "symbol string, n_ary int, unary_position string")
    return C.resolve(cat(spark, EXTRA), asked)


@query("lookup_base")
def _(spark, sf_dir):
    return cat(spark, parts=sf_dir).where("is_base = 16").select("func_id", "symbol", "is_base")


@query("arity_partition")
def _(spark, sf_dir):
    return cat(spark, EXTRA, sf_dir).groupBy(C.shape().alias("shape")).agg(F.sort_array(F.collect_list("func_id")).alias("func_ids"))


@query("sort_by_priority")
def _(spark, sf_dir):
    return cat(spark, parts=sf_dir).select("func_id", "priority", "id").transform(lambda t: C.numbered(t, F.col("priority"), F.col("id"))).select("func_id", "priority", F.col("place").cast("long").alias("place"))


@query("generation_pool")
def _(spark, sf_dir):
    return cat(spark, parts=sf_dir).where("is_base IS NULL").select("func_id", C.shape().alias("shape"))


@query("order_pool")
def _(spark, sf_dir):
    return cat(spark, parts=sf_dir).where("n_order <= 2").select("func_id", (F.col("n_order") == 2).alias("is_target"))


@query("recursive_call_pool")
def _(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(3).alias("n_order"))
    return generation.callees(cat(spark), asked).select("key", F.col("called").alias("func_id"))


# Mutation and graph


@query("catalog_add")
def _(spark, sf_dir):
    return C.add(cat(spark), X.catalog(spark, [POSTFIX]).where("func_id = 'q1'")).select("func_id", "symbol")


@query("catalog_remove")
def _(spark, sf_dir):
    return C.remove(cat(spark, parts=sf_dir), spark.createDataFrame([("s1",), ("none",)], "func_id string")).select("func_id")


@query("catalog_update")
def _(spark, sf_dir):
    return C.update(cat(spark, parts=sf_dir), cat(spark, parts=sf_dir).where("func_id = 's1'").withColumn("symbol", F.lit("⊎"))).select("func_id", "symbol", "n_order")


@query("temporary_flag")
def _(spark, sf_dir):
    return cat(spark, parts=sf_dir).select("func_id", (F.col("func_id") == "b1").alias("is_temporary"))


@query("cascade_closure")
def _(spark, sf_dir):
    return C.closure(cat(spark, parts=sf_dir), spark.createDataFrame([("p1",)], "func_id string"))


@query("cascade_delete")
def _(spark, sf_dir):
    return C.remove(cat(spark, parts=sf_dir), C.closure(cat(spark, parts=sf_dir), spark.createDataFrame([("p1",)], "func_id string"))).select("func_id")


@query("renumber")
def _(spark, sf_dir):
    return C.renumber(cat(spark, parts=sf_dir))


@query("symbol_dedupe")
def _(spark, sf_dir):
    free = spark.createDataFrame([("∀",), ("∁",), ("⊕",), ("∂",)], "symbol string")
    return C.fresh_symbols(cat(spark, EXTRA), free)


@query("extract_deps")
def _(spark, sf_dir):
    return C.extract_dependencies(cat(spark, parts=sf_dir))


@query("calc_order")
def _(spark, sf_dir):
    return C.orders(cat(spark, parts=sf_dir)).select("func_id", F.col("n_order").cast("int").alias("n_order"))


@query("dep_edges")
def _(spark, sf_dir):
    return C.edges(cat(spark, parts=sf_dir)).groupBy("dst").agg(F.count("*").alias("in_degree"))


@query("topo_sort")
def _(spark, sf_dir):
    at = C.levels(cat(spark, parts=sf_dir))
    return C.numbered(at, F.col("level"), F.col("func_id")).select("func_id", F.col("level").cast("int").alias("level"), F.col("place").cast("long").alias("place"))


@query("assign_priority")
def _(spark, sf_dir):
    return priorities.assign(cat(spark, parts=sf_dir))


@query("op_usage")
def _(spark, sf_dir):
    return tree(spark, sf_dir).where("func_id IS NOT NULL").groupBy("expr_id", "func_id").agg(F.count("*").alias("n"))


# Bases


@query("base_convert")
def _(spark, sf_dir):
    n = (F.col("l_partkey") - 1000) * F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[bases.digits(n, b).alias(f"base{b}") for b in (2, 3, 16, 36)])


@query("supported_bases")
def _(spark, sf_dir):
    return spark.range(2, 37).select(F.col("id").alias("base"))


@query("base_literal")
def _(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("n"), F.when(F.col("l_linenumber") % 3 == 0, 2).when(F.col("l_linenumber") % 3 == 1, 16).otherwise(10).alias("base"))
    known = cat(spark).where("is_base IS NOT NULL").select(F.col("is_base").alias("base"), "symbol")
    return asked.join(known, "base", "left").select("l_orderkey", "l_linenumber", "base", bases.literal(F.col("n"), F.col("base"), F.col("symbol")).alias("literal"))


@query("expr_rebase")
def _(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("$"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("$"), F.col("l_partkey").cast("string"), F.lit("$ + $"), F.col("l_suppkey").cast("string"), F.lit("$")))
    return t.select("l_orderkey", "l_linenumber", bases.rebase(text, 2).alias("base2"), bases.rebase(text, 16).alias("base16"))


@query("number_plain")
def _(spark, sf_dir):
    return operands(spark, sf_dir).select("l_orderkey", "l_linenumber", F.concat(F.lit("$"), F.col("b").cast("string"), F.lit("$")).alias("text"))


@query("number_based")
def _(spark, sf_dir):
    return operands(spark, sf_dir).select("l_orderkey", "l_linenumber", bases.literal(F.col("b"), 16, F.lit("⊠")).alias("text"))


@query("base_operators")
def _(spark, sf_dir):
    signs = generation.alphabet(spark).where(f"code BETWEEN {SYMBOL_RANGES[0][0]} AND {SYMBOL_RANGES[0][1]}").withColumn("k", F.col("code") - SYMBOL_RANGES[0][0])
    return spark.range(2, DEFAULT.max_base + 1).select(F.col("id").cast("int").alias("is_base"), (F.col("id") - 2).alias("k")).join(signs, "k").select("is_base", "symbol", F.lit(1).alias("n_ary"), F.lit("prefix").alias("unary_position"))


@query("target_base_text")
def _(spark, sf_dir):
    v = F.when(F.col("b") == 0, F.lit(float("nan"))).when(F.col("b") == -1, F.lit(float("inf"))).when(F.col("b") == -2, F.lit(float("-inf"))).otherwise(F.col("a").cast("double"))
    return operands(spark, sf_dir).select("l_orderkey", "l_linenumber", F.when(F.col("b") <= 0, bases.trace_text(v)).otherwise(bases.literal(F.col("a"), 16, F.lit("⊠"))).alias("text"))


# Draws and generation


@query("skewed_value")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", draws.skewed(F.col("o_orderkey"), "value", 0, 1000).alias("value"))


@query("random_base")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", draws.between(F.col("o_orderkey"), "base", 2, DEFAULT.max_base).alias("base"))


@query("atom_gen")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    variable = draws.unit(k, "atom") < DEFAULT.variable_share
    name = F.when(F.pmod(draws.bits(k, "name"), F.lit(2)) == 0, "a").otherwise("b")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(variable, name).otherwise(draws.skewed(k, "value", *DEFAULT.value_range).cast("string")).alias("atom"))


@query("tree_gen")
def _(spark, sf_dir):
    return tree(spark, sf_dir).select("expr_id", "node_id", "parent_id", "side", "depth", "kind", "func_id", "value")


@query("order_tree_gen")
def _(spark, sf_dir):
    """Every expression with an operator of order 2."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("expr_id"))
    return expressions.force(ids, "l1", *POOLS).select("expr_id", F.explode("nodes").alias("n")).select("expr_id", "n.node_id", "n.func_id")


def _one_operator(rows, key):
    """Trees of one operator for rows (expr_id, func_id, n_ary)."""
    return rows.select("expr_id", expressions.single(F.col("func_id"), F.col("n_ary"), key).alias("nodes"))


@query("single_op_expr")
def _(spark, sf_dir):
    """One operator of the pools an expression, drawn evenly."""
    names = [f for pool in POOLS for f in pool]
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("expr_id"), generation.one_of(names, F.col("o_orderkey"), "single").alias("func_id"))
    rows = _one_operator(ids.withColumn("n_ary", F.when(F.col("func_id").isin(*POOLS[0]), 2).otherwise(1)), F.col("expr_id"))
    return expressions.records(rows, tree_operators(spark), BODIES, largest=DEFAULT.value_range[1], depth=1, fields=["id", "expression", "result", "normalized_expansion_degree", "text"]).select("id", "expression", F.col("result").alias("value"), F.col("normalized_expansion_degree").cast("long").alias("cost"), "text")


@query("symbol_gen")
def _(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return generation.symbols(keys, generation.SIGNS, cat(spark).select("symbol"))


@query("symbol_alphabet")
def _(spark, sf_dir):
    return generation.alphabet(spark)


@query("op_shape_gen")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", generation.shapes(F.col("o_orderkey")).alias("shape"))


@query("cond_atom")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", generation.condition(F.col("o_orderkey"), "c0", F.lit("binary"), pools=SYMBOL_POOLS).alias("condition"))


@query("cond_operand")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", generation.operand(k, "c0", generation.variable(k, "c0/var", F.lit("binary")), SYMBOL_POOLS).alias("operand"))


@query("recursive_operator_gen")
def _(spark, sf_dir):
    """Loops of order 2 and 3 over the catalog, unary callees included."""
    order = F.when(F.pmod(draws.bits(F.col("key"), "order"), F.lit(2)) == 0, 2).otherwise(3)
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit("⊛").alias("symbol")).withColumn("n_order", order)
    return generation.recursive_operators(keys, cat(spark, [POSTFIX]))


@query("cond_count")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", generation.condition_count(F.col("o_orderkey")).alias("n"))


@query("lhs_gen")
def _(spark, sf_dir):
    return cat(spark, EXTRA, sf_dir).select("func_id", generation.left_side(F.col("symbol"), C.shape()).alias("lhs"))


@query("definition_gen")
def _(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit("⊛").alias("symbol"))
    return generation.definitions(keys, pools=SYMBOL_POOLS).select("key", "shape", "definition_type", "definition")


@query("cond_expr")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", generation.condition_expression(F.col("o_orderkey"), F.lit("binary"), pools=SYMBOL_POOLS).alias("condition"))


# Language


def _generated(spark, sf_dir):
    """Generated definitions, numbered d0, d1, ... by their orders."""
    keys = expressions.spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit("⊛").alias("symbol")))
    return generation.definitions(keys, pools=SYMBOL_POOLS).withColumn("func_id", F.concat(F.lit("d"), F.col("key").cast("string")))


def _compiled(spark, sf_dir, *fields, kind=None):
    """The fields of generated definitions, of one definition_type or all."""
    rows = _generated(spark, sf_dir)
    return generation.compiled(rows if kind is None else rows.where(F.col("definition_type") == kind), SYMBOLS, SHAPES, fields or tuple(generation.COMPILED))


@query("definition_parse")
def _(spark, sf_dir):
    """Generated definitions, and one in nine of them without its last bracket."""
    rows = _generated(spark, sf_dir)
    broken = F.when(F.col("key") % 9 == 0, F.regexp_replace("definition", r"\)([^)]*)$", "$1")).otherwise(F.col("definition"))
    return generation.compiled(rows.withColumn("definition", broken), SYMBOLS, SHAPES, ["ok", "op_compute_func"]).select("func_id", "ok", F.col("op_compute_func").isNotNull().alias("compiled"))


@query("decompile")
def _(spark, sf_dir):
    """What the compiled text of simple definitions reads back as."""
    return _compiled(spark, sf_dir, "again", kind="simple_definition").select("func_id", F.col("again").alias("definition"))


@query("decompile_flat")
def _(spark, sf_dir):
    """The same of branches, without boolean brackets."""
    return _compiled(spark, sf_dir, "flat", kind="branch_definition").select("func_id", F.col("flat").alias("definition"))


@query("definition_roundtrip")
def _(spark, sf_dir):
    """Whether a definition, read back, printed and parsed again, compiles to the same text; one that can't be read, the first or the second time, doesn't."""
    once = _compiled(spark, sf_dir, "op_compute_func", "again").select("func_id", "op_compute_func", F.concat(F.regexp_extract("definition", r"^(.*?= \{ )", 1), "again", F.lit(" }")).alias("definition"))
    twice = generation.compiled(once.withColumnRenamed("op_compute_func", "before"), SYMBOLS, SHAPES, ["op_compute_func"])
    return twice.select("func_id", F.coalesce(F.col("before") == F.col("op_compute_func"), F.lit(False)).alias("same"))


# Evaluation


@query("eval_simple")
def _(spark, sf_dir):
    return evaluation.apply_operator(operands(spark, sf_dir), "s1", X.BODIES, F.col("a"), F.col("b"))


@query("eval_branch")
def _(spark, sf_dir):
    return evaluation.apply_operator(operands(spark, sf_dir), "b1", X.BODIES, F.col("a"))


@query("eval_loop")
def _(spark, sf_dir):
    rows = evaluation.apply_operators(operands(spark, sf_dir), {"sum": "l1", "power": "l2"}, X.BODIES, F.col("a"), F.col("b"))
    return rows.select("l_orderkey", "l_linenumber", "a", "b", *[F.col(f"{n}.{part}").alias(f"{n}_{part}") for n in ("sum", "power") for part in ("value", "cost")])


@query("eval_nested_loop")
def _(spark, sf_dir):
    rows = operands(spark, sf_dir).select("l_orderkey", "l_linenumber", F.pmod("a", F.lit(9)).alias("a"), "b")
    return evaluation.apply_operator(rows, "l3", X.BODIES, F.col("a"), F.col("b"))


@query("call_binary")
def _(spark, sf_dir):
    names = ("p1", "m1", "t1", "d1", "r1")
    rows = evaluation.apply_operators(operands(spark, sf_dir), {f: f for f in names}, X.BODIES, F.col("a"), F.col("b"))
    return rows.select("l_orderkey", "l_linenumber", "a", "b", *[F.col(f"{f}.value").alias(f) for f in names])


@query("cmp")
def _(spark, sf_dir):
    x = F.when(F.col("b") == 0, F.lit(float("nan"))).when(F.col("b") == 1, F.lit(float("inf"))).otherwise(F.col("b").cast("double"))
    y = (F.col("a") % 5).cast("double")
    names = {"==": "eq", ">": "gt", "<": "lt", ">=": "ge", "<=": "le", "!=": "ne"}
    return operands(spark, sf_dir).select("l_orderkey", "l_linenumber", *[compare(op, x, y).alias(n) for op, n in names.items()])


@query("bool_and")
def _(spark, sf_dir):
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    return operands(spark, sf_dir).select("l_orderkey", "l_linenumber", (compare(">", a, F.lit(100.0)) & compare("<", b, F.lit(2.0))).alias("both"))


@query("bool_or")
def _(spark, sf_dir):
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    return operands(spark, sf_dir).select("l_orderkey", "l_linenumber", (compare(">", a, F.lit(100.0)) | compare("<", b, F.lit(2.0))).alias("either"))


@query("bool_not")
def _(spark, sf_dir):
    x = F.when(F.col("b") == 0, F.lit(float("nan"))).otherwise(F.col("b").cast("double"))
    return operands(spark, sf_dir).select("l_orderkey", "l_linenumber", (~compare(">", x, F.lit(0.0))).alias("negated"))


@query("lit_nan")
def _(spark, sf_dir):
    c = Compiler(X.BODIES | {"n1": (("a",), L.Branches(((L.Undefined(), L.Cmp(">", L.Var("a"), L.Num(1000))), (L.Var("a"), None))))})
    return operands(spark, sf_dir).select("l_orderkey", "l_linenumber", bases.value_text(c.value("n1", F.col("a").cast("double"))).alias("value"))


@query("loop_limit")
def _(spark, sf_dir):
    """Loops of each limited order on both sides of their limit."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    for order, most in LOOP_LIMITS.items():
        bodies = X.BODIES | {"deep": (("a", "b"), L.Loop("l1", L.Num(1), ("r", "a"), most))}
        b = (F.col("l_linenumber") - 4 + most) * F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1)
        rows = evaluation.apply_operator(rows, "deep", bodies, F.lit(0), b).withColumnsRenamed({"value": f"value{order}", "cost": f"cost{order}"})
    return rows


@query("loop_text")
def _(spark, sf_dir):
    return cat(spark).where("definition_type = 'recursive_definition'").select("func_id", "definition")


# Corpus


@query("render_expr")
def _(spark, sf_dir):
    return record_table(spark, sf_dir, fields=["id", "expression"]).select(F.col("id").alias("expr_id"), "expression")


@query("render_brackets")
def _(spark, sf_dir):
    return record_table(spark, sf_dir, brackets=True, fields=["id", "expression"]).select(F.col("id").alias("expr_id"), "expression")


@query("render_no_base")
def _(spark, sf_dir):
    return record_table(spark, sf_dir, fields=["id", "expression_no_base_symbol"]).select(F.col("id").alias("expr_id"), F.col("expression_no_base_symbol").alias("expression"))


@query("tree_json")
def _(spark, sf_dir):
    return record_table(spark, sf_dir, fields=["id", "tree"]).select(F.col("id").alias("expr_id"), "tree")


@query("eval_tree")
def _(spark, sf_dir):
    return record_table(spark, sf_dir, fields=["id", "result", "normalized_expansion_degree"]).select(F.col("id").alias("expr_id"), "result", F.col("normalized_expansion_degree").cast("long").alias("degree"))


@query("eval_tree_loops")
def _(spark, sf_dir):
    """Trees over the whole pool, loops included, in base 16 with results in base 2."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("expr_id"))
    rows = expressions.grow_rows(ids, (*POOLS[0], "l1", "l2", "l3"), *POOLS[1:])
    return expressions.records(rows, cat(spark, [POSTFIX]), BODIES, base=16, result_base=2, longer_base=16).select("id", "text", "highest_n_order", "normalized_expansion_degree", "cot")


@query("longer_result")
def _(spark, sf_dir):
    return record_table(spark, sf_dir, fields=["id", "longer_result_info"]).select(F.col("id").alias("expr_id"), F.col("longer_result_info.flag").alias("flag"))


def _from_records(name, *columns):
    QUERIES[name] = lambda spark, sf_dir: record_table(spark, sf_dir, fields=["id", *columns])


_from_records("expansion_degree", "normalized_expansion_degree")
_from_records("result_text", "result")
_from_records("highest_order", "highest_n_order")
_from_records("priority_complexity", "priority_hierarchical_complexity")
_from_records("operation_count", "operation_count")
_from_records("complexity_ratio", "complexity_ratio")
_from_records("record_text", "text")
_from_records("dependent_ops", "dependent_operators")
_from_records("used_ops", "used_operators")


@query("cot_trace")
def _(spark, sf_dir):
    return record_table(spark, sf_dir, fields=["id", "cot"]).select("id", F.posexplode("cot").alias("step", "c")).select("id", F.col("step").cast("long").alias("step"), "c.info", "c.layer")


@query("number_count")
def _(spark, sf_dir):
    return tree(spark, sf_dir).groupBy("expr_id").agg(F.count_if(F.col("kind") == "num").alias("n"))


@query("evaluate")
def _(spark, sf_dir):
    """The whole record; its structs as JSON text."""
    nested = ("longer_result_info", "cot_info", "cot")
    return record_table(spark, sf_dir).select(*[F.to_json(f.name).alias(f.name) if f.name in nested else F.col(f.name) for f in EXPRESSION.fields])


# Acceptance


@query("uses_both_args")
def _(spark, sf_dir):
    return cat(spark, EXTRA, sf_dir).where("op_compute_func IS NOT NULL AND n_ary = 2").select("func_id", generation.uses_arguments(F.col("op_compute_func"), F.col("n_ary")).alias("ok"))


@query("uses_arg")
def _(spark, sf_dir):
    return cat(spark, EXTRA, sf_dir).where("op_compute_func IS NOT NULL AND n_ary = 1").select("func_id", generation.uses_arguments(F.col("op_compute_func"), F.col("n_ary")).alias("ok"))


@query("not_wrapper")
def _(spark, sf_dir):
    return cat(spark, EXTRA, sf_dir).where("op_compute_func IS NOT NULL").select("func_id", (~generation.is_wrapper(F.col("op_compute_func"), F.col("n_ary"))).alias("ok"))


@query("distinct_returns")
def _(spark, sf_dir):
    return cat(spark, EXTRA, sf_dir).where("op_compute_func IS NOT NULL").select("func_id", generation.distinct_returns(F.col("op_compute_func")).alias("ok"))


@query("body_hash")
def _(spark, sf_dir):
    return cat(spark, EXTRA, sf_dir).where("op_compute_func IS NOT NULL").select("func_id", generation.body_hash(F.col("op_compute_func")).alias("hash"))


@query("body_dedupe")
def _(spark, sf_dir):
    """By text, with the catalog's own bodies left out."""
    body = F.regexp_replace("op_compute_func", r"^[^\n]*\n", "")
    have = cat(spark).where("op_compute_func IS NOT NULL AND func_id <> 's1'").select(body.alias("body"))
    rows = cat(spark, EXTRA, sf_dir).where("op_compute_func IS NOT NULL").select("id", "func_id", body.alias("body")).join(have, "body", "left_anti")
    return rows.groupBy("body").agg(F.min_by("func_id", "id").alias("func_id")).select("func_id")


@query("order_match")
def _(spark, sf_dir):
    return C.orders(cat(spark)).where("n_order = 2").select("func_id")


@query("accept_pipeline")
def _(spark, sf_dir):
    """Rows that repeat, wrap or waste, and those of the catalog itself as candidates of order 1, against the catalog without them."""
    every = cat(spark, EXTRA)
    return generation.accept(every.where("op_compute_func IS NOT NULL").select("func_id", "n_ary", "op_compute_func", "dependencies"), cat(spark).withColumn("op_compute_func", F.lit(None).cast("string")), BODIES, 1)


@query("accept_generated")
def _(spark, sf_dir):
    """Generated definitions, compiled, that pass all filters."""
    rows = _compiled(spark, sf_dir, "ok", "op_compute_func", "dependencies").where("ok").select("func_id", F.when(F.col("shape") == "binary", 2).otherwise(1).alias("n_ary"), "op_compute_func", "dependencies")
    return generation.accept(rows, cat(spark, [POSTFIX]), BODIES, 1)


@query("property_check")
def _(spark, sf_dir):
    """Every operator of the catalog that has a function; one that returns no number is not among them."""
    bad = POSTFIX | {"id": 21, "func_id": "t9", "op_compute_func": "def op_t9(a):\n    return op_none(a, a)"}
    rows = cat(spark, [*EXTRA, bad]).where("op_compute_func IS NOT NULL AND size(dependencies) > 0").select("func_id", "op_compute_func")
    return generation.holds_up(rows, BODIES).select("func_id", F.col("holds").alias("ok"))


# Drivers


@query("layer_sizes")
def _(spark, sf_dir):
    return generation.layer_sizes(spark, 100_000)


@query("order_histogram")
def _(spark, sf_dir):
    have = cat(spark, parts=sf_dir).groupBy("n_order").count()
    return spark.range(1, 6).select(F.col("id").cast("int").alias("n_order")).join(have, "n_order", "left").select("n_order", F.coalesce("count", F.lit(0)).alias("n"))


@query("layer_deficit")
def _(spark, sf_dir):
    have = cat(spark, parts=sf_dir).groupBy(F.col("n_order").alias("layer")).count()
    return generation.layer_sizes(spark, 100).join(have, "layer", "left").select("layer", F.greatest(F.col("size") - F.coalesce("count", F.lit(0)), F.lit(0)).alias("missing"))


@query("generation_run")
def _(spark, sf_dir):
    """A run that goes on from the catalog until five layers hold twice as many operators as there are parts; all that it adds."""
    sizes = generation.layer_sizes(spark, 2 * table(spark, sf_dir, "part").count())
    made = runs.fill(cat(spark, [POSTFIX], sf_dir), {r["layer"]: r["size"] for r in sizes.collect()}, SYMBOL_POOLS, NAME_POOLS)
    return made.select("func_id", "n_ary", "n_order", "op_compute_func", "dependencies")


@query("type_mix")
def _(spark, sf_dir):
    rows = C.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey"))
    share = int(rows.count() * 0.2)
    kind = F.when(F.col("place") <= share, "simple_definition").when(F.col("place") <= 2 * share, "branch_definition").when(F.pmod(draws.bits(F.col("o_orderkey"), "mix"), F.lit(2)) == 0, "simple_definition").otherwise("branch_definition")
    return rows.select("o_orderkey", kind.alias("definition_type"))


@query("sequence_ids")
def _(spark, sf_dir):
    return C.numbered(cat(spark, parts=sf_dir).select("func_id"), F.col("func_id")).select("func_id", (F.col("place") + 100).cast("long").alias("id"))


@query("resume_topup")
def _(spark, sf_dir):
    """A run that was cut short after 37 expressions writes the rest of its 100."""
    at, target = scratch.path(spark, "expressions"), 100
    make = lambda ids: expressions.records(expressions.grow_rows(ids.select(F.col("id").alias("expr_id")), *POOLS), tree_operators(spark), BODIES, largest=DEFAULT.value_range[1], depth=2)
    make(spark.range(1, 38)).write.json(at)
    make(spark.range(jsonl.count_lines(spark, at) + 1, target + 1)).write.mode("append").json(at)
    return spark.read.schema(EXPRESSION).json(at).groupBy("id").agg(F.count("*").alias("times"))


@query("per_op_corpus")
def _(spark, sf_dir):
    """Expressions of each operator without loops, evaluated; their ids number all of them."""
    names, per = [f for pool in POOLS for f in pool], 1000
    ops = cat(spark, [POSTFIX]).where(F.col("func_id").isin(*names)).select("func_id", "n_ary", (F.array_position(F.array(*[F.lit(f) for f in names]), F.col("func_id")) - 1).alias("nth"))
    rows = ops.select("func_id", "n_ary", F.explode(F.sequence(F.col("nth") * per, F.col("nth") * per + per - 1)).alias("expr_id"))
    return expressions.records(_one_operator(rows, F.concat_ws("/", "func_id", F.col("expr_id").cast("string"))), tree_operators(spark), BODIES, largest=DEFAULT.value_range[1], depth=1, fields=["id", "used_operators", "text"]).select("id", F.get("used_operators", F.lit(0)).alias("func_id"), "text")


@query("base_record")
def _(spark, sf_dir):
    """M0: one branch operator over lineitem: value, cost, base-16 literal and text."""
    out = evaluation.apply_operator(operands(spark, sf_dir), "b1", X.BODIES, F.col("a"))
    text = F.concat(F.lit("(∇"), F.col("a").cast("string"), F.lit(")"))
    return out.select("l_orderkey", "l_linenumber", "value", "cost", bases.literal(F.col("value").cast("long"), 16, F.lit("⊠")).alias("literal"), F.concat(text, F.lit("="), "value").alias("text"))


# The same parts on their own


@query("count_branch")
def _(spark, sf_dir):
    return evaluation.apply_operator(operands(spark, sf_dir), "b1", X.BODIES, F.col("a")).select("l_orderkey", "l_linenumber", "cost")


@query("count_loop")
def _(spark, sf_dir):
    return evaluation.apply_operator(operands(spark, sf_dir), "l1", X.BODIES, F.col("a"), F.col("b")).select("l_orderkey", "l_linenumber", "cost")


@query("call_prefix")
def _(spark, sf_dir):
    return evaluation.apply_operator(operands(spark, sf_dir), "b1", X.BODIES, F.col("b")).select("l_orderkey", "l_linenumber", "value")


@query("call_postfix")
def _(spark, sf_dir):
    return evaluation.apply_operator(operands(spark, sf_dir), "q1", BODIES, F.col("b")).select("l_orderkey", "l_linenumber", "value")


@query("loop_args")
def _(spark, sf_dir):
    """Each argument pattern of loops over addition and multiplication, from a."""
    made = {"".join(args) + mark: (("a", "b"), L.Loop(callee, L.Var("a"), args)) for callee, mark in (("p1", ""), ("t1", "_product")) for args in generation.PATTERNS}
    rows = evaluation.apply_operators(operands(spark, sf_dir), {name: name for name in made}, X.BODIES | made, F.col("a"), F.col("b"))
    return rows.select("l_orderkey", "l_linenumber", "a", "b", *[F.col(f"{name}.value").alias(name) for name in made])


@query("compile_branches")
def _(spark, sf_dir):
    """How many returns and conditions the compiled text of generated branches has."""
    src = F.col("op_compute_func")
    rows = _compiled(spark, sf_dir, "op_compute_func", kind="branch_definition")
    return rows.select("func_id", F.regexp_count(src, F.lit("return ")).alias("returns"), F.regexp_count(src, F.lit(r"\bif ")).alias("ifs"), F.regexp_count(src, F.lit(r"elif ")).alias("elifs"))


@query("valid_syntax")
def _(spark, sf_dir):
    return cat(spark, [POSTFIX | {"id": 20, "func_id": "bad", "op_compute_func": "def op_bad(a:\n    return a"}], sf_dir).where("op_compute_func IS NOT NULL").select("func_id", generation.parses(F.col("op_compute_func")).alias("ok"))


@query("expr_str")
def _(spark, sf_dir):
    return record_table(spark, sf_dir, brackets=True, fields=["id", "expression"]).select(F.col("id").alias("expr_id"), "expression", F.length("expression").cast("long").alias("n_chars"))


@query("cot_info_trace")
def _(spark, sf_dir):
    return record_table(spark, sf_dir, fields=["id", "cot_info"]).select("id", F.posexplode("cot_info").alias("step", "c")).select("id", F.col("step").cast("long").alias("step"), "c.info", "c.layer")


@query("branch_gen")
def _(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit("⊛").alias("symbol"))
    return generation.definitions(keys, pools=SYMBOL_POOLS).where("definition_type = 'branch_definition'").select("key", F.size(F.split("definition", ";")).alias("branches"))


@query("operator_gen")
def _(spark, sf_dir):
    """Operator rows with drawn symbols, shapes and definitions; symbols of the catalog are not drawn again."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    named = generation.symbols(keys, generation.SIGNS, cat(spark).select("symbol"))
    rows = generation.definitions(named, pools=SYMBOL_POOLS)
    return rows.select("key", F.concat(F.lit("g"), F.col("key").cast("string")).alias("func_id"), "symbol", F.when(F.col("shape") == "binary", 2).otherwise(1).alias("n_ary"), F.when(F.col("shape") != "binary", F.col("shape")).alias("unary_position"), "definition_type", "definition")


@query("combo_expr")
def _(spark, sf_dir):
    return record_table(spark, sf_dir, fields=["id", "text", "used_operators"]).select("id", "text", F.size("used_operators").alias("n_used"))
