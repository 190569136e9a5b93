"""Catalog lookups, mutation, and attributes derived from its dependency graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, save


def shape() -> Column:
    return F.coalesce("unary_position", F.lit("binary"))


def by_func_id(cat: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (func_id) with found and the symbol; misses are reported, not dropped."""
    return wanted.join(cat, "func_id", "left").select("func_id", F.col("symbol").isNotNull().alias("found"), "symbol")


def resolve(cat: DataFrame, asked: DataFrame) -> DataFrame:
    """(symbol, n_ary, unary_position) -> the first operator so written; func_id null where there is none."""
    first = cat.groupBy("symbol", "n_ary", "unary_position").agg(F.min_by("func_id", "id").alias("func_id"))
    same = (asked["symbol"] == first["symbol"]) & (asked["n_ary"] == first["n_ary"]) & asked["unary_position"].eqNullSafe(first["unary_position"])
    return asked.join(first, same, "left").select(asked["symbol"], asked["n_ary"], asked["unary_position"], first["func_id"])


def add(cat: DataFrame, new: DataFrame) -> DataFrame:
    """cat with the new rows; a func_id that is there already is an error."""
    twice = new.join(cat, "func_id", "left_semi").select("func_id").limit(5).collect()
    if twice:
        raise ValueError(f"already in the catalog: {[r[0] for r in twice]}")
    return cat.unionByName(new)


def remove(cat: DataFrame, gone: DataFrame) -> DataFrame:
    return cat.join(gone, "func_id", "left_anti").select(*cat.columns)


def update(cat: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of changed take the place of those with their func_id; their n_order is to be computed anew."""
    return remove(cat, changed.select("func_id")).unionByName(changed.join(cat, "func_id", "left_semi").select(*cat.columns).withColumn("n_order", F.lit(None).cast("int")))


def extract_dependencies(cat: DataFrame) -> DataFrame:
    """(func_id, deps): the operators that a value function calls, itself left out, in order of first call."""
    found = F.array_distinct(F.regexp_extract_all("op_compute_func", F.lit(r"op_(\w+)\("), F.lit(1)))
    return cat.select("func_id", F.coalesce(F.array_except(found, F.array("func_id")), F.array().cast("array<string>")).alias("deps"))


def edges(cat: DataFrame) -> DataFrame:
    """(src, dst): dst calls src."""
    return cat.select(F.explode("dependencies").alias("src"), F.col("func_id").alias("dst"))


def chains(step: DataFrame, nodes: DataFrame) -> DataFrame:
    """(func_id, head, dist, tail): runs of nodes that hang on one another alone, found by pointer doubling; other nodes are runs of one.

    step: (src, dst, w). A node follows the one before it in a run if it is that one's only dependent and depends on nothing else. dist is the sum of w from the
    head on. Rounds are logarithmic in the longest run; a ring, in which no node is a head, is an error.
    """
    alone = step.groupBy("src").agg(F.count("*").alias("outs"), F.first("dst").alias("dst"), F.first("w").alias("w")).where("outs = 1").select(F.col("src").alias("at"), F.col("dst").alias("func_id"), "w")
    single = step.groupBy("dst").agg(F.count("*").alias("ins")).where("ins = 1").select(F.col("dst").alias("func_id"))
    links = alone.join(single, "func_id").select("func_id", F.col("at").alias("head"), F.col("w").cast("long").alias("dist"))
    at = save(nodes.join(links, "func_id", "left").select("func_id", F.coalesce("head", "func_id").alias("head"), F.coalesce("dist", F.lit(0)).alias("dist"), F.col("head").isNotNull().alias("inner")), "chains")
    first, jumped = at, 1
    total = nodes.count()
    while True:
        up = at.select(F.col("func_id").alias("head"), F.col("head").alias("above"), F.col("dist").alias("more"), F.col("inner").alias("on"))
        new = save(at.where("inner").join(up, "head").select("func_id", F.col("above").alias("head"), (F.col("dist") + F.col("more")).alias("dist"), "on").withColumnRenamed("on", "inner").unionByName(at.where("NOT inner")), "chains")
        open_ = new.where("inner")
        if at is not first:
            discard(at)
        at, jumped = new, jumped * 2
        if open_.isEmpty():
            break
        if jumped > 2 * total:
            raise ValueError("the dependencies have a cycle")
    tails = first.where("inner").select(F.col("head").alias("func_id")).distinct()  # these have a follower
    return at.select("func_id", "head", "dist").join(tails.withColumn("followed", F.lit(True)), "func_id", "left").select("func_id", "head", "dist", F.col("followed").isNull().alias("tail"))


def levels(cat: DataFrame, weight: Column | None = None) -> DataFrame:
    """(func_id, level): the longest path that ends at an operator; weight(dst) is what a step adds (1 unless given).

    Runs of operators that hang on one another alone are one node each (see chains), so a long chain takes a logarithm of
    its length in rounds. What is left is peeled: in a round go all nodes whose predecessors are gone. Each round is a written table of
    the nodes that remain, and nodes that never go are a cycle.
    """
    nodes = save(cat.select("func_id", (weight if weight is not None else F.lit(1)).alias("w")), "nodes")
    step = save(edges(cat).distinct().join(nodes.select(F.col("func_id").alias("dst"), "w"), "dst").join(nodes.select(F.col("func_id").alias("src")), "src"), "edges")
    runs = save(chains(step, nodes), "runs")
    place = runs.select(F.col("func_id").alias("src"), F.col("head").alias("from"), "dist")
    to = runs.where("head = func_id").select(F.col("func_id").alias("dst"))
    between = save(step.join(to, "dst").join(place, "src").select("from", "dst", (F.col("dist") + F.col("w")).alias("gain")), "between")  # into heads alone
    ins = between.groupBy("dst").agg(F.count("*").alias("left"))
    left = save(to.join(ins, "dst", "left").select("dst", F.coalesce("left", F.lit(0)).alias("left"), F.lit(0).cast("long").alias("level")), "left")
    gone = []
    while True:
        ready = left.where("left = 0").select("dst", "level")
        if ready.isEmpty():
            break
        gone.append(left)
        given = between.join(ready.select(F.col("dst").alias("from"), "level"), "from").groupBy("dst").agg(F.count("*").alias("n"), F.max(F.col("level") + F.col("gain")).alias("up"))
        left = save(left.where("left > 0").join(given, "dst", "left").select("dst", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")), "left")
    if not left.isEmpty():
        raise ValueError("the dependencies have a cycle")
    if not gone:
        return runs.select("func_id", F.col("dist").alias("level"))
    heads = gone[0].where("left = 0")
    for part in gone[1:]:
        heads = heads.unionAll(part.where("left = 0"))
    out = save(runs.join(heads.select(F.col("dst").alias("head"), "level"), "head").select("func_id", (F.col("level") + F.col("dist")).alias("level")), "levels")
    discard(nodes, step, runs, between, left, *gone)
    return out


def orders(cat: DataFrame) -> DataFrame:
    """(func_id, n_order): 1 without dependencies; a recursive operator is one above the highest that it calls; null for base operators."""
    plain = cat.where("is_base IS NULL")
    recursive = F.when(F.col("definition_type") == "recursive_definition", 1).otherwise(0)
    return levels(plain, recursive).select("func_id", (F.col("level") + 1).alias("n_order"))


def closure(cat: DataFrame, roots: DataFrame) -> DataFrame:
    """func_id of roots and of all that depends on them: a frontier grown until nothing is new, so a cycle ends too.

    A frontier passes a run of operators that hang on one another alone at once (see chains); rings have no heads and are walked.
    """
    step = save(edges(cat).distinct().select("src", "dst", F.lit(1).alias("w")), "edges")
    nodes = step.select(F.explode(F.array("src", "dst")).alias("func_id")).unionAll(roots.select("func_id")).distinct()
    try:
        runs = save(chains(step, nodes), "runs")
    except ValueError:  # a ring
        runs = save(nodes.select("func_id", F.col("func_id").alias("head"), F.lit(0).cast("long").alias("dist"), F.lit(True).alias("tail")), "runs")
    tails = runs.where("tail").select("head", F.col("func_id").alias("src"))
    seen = save(roots.select("func_id").distinct(), "closure")
    front = seen
    while True:
        reached = front.join(runs.select("func_id", "head"), "func_id").join(tails, "head").join(step, "src").select(F.col("dst").alias("func_id"))
        new = save(reached.distinct().join(seen, "func_id", "left_anti"), "front")
        if new.isEmpty():
            break
        before, seen, front = seen, save(seen.unionAll(new), "closure"), new
        if before is not front:
            discard(before)
    entries = seen.join(runs, "func_id").groupBy("head").agg(F.min("dist").alias("least"))
    return save(runs.join(entries, "head").where("dist >= least").select("func_id").unionAll(roots.select("func_id")).distinct(), "closed")


def renumber(cat: DataFrame) -> DataFrame:
    """(func_id, new_id, new_dependencies): dense numbers by func_id, the references following."""
    ids = numbered(cat.select("func_id"), F.col("func_id")).select("func_id", F.col("place").cast("long").alias("new_id"))
    deps = cat.select("func_id", F.posexplode("dependencies").alias("pos", "dep")).join(ids.select(F.col("func_id").alias("dep"), F.col("new_id").alias("to")), "dep")
    lists = deps.groupBy("func_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "to"))), lambda x: x["to"]).alias("deps"))
    return ids.join(lists, "func_id", "left").select("func_id", "new_id", F.coalesce("deps", F.array().cast("array<bigint>")).alias("new_dependencies"))


def fresh_symbols(cat: DataFrame, candidates: DataFrame) -> DataFrame:
    """cat's (func_id, symbol) where the second holder of a (symbol, arity, position) and later ones get unused candidates (symbol), in order."""
    same = Window.partitionBy("symbol", "n_ary", "unary_position").orderBy("id")
    ranked = cat.select("func_id", "id", "symbol", F.row_number().over(same).alias("rn"))
    late = ranked.where("rn > 1").withColumn("k", F.row_number().over(Window.orderBy("id")))
    free = candidates.join(cat.select("symbol").distinct(), "symbol", "left_anti").withColumn("k", F.row_number().over(Window.orderBy("symbol")))
    new = late.join(free.select("k", F.col("symbol").alias("new_symbol")), "k").select("func_id", "new_symbol")
    return ranked.join(new, "func_id", "left").select("func_id", F.coalesce("new_symbol", "symbol").alias("symbol"))


def dependency_rows(cat: DataFrame) -> DataFrame:
    """(primitive_op_id, derived_op_id_list, level): who calls an operator, in topological order by level."""
    called = edges(cat).groupBy(F.col("src").alias("func_id")).agg(F.sort_array(F.collect_set("dst")).alias("derived"))
    return levels(cat).join(called, "func_id", "left").select(F.col("func_id").alias("primitive_op_id"), F.coalesce("derived", F.array().cast("array<string>")).alias("derived_op_id_list"), "level")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place, from 1 in order: ranges are numbered inside and shifted by the sizes of those before, so no task holds all rows.

    Rows that tie in order are numbered in any order. The window over ranges has as many rows as there are partitions.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = save(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("__range").agg(F.count("*").alias("rows")).select("__range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__shift"))
    inside = ranged.withColumn("__nth", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return inside.join(shift, "__range").select(*rows.columns, (F.col("__shift") + F.col("__nth")).alias("place"))
