"""Generation runs: layers of a catalog filled to their sizes, from nothing or on top of what is there, with redraws until they are full.

Attempts of a layer are numbered, and an attempt's draws follow from its number and layer alone. An operator is accepted if it passes the filters and no
smaller attempt, and no operator of the catalog, has its body; a layer's operators are the first accepted ones. So the result is the same whatever
the rounds: how many attempts a round makes, and how often a run stops and goes on between layers, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..schema import OPERATOR
from ..sources.scratch import discard, save
from . import generation as G
from .catalog import numbered

#: Rounds in succession, each twice as wide as the last, that may accept nothing before a layer counts as exhausted.
DRY = 4
#: Attempts of a round at least.
LEAST = 1024
#: A key is an attempt's number times this, plus the layer.
LAYERS = 10


def body_of(src: str = "op_compute_func") -> Column:
    return F.regexp_replace(src, r"^[^\n]*\n", "")


def _rows(rows: DataFrame) -> DataFrame:
    """The columns of a catalog and key; those that rows doesn't have are null."""
    have = {f: rows[f] for f in rows.columns}
    return rows.select("key", *[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in OPERATOR.fields])


def simple_operators(keys: DataFrame, symbols: G.Pools, names: G.Pools, settings: Settings = DEFAULT) -> DataFrame:
    """keys (key, symbol) as operators of one expression: definition and value function, both from the same draws.

    symbols and names hold symbols and func_ids of the same operators in the same order; those are to be of order 1.
    """
    k, sh = F.col("key"), F.col("shape")
    rows = keys.withColumn("shape", G.shapes(k)).withColumn("func_id", F.concat(F.lit("g"), k.cast("string")))
    definition = F.concat(G.left_side(F.col("symbol"), sh), F.lit(" = { "), G.body(k, "b0", sh, symbols, settings), F.lit(" }"))
    binary = sh == "binary"
    source = F.concat(F.lit("def op_"), F.col("func_id"), F.when(binary, "(a, b)").otherwise("(a)"), F.lit(":\n    return "), G.body(k, "b0", sh, names, settings, source=True))
    rows = rows.select(
        "key", "func_id", "symbol", F.when(binary, 2).otherwise(1).alias("n_ary"), F.when(~binary, sh).alias("unary_position"), F.lit(1).alias("n_order"), definition.alias("definition"),
        F.lit("simple_definition").alias("definition_type"), source.alias("op_compute_func"),
    )
    called = F.array_sort(F.array_distinct(F.regexp_extract_all(body_of(), F.lit(r"op_(\w+)\("), F.lit(1))))
    return rows.withColumn("dependencies", called)


def passes(rows: DataFrame) -> DataFrame:
    """The rows that use their arguments, wrap no other operator and return nothing twice. All are read off the function text."""
    src, arity = F.col("op_compute_func"), F.col("n_ary")
    return rows.where(src.isNotNull()).where(G.uses_arguments(src, arity) & ~G.is_wrapper(src, arity) & G.distinct_returns(src))


def draw(layer: int, keys: DataFrame, cat: DataFrame, symbols: G.Pools, names: G.Pools, settings: Settings = DEFAULT) -> DataFrame:
    """Candidates of a layer for keys (key): operators of one expression in the first, loops over the layer below in all others."""
    named = keys.withColumn("symbol", G.number_in_signs(F.col("key"), G.SIGNS, settings))
    if layer == 1:
        return simple_operators(named, symbols, names, settings)
    below = cat.where(F.col("n_order") == layer - 1)
    return G.recursive_operators(named.withColumn("n_order", F.lit(layer)), below).withColumn("n_ary", F.lit(2))


def fill_layer(cat: DataFrame, layer: int, missing: int, candidates: Callable[[int, DataFrame, DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame] = passes) -> DataFrame:
    """The missing operators of a layer, in a catalog's columns. A layer whose draws hold no more new bodies is an error."""
    spark = cat.sparkSession
    known = save(cat.where("op_compute_func IS NOT NULL").select(body_of().alias("body")).distinct(), "bodies")
    found: list[DataFrame] = []
    have, tried, dry, width = 0, 0, 0, max(LEAST, 4 * missing)
    while have < missing:
        keys = spark.range(tried, tried + width).select((F.col("id") * LAYERS + layer).alias("key"))
        drawn = save(_rows(candidates(layer, keys, cat)), "candidates")  # so that filters read function text, and don't draw it again
        rows = keep(drawn).withColumn("body", body_of())
        first = rows.groupBy("body").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "body"]), "key").alias("row")).join(known, "body", "left_anti")
        for part in found:
            first = first.join(part.select("body"), "body", "left_anti")
        new = save(first.select("body", "row.*"), "accepted")
        discard(drawn)
        found.append(new)
        got = new.count()
        tried, have = tried + width, have + got
        dry = dry + 1 if got == 0 else 0
        if have < missing and dry == DRY:
            raise ValueError(f"layer {layer}: {have} of {missing} operators after {tried} attempts, and no new bodies")
        width = 2 * width if got == 0 else max(LEAST, min(8 * width, int(1.2 * (missing - have) * width / got)))
    every = found[0]
    for part in found[1:]:
        every = every.unionAll(part)
    kept = save(numbered(every.drop("body"), F.col("key")).where(F.col("place") <= missing).select(*[f.name for f in OPERATOR.fields]), "layer")
    discard(known, *found)
    return kept


def fill(cat: DataFrame, sizes: dict[int, int], symbols: G.Pools, names: G.Pools, settings: Settings = DEFAULT, keep: Callable[[DataFrame], DataFrame] = passes) -> DataFrame:
    """The new operators of a run: each layer, from the lowest, gets what it lacks of its size (layers 1 to 9).

    cat is what there is: base operators alone for a fresh run, an earlier run's catalog and operators for one that goes on. A layer draws loops over all of the layer below,
    old and new. Layers that have enough are left as they are; operators without an order are nobody's.
    """
    candidates = partial(draw, symbols=symbols, names=names, settings=settings)
    have = {r[0]: r[1] for r in cat.where(F.col("n_order").isin(*sizes)).groupBy("n_order").count().collect()}
    made: Sequence[DataFrame] = []
    now = cat
    for layer, size in sorted(sizes.items()):
        missing = size - have.get(layer, 0)
        if missing > 0:
            new = fill_layer(now, layer, missing, candidates, keep)
            made, now = [*made, new], now.unionByName(new)
    out = cat.limit(0) if not made else made[0]
    for part in made[1:]:
        out = out.unionByName(part)
    return out
