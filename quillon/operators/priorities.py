"""Priorities and sides of a whole catalog: each operator takes an open level or opens one above the highest.

Prefix operators come first and take right-associative levels, then postfix ones with left-associative levels, then binary ones
with any; in each phase the order is that of ids. With n levels to choose from, the n-th of n + 1 equal parts of an operator's draw
opens a level. So an operator opens one just if no more than ``reach`` levels are open, and what a run of operators does to the number of
open levels is a function that grows by 0 or 1 from one number to the next. The numbers where it doesn't grow (``drops``)
say all of it, and there are about sqrt(2 n) of them for n operators: ranges of the catalog are summed up at once,
a fold over ranges finds the number that each one starts with, and a second pass over ranges deals the levels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..sources.scratch import save
from .catalog import shape

BITS = 1 << 32


def reach(bits: np.ndarray) -> np.ndarray:
    """The largest number of open levels at which a draw opens another: bits * (n + 1) >= n * 2**32."""
    return bits // (BITS - bits)


def drops(reaches: Iterable[int], before: np.ndarray) -> np.ndarray:
    """The drops of a run of operators after those of the run before it, ascending."""
    d = before
    for x in reaches:
        if x >= len(d):
            at = np.searchsorted(d - np.arange(len(d)), x - len(d), side="right")
            d = np.insert(d, at, x - len(d) + at)
    return d


def runs(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[tuple[int, int], pd.DataFrame]]:
    """((range, phase), rows) of a stream that is sorted by both; a run may come in several parts."""
    for rows in batches:
        yield from ((key, part) for key, part in rows.groupby(["range", "phase"], sort=True))


def _summaries(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, found = None, np.empty(0, dtype=np.int64)
    row = lambda: pd.DataFrame({"range": [now[0]], "phase": [now[1]], "drops": [found]})
    for key, part in runs(batches):
        if key != now:
            if now is not None:
                yield row()
            now, found = key, np.empty(0, dtype=np.int64)
        found = drops(reach(part["bits"].to_numpy(np.int64)), found)
    if now is not None:
        yield row()


def _dealt(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, open_ = None, 0
    for key, part in runs(batches):
        if key != now:
            now, open_ = key, int(part["at"].iloc[0])
        bits = part["bits"].to_numpy(np.int64)
        far, opens, start = reach(bits), np.zeros(len(part), dtype=np.int64), open_
        for i in np.flatnonzero(far >= open_):
            if far[i] >= open_:
                opens[i], open_ = 1, open_ + 1
        at = start + np.cumsum(opens) - opens
        yield pd.DataFrame({"func_id": part["func_id"], "phase": part["phase"], "priority": bits * (at + 1) // BITS + 1 + part["base"], "opens": opens.astype(bool)})


def starts(summaries: DataFrame) -> DataFrame:
    """(range, phase, at, base): levels open to a range's phase at its start, and those that lie below them and aren't. One fold over ranges, however many operators."""
    parts = F.array_sort(F.collect_list(F.struct("phase", "range", "drops")))
    zero = F.lit(0).cast("long")
    none = F.expr("cast(array() as array<struct<range:int,phase:int,at:bigint,base:bigint>>)")

    def step(s: Column, p: Column) -> Column:
        new = p["phase"] != s["phase"]
        below = F.when(new, s["below"] + F.when(s["phase"] < 0, zero).otherwise(s["at"])).otherwise(s["below"])
        at = F.when(new, F.when(p["phase"] == 2, below).otherwise(zero)).otherwise(s["at"])
        here = F.struct(p["range"].alias("range"), p["phase"].alias("phase"), at.alias("at"), F.when(p["phase"] == 1, below).otherwise(zero).alias("base"))
        after = at + F.size(F.filter(p["drops"], lambda d: d >= at)).cast("long")
        return F.struct(p["phase"].alias("phase"), after.alias("at"), below.alias("below"), F.array_append(s["out"], here).alias("out"))

    first = F.struct(F.lit(-1).alias("phase"), zero.alias("at"), zero.alias("below"), none.alias("out"))
    return summaries.agg(F.aggregate(parts, first, step)["out"].alias("out")).select(F.inline("out"))


def assign(cat: DataFrame) -> DataFrame:
    """(func_id, priority, side) of every operator; all of a level have one side. An empty catalog gives no rows."""
    spark, kind = cat.sparkSession, shape()
    phase = F.when(kind == "prefix", 0).when(kind == "postfix", 1).otherwise(2)
    rows = cat.select("func_id", "id", phase.alias("phase"), draws.bits(F.col("func_id"), "priority").alias("bits"))
    order = ["phase", "id", "func_id"]
    ranged = save(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("range", F.spark_partition_id()), "ranges")
    by_range = lambda df: df.repartition("range").sortWithinPartitions("range", *order)
    known = starts(by_range(ranged).select("range", "phase", "bits").mapInPandas(_summaries, "range int, phase int, drops array<bigint>"))
    placed = by_range(ranged.join(known, ["range", "phase"])).select("range", "phase", "func_id", "bits", "at", "base")
    dealt = save(placed.mapInPandas(_dealt, "func_id string, phase int, priority long, opens boolean"), "priorities")
    drawn = F.when(F.pmod(draws.bits(F.col("func_id"), "priority/side"), F.lit(2)) == 0, "left").otherwise("right")
    levels = dealt.where("opens").select("priority", F.when(F.col("phase") == 0, "right").when(F.col("phase") == 1, "left").otherwise(drawn).alias("side"))
    return dealt.join(levels, "priority").select("func_id", "priority", "side")
