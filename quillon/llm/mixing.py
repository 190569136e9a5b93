"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source's target is a number of words. Every document gets the whole copies that target / source size
holds; what they leave of the target is sampled with unequal probabilities, in proportion to the size class
of a document (its word count, cut to its three highest binary digits, and 1 at least):
p = min(1, c * class), with c such that the expected words are those that are left. Documents
with p = 1 are certain. Documents are ranked by their random odds over their inclusion odds, u / (1 - u) over p / (1 - p), and the
first are taken until their words fill what is left, so the sample's size is fixed in words.

Cases: a null text has size 0 and the odds of one word; a null source is a
source of its own, last in order; an empty table gives an empty result; rows alike in doc_id and size
share one draw and are taken together, so they are best told apart by doc_id. Ties in rank are taken together.
Other columns pass through untouched, whatever they are named. Whole texts are counted, however long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, read, save

#: Slices of the unit interval of ranks in which a source's words are summed before any row is ranked.
SLICES = 4096


def measure(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """(d, source, size, u, odds): the row, its words, a draw in [0, 1) that depends on doc_id and seed alone, and its size class."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"))
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("d.doc_id").cast("string"), F.lit("")))), 1, 13)
    size = F.coalesce(F.regexp_count("d.text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = rows.select("d", F.col("d.source").alias("source"), size.alias("size"), (F.conv(hexed, 16, 10).cast("double") / float(1 << 52)).alias("u"))
    low = "greatest(length(bin(size)) - 3, 0)"
    return sized.withColumn("odds", F.expr(f"greatest(shiftleft(shiftright(size, {low}), {low}), 1L)"))


def same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def rank() -> Column:
    """Random odds over inclusion odds, q, as q / (1 + q): from 0 for certain documents to 1."""
    p = F.least(F.lit(1.0), F.col("c") * F.col("odds"))
    against, chance = F.col("u") * (1 - p), p * (1 - F.col("u"))
    return F.coalesce(F.try_divide(against, against + chance), F.lit(1.0))


def targets(classes: DataFrame, weights: Sequence[float], cap: int) -> DataFrame:
    """One row per source: source, source_size, target, whole, rest (words to be sampled), c. classes: (source, odds, words).

    Targets share all words by the repeating weights in code-point order of the sources, null
    last; none exceeds cap times its source, and what is cut off is shared again by weight.
    That fixpoint is min(cap * size, level * weight), whose level is found over sources sorted
    by cap * size / weight: capping in that order raises the level until the first source that it
    leaves uncapped, and would lower it from there on, so it is the highest. The windows without a key hold one row per source.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("full", F.col("source").asc_nulls_last())
    upto, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sources = (
        classes.groupBy("source").agg(F.sum("words").alias("source_size"))
        .withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("top", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("full", F.col("top") / F.col("w"))
        .withColumn("left", F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("top").over(upto), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
        .withColumn("level", F.max(F.when(F.col("left") / F.col("w_left") <= F.col("full"), F.col("left") / F.col("w_left"))).over(everything))
        .withColumn("target", F.when((F.col("level") * F.col("w")) < F.col("top"), F.col("level") * F.col("w")).otherwise(F.col("top")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.try_divide("target", "source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "rest")
    )
    sources = save(sources, "sources")
    # The largest size class for which c * class <= 1, when all larger ones are certain. A source has a few hundred classes at most.
    down, up = Window.partitionBy("source").orderBy(F.col("odds").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source").orderBy("odds").rowsBetween(Window.unboundedPreceding, 0)
    tried = classes.withColumn("larger", F.coalesce(F.sum("words").over(down), F.lit(0))).withColumn("moment", F.sum(F.col("words") * F.col("odds")).over(up))
    tried = tried.alias("a").join(sources.alias("b"), same("a", "b")).select("a.source", "odds", F.try_divide(F.col("rest") - F.col("larger"), F.col("moment").cast("double")).alias("c"))
    scale = tried.where(F.col("c") * F.col("odds") <= 1).groupBy("source").agg(F.max_by("c", "odds").alias("c"))
    return save(sources.alias("a").join(scale.alias("b"), same("a", "b"), "left").select("a.*", F.coalesce("c", F.lit(0.0)).alias("c")), "targets")


def plan(measured: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per source: source, source_size, target, whole (copies that all have), c and cut (the highest rank that is taken)."""
    classes = save(measured.groupBy("source", "odds").agg(F.sum("size").alias("words")), "size-classes")
    sources = targets(classes, weights, cap)
    ranked = measured.alias("a").join(sources.alias("b"), same("a", "b")).select("a.source", "size", "rest", rank().alias("v"))
    slices = save(ranked.groupBy("source", F.floor(F.col("v") * SLICES).alias("slice")).agg(F.sum("size").alias("words")), "slices")
    along = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    edge = slices.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0))).alias("a").join(sources.alias("b"), same("a", "b"))
    edge = save(edge.where("before <= rest AND rest < before + words").select("a.source", "slice", "before"), "edges")
    # Only the rows of one slice in each source are ranked one by one.
    inner = ranked.withColumn("slice", F.floor(F.col("v") * SLICES)).alias("a").join(edge.alias("b"), same("a", "b") & (F.col("a.slice") == F.col("b.slice")))
    inner = inner.groupBy("a.source", "before", "rest", "v").agg(F.sum("size").alias("words"))
    within = Window.partitionBy("source").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("words").over(within), F.lit(0)) + F.col("words") / 2
    cuts = inner.withColumn("middle", middle).groupBy("source").agg(F.max(F.when(F.col("middle") <= F.col("rest"), F.col("v"))).alias("inside"))
    below = F.col("e.slice") / F.lit(float(SLICES)) - F.lit(2.0**-53)
    cut = F.when(F.col("a.rest") <= 0, F.lit(-1.0)).otherwise(F.coalesce("inside", below, F.lit(-1.0)))
    joined = sources.alias("a").join(edge.alias("e"), same("a", "e"), "left").join(cuts.alias("b"), same("a", "b"), "left")
    return joined.select("a.source", "source_size", "target", "whole", "c", cut.alias("cut"))


def apply(measured: DataFrame, sources: DataFrame) -> DataFrame:
    """measured's columns with source_size, target and copies; the sources' table is small enough for Spark to weigh a broadcast itself."""
    joined = measured.alias("a").join(sources.alias("b"), same("a", "b"))
    return joined.select("a.*", "source_size", "target", (F.col("whole") + (rank() <= F.col("cut")).cast("long")).alias("copies"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: docs' columns, each row repeated as often as it is taken."""
    measured = measure(docs, seed)
    sources = save(plan(save(measured.drop("d"), "sizes"), weights, cap), "plan")
    return apply(measured, sources).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("d.*")


def op7_source_mix(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    narrow = save(measure(docs).select(F.col("d.doc_id").alias("doc_id"), "source", "size", "u", "odds"), "sizes")
    sources = save(plan(narrow.drop("doc_id")), "plan")
    return apply(narrow, sources).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH z AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents
), m AS (
  SELECT *, greatest((size >> greatest(length(bin(size)) - 3, 0)) << greatest(length(bin(size)) - 3, 0), 1)::BIGINT AS odds FROM z
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM m GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 3.0::DOUBLE * source_size AS top FROM s
), c AS (
  SELECT *, top / w AS full_at,
         sum(source_size) OVER ()::DOUBLE - coalesce(sum(top) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_all,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w
  FROM w
), l AS (
  SELECT max(rest_all / rest_w) FILTER (WHERE rest_all / rest_w <= full_at) AS level FROM c
), t AS (
  SELECT source, source_size, CASE WHEN level * w < top THEN level * w ELSE top END AS target FROM c, l
), h AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), p AS (
  SELECT *, target - whole * source_size AS rest FROM h
), o AS (
  SELECT source, odds, sum(size)::BIGINT AS words FROM m GROUP BY source, odds
), a AS (
  SELECT source, odds, coalesce(sum(words) OVER (PARTITION BY source ORDER BY odds DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS larger,
         sum(words * odds) OVER (PARTITION BY source ORDER BY odds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS moment FROM o
), f AS (
  SELECT p.source, arg_max((rest - larger) / nullif(moment, 0)::DOUBLE, odds) FILTER (WHERE (rest - larger) / nullif(moment, 0)::DOUBLE * odds <= 1) AS c
  FROM a JOIN p ON a.source IS NOT DISTINCT FROM p.source GROUP BY p.source
), x AS (
  SELECT m.doc_id, m.source, size, u, source_size, target, whole, rest, least(1.0::DOUBLE, coalesce(c, 0.0::DOUBLE) * odds) AS pi
  FROM m JOIN p ON m.source IS NOT DISTINCT FROM p.source LEFT JOIN f ON m.source IS NOT DISTINCT FROM f.source
), v AS (
  SELECT *, coalesce(u * (1 - pi) / nullif(u * (1 - pi) + pi * (1 - u), 0), 1) AS v FROM x
), g AS (
  SELECT source, v, any_value(rest) AS rest, sum(size)::BIGINT AS words FROM v GROUP BY source, v
), r AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + words / 2.0::DOUBLE AS middle FROM g
), k AS (
  SELECT source, max(v) FILTER (WHERE middle <= rest AND rest > 0) AS cut FROM r GROUP BY source
)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN v.v <= coalesce(cut, -1) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM v JOIN k ON v.source IS NOT DISTINCT FROM k.source
"""
