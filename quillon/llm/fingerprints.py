"""Document fingerprints by SpotSigs. DataFrame functions only.

A signature is a chain: a common word (the anchor) and the next two content words after it, other
common words between them skipped. A document's fingerprint is the sorted set of its signatures'
32-bit hashes, written in hex. Likeness is the Jaccard similarity of two such sets. For a
search, sets are partitioned by length, so that only sets whose lengths allow the threshold
meet, in their own or the next partition, and meet only by a signature of their heads.

Cases: null texts are empty and have the empty fingerprint; two empty ones are alike (1), an
empty and another are not (0). A text without any chain takes all pairs of neighbouring content
words instead, one without two content words all its words, one without words its own hash, so
equal texts always have equal fingerprints. Whole texts are read. The next document is by
descending doc_id, then by a hash of the text; null ids come last; rows alike in both share
theirs. A lone document is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, save

# Common words of English, French, German and Spanish.
ANCHORS = (
    "a", "an", "and", "as", "at", "be", "by", "for", "in", "is", "of", "on", "that", "the", "to", "was",
    "au", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "que", "un", "une",
    "als", "auf", "das", "dem", "den", "der", "die", "ein", "ist", "mit", "und", "von", "zu",
    "con", "del", "el", "es", "los", "no", "por", "se", "su", "y",
)
COMMON = ANCHORS + (
    "are", "from", "have", "he", "her", "his", "it", "not", "or", "she", "this", "were", "which", "with", "you",
    "ce", "elle", "il", "ne", "nous", "ou", "par", "pas", "plus", "pour", "qui", "sur",
    "auch", "aus", "bei", "er", "für", "ich", "im", "nicht", "sich", "sie", "sind", "so", "wird",
    "al", "como", "las", "lo", "más", "o", "para", "pero", "una",
)

#: More elements than any array here has (start + length must fit an int).
MANY = 1 << 30


def once(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def signatures(text: Column) -> Column:
    """The sorted set of a text's signature hashes."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def of_words(w: Column) -> Column:
        # Each part is a content word with the anchors that follow it, ~ before each; the first has anchors alone.
        marked = F.transform(F.filter(w, lambda x: ~x.isin(*[c for c in COMMON if c not in ANCHORS])), lambda x: F.concat(F.when(x.isin(*ANCHORS), "~").otherwise("\n"), x))
        parts = F.split(F.array_join(marked, ""), "\n")

        def chains(p: Column) -> Column:
            word = lambda i: F.substring_index(F.get(p, i), "~", 1)
            after = lambda x, k: once(F.struct(word(k + 1).alias("one"), word(k + 2).alias("two")), lambda c: F.transform(F.slice(F.split(x, "~"), 2, MANY), lambda a: F.hash(a, c["one"], c["two"])))
            return F.flatten(F.transform(p, lambda x, k: F.when(x.contains("~") & (k + 2 < F.size(p)), after(x, k)).otherwise(F.array().cast("array<int>"))))

        content = F.filter(w, lambda x: ~x.isin(*COMMON))
        pairs = once(content, lambda c: F.transform(F.slice(c, 2, MANY), lambda x, i: F.hash(F.get(c, i), x)))
        rest = once(pairs, lambda p: F.when(F.size(p) > 0, p).when(F.size(w) > 0, F.transform(w, lambda x: F.hash(x))).when(text != "", F.array(F.hash(text))).otherwise(F.array().cast("array<int>")))
        return once(once(parts, chains), lambda s: F.when(F.size(s) > 0, s).otherwise(rest))

    return F.sort_array(F.array_distinct(once(words, of_words)))


def written(s: Column) -> Column:
    """A set of hashes as a string: eight hex digits each."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; the union follows from the sizes and the overlap."""
    overlap = F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.size(F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(once(overlap, lambda o: o / (F.size(a) + F.size(b) - o)))


def similar_pairs(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity) between keys with different sets of likeness threshold or more; sets: (key, sigs).

    Equal sets are one class, standing at its smallest key. Partition k holds lengths from
    r^k to r^(k+1) with r = 1/threshold; a set also visits the partition after its own, and
    lengths beyond the threshold's reach are pruned before sets are compared. Sets meet by the rarest of their signatures (their
    heads), so that common ones bring few together; classes that differ but share a rare signature are compared each with each.

    Cases: an empty set is like none; repeated rows and equal sets are one class; null keys are a class's key only where it has no other; no rows, no pairs.
    """
    classes = save(sets.where(F.size("sigs") > 0).groupBy("sigs").agg(F.min("key").alias("key")).withColumn("n", F.size("sigs")), "spot-classes")
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)
    held = classes.select("key", "n", F.explode("sigs").alias("sig"))
    shared = held.groupBy("sig").agg(F.count("*").alias("sets")).where("sets > 1")
    ranked = held.join(shared, "sig").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "sig"))).alias("common"))
    # Signatures of one set alone come first and bring it nowhere.
    most = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1 - (F.col("n") - F.size("common"))
    at = ranked.where(most > 0).select("key", "n", part.alias("part"), F.explode(F.slice("common", F.lit(1), F.greatest(most, F.lit(1)))).alias("c")).select("key", "n", "part", "c.sig")
    small, large = at.toDF("a", "na", "part", "sig"), at.select("key", "n", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), "sig").toDF("b", "nb", "part", "sig")
    near = ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") >= threshold * F.col("nb") - 1e-9)
    pairs = small.join(large, ["part", "sig"]).where(near).select("a", "b").distinct()
    s = classes.select("key", "sigs")
    return pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)


def next_in_order(ids: DataFrame) -> DataFrame:
    """ids (k, h, n, doc_id) with doc_id, next_k, next_h: ranges are ordered inside, their heads stitched; no row set meets in one task."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down = [F.col("doc_id").desc_nulls_last(), F.col("h").asc()]
    ranged = save(ids.repartitionByRange(parts, *down).withColumn("range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("range").orderBy(*down)
    led = ranged.withColumn("place", F.row_number().over(inside)).withColumn("lead", F.lead(F.struct("k", "h")).over(inside))
    # One row per range, so the window without a key is as small as the number of partitions.
    heads = led.where("place = 1").select("range", F.struct("k", "h").alias("own"))
    by_range = Window.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("own").over(by_range), F.first("own").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    return led.join(heads, "range").select("doc_id", "k", "h", "n", F.coalesce("lead", "after").alias("next")).select("doc_id", "k", "h", "n", F.col("next.k").alias("next_k"), F.col("next.h").alias("next_h"))


def op10_fingerprints(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("k"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("h"), "text")
    ids = docs.select("doc_id", "k", "h", F.length("text").alias("n")).groupBy("doc_id", "k", "h", "n").agg(F.count("*").alias("rows"))
    ids = save(ids, "ids")
    link = save(next_in_order(ids.drop("rows")), "next")
    # Each document sends the one before it the start of its text that is asked for, and its set.
    asked = link.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("doc_id").alias("to_id"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    # Both joins read the same columns of docs by the same keys, so that texts are shuffled once and reused.
    texts = docs.select("k", "h", "text")
    sent = texts.join(asked, ["k", "h"]).select(F.col("to_id").alias("doc_id"), F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.substring("text", F.lit(1), F.col("need")).alias("start"), signatures(F.col("text")).alias("next_set"))
    if not ids.where("rows > 1").isEmpty():
        sent = sent.groupBy("doc_id", "k", "h").agg(F.max("start").alias("start"), F.max("next_set").alias("next_set"))  # repeated rows send the same
    met = texts.join(sent, ["k", "h"]).select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "start", "next_set")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")), "start")
    row = once(F.struct(signatures(F.col("text")).alias("own"), edited.alias("edited")), lambda x: once(F.struct(x["own"].alias("own"), F.sha2(x["edited"], 256).alias("sha"), signatures(x["edited"]).alias("edited")), lambda y: F.struct(
        y["sha"].alias("edited_sha256"), written(y["own"]).alias("fingerprint"), written(y["edited"]).alias("edited_fingerprint"),
        likeness(y["own"], y["edited"]).alias("near_edited"), likeness(y["own"], F.col("next_set")).alias("near_next"),
    )))
    return met.select("doc_id", "n_chars", row.alias("r")).select("doc_id", "n_chars", "r.*")
