"""Shared plumbing: tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: While a table is written: the shuffles behind it are read no more and removed; texts go to Python a few at a time.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}
#: glibc's number of the size from which memory is mapped, and so given back, by itself.
M_MMAP_THRESHOLD = -3
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Unset, it is a temporary one in a single-machine session, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/quillon-{uuid.uuid4().hex}/{label}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a shared path; one that is gone already, or a session that has ended, is no error."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is closing
        return


def save(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    kept = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def discard(saved: DataFrame) -> None:
    """Delete a table that save() wrote and nothing will read again."""
    remove(saved.sparkSession, saved._quillon_path)


def lean(run):
    """An Arrow function whose worker gives memory back: large arrays as they are freed, the rest when its task ends.

    A worker outlives its task, and what it keeps counts against its executor.
    """

    def inner(batches):
        libc = None
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(M_MMAP_THRESHOLD, 4 << 20)
        except (OSError, AttributeError):  # another C library, which has its own ways
            pass
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None and hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return inner


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find over (u, v): alternating large-star and small-star rounds.

    Returns (node, component), component being the smallest node reachable. Each round is two aggregations with
    map-side minima, joined back on their keys by equi-joins whose hot keys Spark may split, and its edges are a written
    table; the round before's is deleted.

    Cases: nodes without an edge to another node are absent, and so are edges with a null end; repeated edges count
    once; no edges, no rows; columns beside u and v aren't read. More than max_rounds rounds are an error.
    """
    e = save(edges.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("m").alias("a"), F.col("y").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low2, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        before, e = e, save(small, "edges")
        discard(before)
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
