"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def path(spark: SparkSession, label: str) -> str:
    """A new path under the cluster's spark.checkpoint.dir. Unset, it is a temporary one in a single-machine session, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quillon-{uuid.uuid4().hex}/{label}"


def save(df: DataFrame, label: str) -> DataFrame:
    at = path(df.sparkSession, label)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._quillon_path = at
    return out


def discard(*saved: DataFrame) -> None:
    """Delete tables that save() wrote and nothing will read again."""
    for df in saved:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._quillon_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
