"""Operators and expressions as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLAMP
from ..schema import OPERATOR, REQUIRED


def parse_operator(line: Column) -> Column:
    """A record, or null where the line is no JSON object, has an unknown key or lacks a required one."""
    known = F.size(F.array_except(F.json_object_keys(line), F.array(*[F.lit(f.name) for f in OPERATOR.fields]))) == 0
    present = F.lit(True)
    for k in REQUIRED:
        present = present & F.get_json_object(line, f"$.{k}").isNotNull()
    return F.when(known & present, F.from_json(line, OPERATOR, {"mode": "PERMISSIVE"}))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The catalog in a folder or file of JSON lines; blank and malformed lines are dropped."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(parse_operator(F.col("value")).alias("r")).where("r IS NOT NULL").select("r.*")


def to_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f.name) for f in OPERATOR.fields]), {"ignoreNullFields": "false"})


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(*[f.name for f in OPERATOR.fields]).write.mode(mode).option("ignoreNullFields", "false").json(path)


# The first line of a file of functions, and the line above each function.
SOURCE_HEADER = f"thres = {CLAMP}\n\n"
SOURCE_TITLE = "# Operator ID: {func_id} - {name}\n"


def sources_text(df: DataFrame) -> DataFrame:
    """(place, func_id, text): the pieces of a file of functions in order: its header at place 0, then each operator's value and cost functions by id.

    Operators without both functions are left out.
    """
    titled = lambda name: F.concat(F.lit(SOURCE_TITLE.split("{func_id}")[0]), F.col("func_id"), F.lit(SOURCE_TITLE.split("{func_id}")[1].format(name=name)), F.col(name), F.lit("\n\n"))
    functions = df.where("op_compute_func IS NOT NULL AND op_count_func IS NOT NULL").select(F.col("id").alias("place"), "func_id", F.concat(titled("op_compute_func"), titled("op_count_func")).alias("text"))
    header = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("func_id"), F.lit(SOURCE_HEADER).alias("text"))
    return header.unionByName(functions)


def save_sources(df: DataFrame, path: str) -> None:
    """The same as text files whose lines are in order. A catalog is small beside corpora: one ordered file, as it is compiled as one."""
    sources_text(df).coalesce(1).sortWithinPartitions("place").select(F.expr("left(text, length(text) - 1)").alias("text")).write.mode("overwrite").text(path)  # the writer ends each line


def last_wins(lines: DataFrame) -> DataFrame:
    """(line, func_id, ...): the last row of each key; rows without one go. A maximum with map-side combining, no sort."""
    rest = [c for c in lines.columns if c != "func_id"]
    return lines.where("func_id IS NOT NULL").groupBy("func_id").agg(F.max_by(F.struct(*rest), "line").alias("r")).select("func_id", "r.*")


def count_lines(spark: SparkSession, path: str) -> int:
    """Rows already written, 0 where nothing is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return 0
    return spark.read.text(path).count()
