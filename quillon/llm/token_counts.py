"""Token counts by a separator scan over flat, unindexed token files.

A token file is unsigned little-endian ids and nothing else; an end-of-document id closes each
document. Blocks of a file are searched for that id as whole vectors, each on its own; a prefix
scan over the blocks' summaries (ids, separators, ids after the last one) then gives every block
the document number and length that it begins with, which stitches documents across blocks.

Cases: an empty document counts 0; ids after a file's last separator are an open document
(``closed`` false); an empty file or folder gives no rows; a file that is no whole number of ids
is an error, and so is an id that the width of a file's ids cannot hold. Null texts are empty documents, very long ones are
written whole. Rows that repeat are counted each; no rows, no counts. Other columns aren't read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, new_path, read, save
from .tokens import encoded, encoder, vocabulary

#: Ids are stored one higher than the vocabulary's, which leaves 0 for the end of a document.
SHIFT, END = 1, 0
BLOCK_BYTES = 8 << 20
#: Blocks whose summaries are scanned as one group before the groups are.
GROUP = 1024


def opened(uri: str):
    """A file system and the path in it; Spark writes local files as file:/x."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, dtype: str = "<u2") -> DataFrame:
    """Tokenise docs into flat files in folder; returns the written manifest (file, ordinal, doc_id).

    Each task attempt writes a file of its own name, and only files of the manifest count, so
    a lost executor's leftovers do no harm.
    """
    path = tokenizer or vocabulary()

    def write(batches):
        encode, name, ordinal = encoder(path), f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin", 0
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                for _, ids in encoded(batch, encode):
                    if len(ids) and int(ids.max()) + SHIFT > np.iinfo(dtype).max:
                        raise ValueError(f"id {ids.max()} is too large for files of {dtype}")
                    out.write(np.append(ids + SHIFT, END).astype(dtype).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)], names=["file", "ordinal", "doc_id"])
                ordinal += n

    return save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(write), "file string, ordinal long, doc_id long"), "manifest")


def count_tokens(spark: SparkSession, folder: str, dtype: str = "<u2", end: int = END, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed): one row per document of every *.bin file in folder."""
    width = np.dtype(dtype).itemsize
    step = block_bytes // width * width
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")  # the contents are not read
    blocks = files.where("length > 0").select("path", "length", F.posexplode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(step).cast("long"))).alias("block", "offset"))

    def search(frames):
        for frame in frames:
            for path, length, block, offset in frame.itertuples(index=False):
                if length % width:
                    raise ValueError(f"{path}: {length} bytes are no whole number of ids of {width} bytes")
                store, inner = opened(path)
                with store.open_input_file(inner) as f:
                    ids = np.frombuffer(f.read_at(min(step, length - offset), offset), dtype)
                at = np.flatnonzero(ids == end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.rpartition("/")[2]]), pa.array([block], pa.int32()), pa.array([offset // width], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([len(ids) - (at[-1] + 1 if len(at) else 0)], pa.int64()), pa.array([at.astype(np.int32)], pa.list_(pa.int32()))],
                    names=["file", "block", "first", "ids", "ends", "after", "at"],
                )

    def by_arrow(batches):
        for b in batches:
            yield from search([b.to_pandas()])

    dealt = blocks.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "block")
    found = save(dealt.mapInArrow(lean(by_arrow), "file string, block int, first long, ids long, ends long, after long, at array<int>"), "blocks")
    # The scan: ends before a block, and where the last of them is, first over groups of blocks and then inside a group.
    marks = found.select("file", "block", F.floor(F.col("block") / GROUP).alias("grp"), "ends", F.when(F.col("ends") > 0, F.col("first") + F.col("ids") - F.col("after")).alias("next"), (F.col("first") + F.col("ids")).alias("stop"))
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = marks.groupBy("file", "grp").agg(F.sum("ends").alias("ends"), F.max("next").alias("next"))
    groups = groups.select("file", "grp", F.coalesce(F.sum("ends").over(upto("file", "grp")), F.lit(0)).alias("ends0"), F.max("next").over(upto("file", "grp")).alias("next0"))
    inside = marks.select("file", "grp", "block", F.coalesce(F.sum("ends").over(upto("file", "grp", "block")), F.lit(0)).alias("ends1"), F.max("next").over(upto("file", "grp", "block")).alias("next1"))
    carried = inside.join(groups, ["file", "grp"]).select("file", "block", (F.col("ends0") + F.col("ends1")).alias("ordinal0"), F.coalesce("next1", "next0", F.lit(0)).alias("open_at"))
    stitched = found.join(carried, ["file", "block"])
    closed = stitched.where("ends > 0").select("file", "ordinal0", "first", "open_at", "at", F.posexplode("at").alias("k", "pos")).select(
        "file", (F.col("ordinal0") + F.col("k")).alias("ordinal"),
        F.when(F.col("k") == 0, F.col("open_at")).otherwise(F.col("first") + F.get("at", F.col("k") - 1) + 1).alias("start"), (F.col("first") + F.col("pos")).alias("stop"), F.lit(True).alias("closed"),
    )
    ends = marks.groupBy("file").agg(F.sum("ends").alias("ordinal"), F.coalesce(F.max("next"), F.lit(0)).alias("start"), F.max("stop").alias("stop"))
    rest = ends.where("stop > start").select("file", "ordinal", "start", "stop", F.lit(False).alias("closed"))
    return closed.unionByName(rest).select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "closed")


def op9_token_counts(spark, sf_dir):
    folder = new_path(spark, "tokens")
    manifest = write_token_files(read(spark, sf_dir, "documents"), folder)
    return manifest.join(count_tokens(spark, folder), ["file", "ordinal"], "left").select("doc_id", "n_tokens")
