"""Best-fit packing: pieces of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing looks at lengths alone, so it is planned over the histogram of lengths (at
most ``capacity`` numbers, whatever the corpus) and then dealt out to the pieces by their rank
among those of equal length. The plan's bins with equal room are runs, not single bins; a
segment tree over remaining capacities finds the tightest open run in logarithmic time.

Cases: a null or empty text is the terminator alone; equal lengths are placed in the order of
(task, row); repeated rows are packed once each; an empty table gives an empty result; a
document longer than the capacity is cut, its remainder first. Very long texts are tokenised whole. pack() keeps all columns
but those named sequence_id and offset, which it replaces.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, read, save
from .tokens import encoded, encoder, vocabulary

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
#: Bytes of ids after which a task hands on a batch.
BATCH_BYTES = 1 << 20


class Room:
    """Segment tree over remaining capacities 0..capacity; a leaf counts the open bins with that much room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += bins
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least length that an open bin has."""
        node = self.leaves + length
        if self.count[node]:
            return length
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over {length: pieces}.

    Returns rows (length, first, bin, per_bin, offset): the pieces of that length from rank
    first up to the next row's go per_bin to a bin, from bin on, at offset; and the number of bins.
    """
    tree, runs, out, bins = Room(capacity), defaultdict(list), [], 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            runs[room].append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                opened = -(-left // (capacity // length))
                put(capacity, bins, opened)
                bins += opened
                continue
            first, n = runs[room].pop()
            tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left:
                out.append((length, rank, first, left, capacity - room))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n:
                put(room, first, n)
    return out, bins


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids is little-endian unsigned 32-bit, the terminator included."""
    path = tokenizer or vocabulary()

    def cut(batches):
        encode, rows, held = encoder(path), [], 0
        for batch in batches:
            doc_ids = batch.column(0)
            for i, ids in encoded(batch, encode):
                doc, ids = doc_ids[i].as_py(), np.append(ids, np.uint32(end)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    stop = first if k == 0 else start + capacity
                    rows.append((doc, k, start, stop - start, ids[start:stop].tobytes()))
                held += 4 * len(ids)
                if held > BATCH_BYTES:
                    yield frame(rows)
                    rows, held = [], 0
        if rows:
            yield frame(rows)

    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    frame = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(cut), PIECES)


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to rows with a length from 1 to capacity; all other columns stay.

    Ranks among equal lengths are exact without a sort: each task numbers its own rows, and a
    sum over tasks (a row for each task and length) gives where its numbers begin.
    """
    spark = items.sparkSession
    items = items.select(*[items[c] for c in items.columns if c not in ("sequence_id", "offset")])
    numbered = T.StructType([*items.schema.fields, T.StructField("__pk_task", T.IntegerType()), T.StructField("__pk_local", T.LongType())])

    def number(batches):
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            lengths = np.asarray(batch.column(batch.schema.get_field_index("length")), dtype=np.int64)
            if len(lengths) and not (lengths.min() >= 1 and lengths.max() <= capacity):
                raise ValueError(f"a length is outside 1..{capacity}")
            order = np.argsort(lengths, kind="stable")
            runs = np.flatnonzero(np.r_[True, np.diff(lengths[order]) != 0]) if len(order) else np.empty(0, np.int64)
            local, sizes = np.empty(len(lengths), np.int64), np.diff(np.r_[runs, len(lengths)])
            local[order] = np.arange(len(lengths)) - np.repeat(runs, sizes) + seen[lengths[order]]
            seen += np.bincount(lengths, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), task, np.int32)), pa.array(local)], names=[*batch.schema.names, "__pk_task", "__pk_local"])

    rows = save(items.mapInArrow(lean(number), numbered), "pieces")
    per_task = rows.groupBy("length", "__pk_task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__pk_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = save(per_task.withColumn("__pk_base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table, _ = best_fit(counts, capacity)
    plan = spark.sparkContext.broadcast(np.array(table, np.int64).reshape(-1, 5))
    placed = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    keep = len(items.columns)

    def place(batches):
        p = plan.value
        if len(p):
            order = np.lexsort((p[:, 1], p[:, 0]))
            p = p[order]
            first_of = np.searchsorted(p[:, 0], np.arange(capacity + 2))
        for batch in batches:
            lengths = np.asarray(batch.column(batch.schema.get_field_index("length")), dtype=np.int64)
            rank = np.asarray(batch.column(batch.schema.get_field_index("__pk_rank")), dtype=np.int64)
            row = np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                at, lo, hi = lengths == length, first_of[length], first_of[length + 1]
                row[at] = lo + np.searchsorted(p[lo:hi, 1], rank[at], side="right") - 1
            nth, chosen = rank - p[row, 1], p[row]
            sequence, offset = chosen[:, 2] + nth // chosen[:, 3], chosen[:, 4] + nth % chosen[:, 3] * lengths
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:keep], "sequence_id", "offset"])

    # A task and length pair holds a task's rows of one length at most, so the join has no hot key beyond a task's size.
    ranked = rows.join(bases.select("length", "__pk_task", "__pk_base"), ["length", "__pk_task"]).select(*items.columns, (F.col("__pk_base") + F.col("__pk_local")).alias("__pk_rank"))
    return ranked.mapInArrow(lean(place), placed)


def checked(cut: DataFrame) -> DataFrame:
    """pieces() with a checksum for their ids, written, so that tokenising and numbering don't share a task's memory."""
    return save(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "checked")


def op4_best_fit_packing(spark, sf_dir):
    return pack(checked(pieces(read(spark, sf_dir, "documents"))))
