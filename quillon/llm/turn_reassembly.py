"""Conversation turn reassembly: turns that arrive in batches, late and repeated, put back in order.

A stateful streaming query keeps conversations in hash buckets, one state each. A bucket files
every open conversation in a timing wheel under the batch that would close it. An arrival files
it again and raises its generation, so that what was filed before is void and need not be looked
for; a batch's tick visits the one slot that is due and closes what is filed there under its own
generation. The last tick visits all that is open.

Each batch is written to the folder that the query reads, and the query is started anew on one
checkpoint until it has taken it. Only the smallest payload (role|text, by bytes) of a turn arrives in a batch: that is an aggregate before
the batch is written. The sink's files count by the query's log, so a task that runs twice leaves one result.

A conversation is one state's, and its turns that wait for an earlier one are held there; what is released is not. The buckets are as many as
shuffle partitions times BUCKETS, so a state is a share of the input that stays the same. A single conversation is not split: it is an order of turns.

Cases: rows with a null turn are dropped; null role and text are empty; a null conv_id is a conversation of its own; repeated rows and
turns are one arrival a batch, the smallest; texts are held whole; no rows, no events. Columns beside those named aren't read.
"""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, new_path, read, remove, save

#: Successive batches without an arrival that close a conversation; buckets for each shuffle partition.
PATIENCE, BUCKETS = 2, 2
RELEASE, REJECT, CLOSE = "release", "reject", "close"
ARRIVAL, TICK, END = 0, 1, 2
#: While a batch is taken: texts go to Python a few at a time.
STREAMING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.streaming.metricsEnabled": "false"}
FEED = "bucket long, kind int, batch int, known boolean, conv_id long, turn long, first long, role string, text string"
EVENTS = "event string, conv_id long, turn long, batch long, role string, text string, pending string, n_missing long, n_breaks long"


class Conversation:
    """What an open conversation needs: where its gapless run ends, which turns wait, and the counts of its closing."""

    __slots__ = ("first", "next", "role", "last", "kept", "breaks", "seen", "generation", "waiting")

    def __init__(self, first: int):
        self.first = self.next = first
        self.role, self.last, self.kept, self.breaks, self.seen, self.generation, self.waiting = None, first, 0, 0, -1, 0, {}

    def keep(self, turn: int, role: str, text: str) -> list[tuple]:
        """The turns (turn, role, text) that this one releases; a turn that is kept already changes nothing."""
        if turn < self.next or turn in self.waiting:
            return []
        before = self.waiting[turn - 1][0] if turn - 1 in self.waiting else self.role if turn == self.next else None
        after = self.waiting.get(turn + 1, (None,))[0]
        self.breaks += (before == role) + (after == role)
        self.kept, self.last = self.kept + 1, max(self.last, turn)
        self.waiting[turn] = (role, text)
        out = []
        while self.next in self.waiting:
            self.role, said = self.waiting.pop(self.next)
            out.append((self.next, self.role, said))
            self.next += 1
        return out

    def state(self) -> bytes:
        return pickle.dumps(tuple(getattr(self, k) for k in self.__slots__), 5)

    @classmethod
    def of(cls, state: bytes) -> Conversation:
        out = cls(0)
        for k, v in zip(cls.__slots__, pickle.loads(state)):
            setattr(out, k, v)
        return out


class Bucket:
    """A bucket's conversations, the wheel that they are filed in and those that are closed. Conversations are read from bytes when they are touched."""

    def __init__(self, patience: int, state: bytes | None = None):
        self.patience = patience
        self.open, self.closed, self.wheel = pickle.loads(state) if state else ({}, set(), [[] for _ in range(patience + 1)])
        self.touched: dict = {}

    def conversation(self, key, first: int = 0) -> Conversation:
        if key not in self.touched:
            self.touched[key] = Conversation.of(self.open[key]) if key in self.open else Conversation(first)
        return self.touched[key]

    def arrive(self, batch: int, key, turn: int, first: int, role: str, text: str):
        if key in self.closed:
            yield (REJECT, key, turn, batch, role, text, None, None, None)
            return
        c = self.conversation(key, first)
        if c.seen != batch:
            c.seen, c.generation = batch, c.generation + 1
            self.wheel[(batch + self.patience) % len(self.wheel)].append((key, c.generation))
        for at, by, said in c.keep(turn, role, text):
            yield (RELEASE, key, at, batch, by, said, None, None, None)

    def tick(self, batch: int, last: bool = False):
        """Close what is due, or at the end all that is open."""
        slots = range(len(self.wheel)) if last else [batch % len(self.wheel)]
        for k in slots:
            for key, generation in self.wheel[k]:
                if key in self.closed or self.conversation(key).generation != generation:
                    continue
                c = self.touched.pop(key)
                self.open.pop(key, None)
                self.closed.add(key)
                yield (CLOSE, key, -1, batch, None, None, ",".join(map(str, sorted(c.waiting))), c.last - c.first + 1 - c.kept, c.breaks)
            self.wheel[k] = []

    def state(self) -> bytes:
        self.open.update((k, c.state()) for k, c in self.touched.items())
        return pickle.dumps((self.open, self.closed, self.wheel), 5)


def taking(patience: int):
    """The function of one bucket and one batch: its arrivals in any order, then its tick."""
    names = [x.split()[0] for x in EVENTS.split(", ")]

    def frame(rows):
        return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(names, zip(*rows))})

    def take(key, frames, state):
        bucket, ticks, rows = Bucket(patience, state.get[0] if state.exists else None), [], []
        for f in frames:
            for r in f.itertuples(index=False):
                if r.kind != ARRIVAL:
                    ticks.append((r.batch, r.kind == END))
                    continue
                rows += bucket.arrive(int(r.batch), int(r.conv_id) if r.known else None, int(r.turn), int(r.first), r.role, r.text)
            if rows:
                yield frame(rows)
                rows = []
        for batch, last in ticks:
            rows += bucket.tick(int(batch), last)
        state.update((bucket.state(),))
        if rows:
            yield frame(rows)

    return take


def reassemble(arrivals: DataFrame, batches: int, patience: int = PATIENCE, per_partition: int = BUCKETS) -> DataFrame:
    """The events of arrivals (conv_id, turn, first, role, text, batch), batch from 0 to batches - 1 and first being the conversation's smallest turn.

    (event, conv_id, turn, batch, role, text, pending, n_missing, n_breaks): ``release`` of a turn in order, ``reject`` of an arrival after closing, and
    ``close`` with the turns that still wait (pending, ascending, comma-joined), the turns that never came and those that repeat the role before them.
    """
    spark = arrivals.sparkSession
    buckets = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = new_path(spark, "turns")
    payload = F.concat(F.coalesce("role", F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    said = F.struct(payload.alias("payload"), F.coalesce("role", F.lit("")).alias("role"))
    rows = arrivals.where("turn IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("first").cast("long").alias("first"), F.col("batch").cast("int").alias("batch"), said.alias("said"))
    smallest = rows.groupBy("batch", "conv_id", "turn").agg(F.min("said").alias("said"), F.min("first").alias("first"))
    bucket = F.pmod(F.xxhash64("conv_id"), F.lit(buckets))
    feed = smallest.select(
        bucket.alias("bucket"), F.lit(ARRIVAL).alias("kind"), "batch", F.col("conv_id").isNotNull().alias("known"), F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv_id"), "turn", "first",
        F.col("said.role").alias("role"), F.substring("said.payload", F.length("said.role") + 2, F.length("said.payload")).alias("text"),
    )
    # In parts of a batch's buckets, so that a batch is a few files however many tasks write it.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // batches)
    feed = save(feed.repartition("batch", F.pmod(F.col("bucket"), F.lit(parts))), "arrivals")
    # A row for each bucket: every one is visited in every batch, even an empty one.
    no = F.lit(None).cast("string")
    ticks = lambda k: spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(END if k == batches else TICK).alias("kind"), F.lit(k).alias("batch"), F.lit(False).alias("known"), *[F.lit(0).cast("long").alias(c) for c in ("conv_id", "turn", "first")], no.alias("role"), no.alias("text"))
    kept = {k: spark.conf.get(k, None) for k in STREAMING}
    for k in range(batches + 1):
        feed.where(F.col("batch") == k).unionByName(ticks(k)).coalesce(parts).write.mode("append").parquet(f"{base}/feed")
        for name, v in STREAMING.items():
            spark.conf.set(name, v)
        try:
            stream = spark.readStream.schema(FEED).parquet(f"{base}/feed").groupBy("bucket").applyInPandasWithState(taking(patience), EVENTS, "state binary", "append", "NoTimeout")
            query = stream.writeStream.format("parquet").option("path", f"{base}/events").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for name, v in kept.items():
                spark.conf.set(name, v) if v is not None else spark.conf.unset(name)
    discard(feed)
    for done in ("feed", "checkpoint"):
        remove(spark, f"{base}/{done}")
    return spark.read.schema(EVENTS).parquet(f"{base}/events")


def dealt(conversations: DataFrame, batches: int = 12) -> DataFrame:
    """A table of turns as arrivals: a row's batch is drawn from its key, and some arrive again, as a user's, five batches on."""
    rows = conversations.where("turn IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    firsts = rows.groupBy("conv_id").agg(F.min("turn").alias("first"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string"))
    hashed = rows.withColumn("h", F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"))
    again = F.array(F.struct((F.col("h") % batches).cast("int").alias("batch"), F.col("role").alias("role")), F.struct(((F.col("h") + 5) % batches).cast("int").alias("batch"), F.lit("user").alias("role")))
    sent = hashed.select("conv_id", "turn", "text", F.explode(F.when(F.col("h") % 7 < 2, again).otherwise(F.slice(again, 1, 1))).alias("sent"))
    return sent.alias("s").join(firsts.alias("f"), F.col("s.conv_id").eqNullSafe(F.col("f.conv_id"))).select("s.conv_id", "turn", "first", "sent.role", "text", "sent.batch")


def op11_turn_reassembly(spark, sf_dir):
    events = reassemble(dealt(read(spark, sf_dir, "conversations")), 12)
    close = F.col("event") == CLOSE
    digest = F.sha2(F.when(close, F.col("pending")).otherwise(F.concat("role", F.lit("|"), "text")), 256)
    return events.select("event", "conv_id", "turn", "batch", digest.alias("sha256"), "n_missing", "n_breaks")


OP11_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said, min(turn) OVER (PARTITION BY conv_id) AS first,
         ('0x' || substr(sha256(coalesce(conv_id::VARCHAR, '') || ':' || turn::VARCHAR), 1, 8))::BIGINT AS h FROM conversations WHERE turn IS NOT NULL
), sent AS (
  SELECT conv_id, turn, first, role, said, h % 12 AS batch FROM t UNION ALL SELECT conv_id, turn, first, 'user', said, (h + 5) % 12 FROM t WHERE h % 7 < 2
), arrived AS (
  SELECT conv_id, turn, batch, min(first) AS first, arg_min(role, encode(role || '|' || said)) AS role, min(encode(role || '|' || said)) AS payload FROM sent GROUP BY conv_id, turn, batch
), active AS (
  SELECT conv_id, batch, lead(batch) OVER (PARTITION BY conv_id ORDER BY batch) AS later FROM (SELECT DISTINCT conv_id, batch FROM arrived)
), closing AS (
  SELECT conv_id, least(min(batch) + 2, 12) AS closed FROM active WHERE later IS NULL OR later > batch + 2 GROUP BY conv_id
), live AS (
  SELECT a.*, c.closed, a.batch > c.closed AS late FROM arrived a JOIN closing c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
), kept AS (
  SELECT conv_id, turn, min(first) AS first, min(closed) AS closed, min(batch) AS batch, arg_min(role, batch) AS role, arg_min(payload, batch) AS payload FROM live WHERE NOT late GROUP BY conv_id, turn
), ordered AS (
  SELECT *, row_number() OVER w = turn - first + 1 AS released, max(batch) OVER w AS by_batch, lag(turn) OVER w = turn - 1 AND lag(role) OVER w = role AS breaks FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)
SELECT 'release' AS event, conv_id, turn, by_batch::BIGINT AS batch, sha256(payload) AS sha256, NULL::BIGINT AS n_missing, NULL::BIGINT AS n_breaks FROM ordered WHERE released
UNION ALL SELECT 'reject', conv_id, turn, batch::BIGINT, sha256(payload), NULL, NULL FROM live WHERE late
UNION ALL SELECT 'close', conv_id, -1, min(closed)::BIGINT, sha256(coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE NOT released), '')),
  (max(turn) - min(first) + 1 - count(*))::BIGINT, count(*) FILTER (WHERE breaks)::BIGINT FROM ordered GROUP BY conv_id
"""
