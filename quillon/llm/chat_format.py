"""Chat formatting by event-sourced reconstruction.

Logs are events (conv_id, seq, tie, kind, msg, role, text). A ``message`` states a whole text, a
``delta`` adds to it, an ``edit`` replaces it, and a ``regenerate`` replaces it and takes back
every message that was begun between it and the event. Folding is done per message (a sum over
its events), and taking back is a running maximum along a conversation, so that no conversation
is ever held in memory; final messages are rendered one by one, each a row.

The template: user ``[INST] text [/INST]``, assistant ``[ANS] text </s>``, any other role
``[ROLE] role [SAY] text [END]``. In texts and roles a backslash is doubled, and one is put after
the first character of a control string, so none can be read there; unescaping drops it again.

A conversation's text is its messages' one after another. It is read back as such: by its control strings alone, in pieces of any length.

Cases: null text and null role are empty; a null conv_id is a conversation of its own; equal seq
go by tie, which the caller sets; repeated rows are messages each; empty tables give no rows. Very long texts are one message
each, held one at a time. Columns beside those named aren't read, and clash with none.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, read

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[SAY]", "[END]")
START = r"([<\[])(?=" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")"
USER, ASSISTANT, OTHER = ("[INST] ", " [/INST]"), ("[ANS] ", " </s>"), ("[ROLE] ", " [SAY] ", " [END]")


def escaped(text) -> F.Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), START, "$1\\\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def messages_of(events: DataFrame) -> DataFrame:
    """(conv_id, seq, tie, role, text): the final messages, seq and tie being those of their first event."""
    one, when = Window.partitionBy("conv_id", "msg"), F.struct("seq", "tie")
    folded = (
        events.withColumn("__at", when)
        .withColumn("__base", F.max(F.when(F.col("kind") != "delta", F.col("__at"))).over(one)).withColumn("__first", F.min("__at").over(one)).withColumn("__again", F.max(F.when(F.col("kind") == "regenerate", F.col("__at"))).over(one))
        .withColumn("__role", F.when(F.col("__at") == F.col("__first"), F.coalesce("role", F.lit(""))))
        .where("__base IS NULL OR __at >= __base OR __at = __first")
    )
    kept = F.when(F.col("__base").isNull() | (F.col("__at") >= F.col("__base")), F.struct("__at", F.coalesce("text", F.lit("")).alias("text")))
    whole = folded.groupBy("conv_id", "msg").agg(
        F.first("__first").alias("first"), F.max("__role").alias("role"), F.first("__again").alias("again"),
        F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"]), "").alias("text"),
    )
    along = Window.partitionBy("conv_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    live = whole.withColumn("__cut", F.max("again").over(along)).where("__cut IS NULL OR __cut < first")
    return live.select("conv_id", "first.seq", "first.tie", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """Add segment (the message in the template) and loss_start, loss_chars: where in it loss is taken, in code points."""
    body, role = escaped(F.coalesce("text", F.lit(""))), F.coalesce("role", F.lit(""))
    around = lambda marks, *parts: F.concat(*[x for pair in zip(map(F.lit, marks), (*parts, None)) for x in pair if x is not None])
    segment = F.when(role == "user", around(USER, body)).when(role == "assistant", around(ASSISTANT, body)).otherwise(around(OTHER, escaped(role), body))
    loss = F.when(role == "assistant", F.length(body)).otherwise(F.lit(0))
    return messages.withColumn("segment", segment).withColumn("loss_start", F.lit(len(ASSISTANT[0]))).withColumn("loss_chars", loss)


class Reader:
    """Reads turns from a conversation's text as it comes in; no more than the turn that is still open is held."""

    CLOSES = {"[INST]": (USER, "user"), "[ANS]": (ASSISTANT, "assistant"), "[ROLE]": (OTHER, None)}
    CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))

    def __init__(self):
        self.text = ""

    def feed(self, piece: str):
        """The (role, text) of each turn that piece completes."""
        self.text += piece
        at = 0
        while (opening := self.CONTROL.match(self.text, at)) and (turn := self.turn(opening)):
            yield turn[0]
            at = turn[1]
        self.text = self.text[at:]

    def turn(self, opening):
        marks, role = self.CLOSES[opening[0]]
        parts, at = [], opening.end()
        for mark in marks[1:]:
            found = self.CONTROL.search(self.text, at)
            if not found:
                return None
            if found[0] != mark.strip():
                raise ValueError(f"{found[0]} where {mark.strip()} is due")
            parts.append(unescape(self.text[at + 1 : found.start() - 1]))  # a space on either side
            at = found.end()
        return ((role, parts[0]) if role else (parts[0], parts[1])), at

    def close(self):
        if self.text:
            raise ValueError("a turn is not closed")


def digests(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from its text, which comes in segments in order; a task holds one message at a time."""

    def run(batches):
        current, state, rows = object(), None, []

        def close():
            if state:
                state[5].close()
                rows.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            ids, segments, starts, chars = (batch.column(i) for i in (0, 1, 2, 3))
            for i in range(batch.num_rows):
                conv, segment, start, n = ids[i].as_py(), segments[i].as_py(), starts[i].as_py(), chars[i].as_py()
                if conv != current:
                    close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, Reader()]
                for role, text in state[5].feed(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(segment[start : start + n])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(segment)
            if rows:
                yield frame(rows)
                rows.clear()
        close()
        if rows:
            yield frame(rows)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    frame = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    order = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "tie").select(F.col("conv_id").cast("long"), "segment", "loss_start", "loss_chars")
    return order.mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of(conversations: DataFrame) -> DataFrame:
    """Rows by turn as events: each a whole message; repeated turns are told apart by role and text."""
    alike = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.row_number().over(alike).alias("tie"), "role", "text")
    return rows.withColumn("kind", F.lit("message")).withColumn("msg", F.struct("seq", "tie"))


def op2_chat_format(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    table = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(render(messages_of(events_of(table.unionByName(probe)))))


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP2_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS said_by, coalesce(text, '') AS said, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS tie FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 1
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 1
), s AS (
  SELECT *, length({_escaped_sql("said")}) + CASE said_by WHEN 'user' THEN {len("".join(USER))} WHEN 'assistant' THEN {len("".join(ASSISTANT))} ELSE {len("".join(OTHER))} + length({_escaped_sql("said_by")}) END AS chars FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(said_by || chr(10) || said || chr(10), '' ORDER BY turn, tie)) AS turns_sha256,
       coalesce(sum(length(said)) FILTER (WHERE said_by = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(said, '' ORDER BY turn, tie) FILTER (WHERE said_by = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
