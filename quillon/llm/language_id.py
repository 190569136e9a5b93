"""Language identification by string kernels.

The kernel of two texts counts the character n-grams (n = 1, 2, 3 together: a blended spectrum)
that both hold, each once however often it occurs, over the geometric mean of their numbers.
Landmark texts span a Nyström approximation of it, on which one ridge regression per language
is fitted against the rest. A text's score is the product of its presence vector with
(landmark n-grams x landmarks) x (landmarks x languages); the two right-hand factors do not
depend on the text and are multiplied once, so a batch is scored by one matrix product.

The vocabulary is the n-grams that two landmarks share (all, if none is shared); the kernel is taken over these, in fitting and in prediction alike.
It is fitted on at most SAMPLE labelled texts, as many of each language as they allow, and on one at least of every language, however many there are.

Cases: a null text, or one with no letter, is ``und`` with score 0; with nothing to learn from,
every text is. Rows are independent, so repeated rows agree; whole texts are read, long ones in
slices. Equal scores go to the language first in code-point order. Other columns pass through; those named like the two results are replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, read, save

ORDERS = (1, 2, 3)
SLOTS_LOG2, ODD = 20, np.uint64(0x9E3779B97F4A7C15)
#: Labelled texts to learn from: in all, of a language, and the length beyond which a text is taken only where a language has no shorter ones.
SAMPLE, PER_LANGUAGE, USUAL_CHARS = 4096, 300, 20000
SLICE, BATCH = 1 << 19, 64
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """Codes of all n-grams: 21 bits a code point, exact for n <= 3."""
    code = points.astype(np.uint64)
    out = code[: len(code) - n + 1]
    for k in range(1, n):
        out = (out << np.uint64(21)) | code[k : len(code) - n + 1 + k]
    return out | (np.uint64(n - 1) << np.uint64(62)) if n < 3 else out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def slots(g: np.ndarray, table: int) -> np.ndarray:
    """Where n-grams are in a model's table of that number."""
    with np.errstate(over="ignore"):
        h = g * (ODD + np.uint64(2 * table * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    return (h >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    tables: list[tuple[np.ndarray, np.ndarray]]
    """Hash tables: the n-gram in each slot (an impossible code where none is) and its column. n-grams whose slots are taken are in the next one."""
    coefficients: np.ndarray
    """n-grams x languages."""

    def present(self, text: str, row: np.ndarray) -> None:
        """Mark in row the columns of the n-grams that text holds."""
        p = points(text)
        for at in range(0, len(p), SLICE):
            part = p[at : at + SLICE + max(ORDERS) - 1]
            for n in ORDERS:
                if len(part) >= n:
                    g = grams(part, n)
                    for k, (keys, column) in enumerate(self.tables):
                        slot = slots(g, k)
                        row[column[slot[keys[slot] == g]]] = 1

    def scores(self, texts: list[str]) -> np.ndarray:
        held = np.zeros((len(texts), len(self.coefficients)), np.float32)
        for text, row in zip(texts, held):
            self.present(text, row)
        return (held @ self.coefficients) / np.sqrt(np.maximum(held.sum(1, keepdims=True), 1))


def fit(texts: list[str], langs: list[str], landmarks: int = 400, ridge: float = 1e-2, jitter: float = 1e-6) -> Model | None:
    languages = sorted(set(langs))
    if not languages:
        return None
    by_lang = {x: [i for i, y in enumerate(langs) if y == x] for x in languages}
    chosen = [i for x in languages for i in by_lang[x][: max(1, landmarks // len(languages))]]
    own = [np.unique(np.concatenate([np.empty(0, np.uint64), *(grams(p, n) for n in ORDERS if len(p) >= n)])) for p in (points(texts[i]) for i in chosen)]
    vocabulary, counts = np.unique(np.concatenate(own), return_counts=True)
    if (counts > 1).any():
        vocabulary = vocabulary[counts > 1]
    tables, left = [], np.arange(len(vocabulary))
    while len(left):
        slot = slots(vocabulary[left], len(tables))
        _, first = np.unique(slot, return_index=True)
        keys, column = np.full(1 << SLOTS_LOG2, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << SLOTS_LOG2, np.int32)
        keys[slot[first]], column[slot[first]] = vocabulary[left[first]], left[first]
        tables.append((keys, column))
        left = np.delete(left, first)
    model = Model(languages, tables, np.zeros((len(vocabulary), len(languages)), np.float32))

    def vectors(which: list[int]) -> np.ndarray:
        held = np.zeros((len(which), len(vocabulary)), np.float32)
        for i, row in zip(which, held):
            model.present(texts[i], row)
        return held / np.sqrt(np.maximum(held.sum(1, keepdims=True), 1))

    z = vectors(chosen)
    values, basis = np.linalg.eigh((z @ z.T).astype(np.float64) + jitter * np.eye(len(z)))
    root = basis / np.sqrt(np.maximum(values, jitter))  # K_mm^(-1/2), up to a rotation
    moment, target = np.zeros((len(z), len(z))), np.zeros((len(z), len(languages)))
    for at in range(0, len(texts), 256):
        which = list(range(at, min(at + 256, len(texts))))
        phi = (vectors(which) @ z.T).astype(np.float64) @ root
        moment += phi.T @ phi
        target += phi.T @ np.array([[1.0 if langs[i] == x else -1.0 for x in languages] for i in which])
    weights = root @ np.linalg.solve(moment + ridge * len(texts) * np.eye(len(z)) / 100, target)
    model.coefficients = (z.T @ weights).astype(np.float32)
    return model


def training_rows(docs: DataFrame, sample: int = SAMPLE, per_language: int = PER_LANGUAGE, usual_chars: int = USUAL_CHARS) -> list:
    """The labelled texts to learn from, chosen by rank within their language: usual lengths before long texts, then by a hash of doc_id."""
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    place = F.struct((F.length("text") > usual_chars).alias("long"), F.xxhash64(F.lit("lid"), "doc_id").alias("draw"), F.xxhash64("text").alias("other"))
    keyed = usable.select("lang", "text", place.alias("place"))
    languages = usable.select("lang").distinct().count()
    each = max(1, min(per_language, sample // max(1, languages)))
    # Ranks are taken over narrow rows, of which only the first leave a task; the last one of a language then selects the texts.
    ranked = keyed.select("lang", "place").withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("nth") <= each)
    last = ranked.groupBy("lang").agg(F.max("place").alias("last")).collect()  # a row for each language, as the model has
    if not last:
        return []
    # Looked up in the expression, so that no text is shuffled.
    bound = F.create_map(*[x for r in last for x in (F.lit(r["lang"]), F.struct(F.lit(r["last"]["long"]).alias("long"), F.lit(r["last"]["draw"]).alias("draw"), F.lit(r["last"]["other"]).alias("other")))])
    rows = keyed.where(F.col("place") <= F.element_at(bound, F.col("lang"))).dropDuplicates(["lang", "place"]).select("lang", "text", "place").collect()
    return sorted(rows, key=lambda r: (r["lang"], r["place"]))


def train(docs: DataFrame, **bounds) -> Model | None:
    rows = training_rows(docs, **bounds)
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with a language and a score from 0 to 1, from the texts alone."""
    docs = docs.select(*[docs[c] for c in docs.columns if c not in (label, score)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            labels, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            rows, held = [], []

            def settle():
                s = m.scores(held)
                best = s.argmax(1)
                scores[rows] = np.clip((s[np.arange(len(rows)), best].astype(np.float64) + 1) / 2, 0, 1)
                for i, b in zip(rows, best):
                    labels[i] = m.languages[b]
                rows.clear()
                held.clear()

            for i in range(batch.num_rows if m else 0):
                x = texts[i].as_py()
                if x and LETTER.search(x):
                    rows.append(i)
                    held.append(x)
                    if len(rows) == BATCH:
                        settle()
            if rows:
                settle()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores)], names=[*batch.schema.names, label, score])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())]))


def op6_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    found = save(predict(docs.select("doc_id", "text"), model).drop("text"), "languages")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
