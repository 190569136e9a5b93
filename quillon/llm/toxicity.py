"""Toxicity by a counterfactually regularised linear classifier.

A text's features are those of its words: the word, its beginnings and its ends, once, twice or more often. They are hashes of
runs of letters, taken from sums over the whole text at once. The most telling ones of the
labelled texts are the vocabulary, each scaled by its log ratio between the classes.
The loss is logistic, with a ridge and a counterfactual term: in labelled texts' sentences, identity terms are swapped
for others of their group, and the square of the change of score is penalised. A score so can't
rest on which group a sentence names, and neutral mentions of a group that labelled texts insult aren't taken for insults.

It is fitted on at most SAMPLE labelled texts, half of each class where there are as many, which are weighted as the
classes are in all labelled rows. Only those texts' ids are broadcast, and no text is shuffled.

Cases: a null, empty or wordless text has the score of no features; null labels are not learned from; a doc_id with
several labels is toxic if one says so; a doc_id that repeats is a text each; with labels of one class or none all scores
are that class's share, or 0; whole texts are read, very long ones in slices; other columns pass through, and those
named like a result are replaced. No rows, no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, lean, read, save

#: Labelled texts to learn from, features, labelled texts that a feature is in at least, and swaps of a text.
SAMPLE, VOCABULARY, LEAST, SWAPS = 16384, 8192, 3, 3
#: Occurrences from which on a feature counts, and counts more.
LEVELS = (1, 2, 4)
STARTS, ENDS, SLICE = (3, 4, 5, 6, 7), (4, 5), 1 << 19
RIDGE, FAIR = 1e-5, 1.0
THRESHOLD = 0.7
ODD, SLOTS_LOG2 = np.uint64(0x9E3779B97F4A7C15), 18
BASE = 0x5851F42D4C957F2D
#: Identity terms that stand for one another, by what they tell of people.
IDENTITIES = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "american", "mexican", "chinese", "indian"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("old", "young", "disabled", "blind", "deaf"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")


class Hasher:
    """Features of texts. Sums over powers of an odd number tell any run of characters by two look-ups."""

    def __init__(self):
        self.letter = np.zeros(0x110000, bool)
        for lo in range(0, 0x110000, 1 << 16):
            self.letter[lo : lo + (1 << 16)] = [chr(i).isalpha() for i in range(lo, lo + (1 << 16))]
        steps = np.full(SLICE + 1, np.uint64(BASE))
        steps[0] = 1
        inverse = np.full(SLICE + 1, np.uint64(pow(BASE, -1, 1 << 64)))
        inverse[0] = 1
        self.power, self.back = np.cumprod(steps), np.cumprod(inverse)  # modulo 2**64

    def parts(self, text: str):
        """Features of the text, slice by slice; a slice ends where a word does, if one does in it."""
        low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        at = 0
        while at < len(low):
            part = low[at : at + SLICE]
            inside = self.letter[part]
            if at + len(part) < len(low) and not inside.all():
                part = part[: len(part) - int(np.argmin(inside[::-1]))]
                inside = inside[: len(part)]
            at += len(part)
            yield self.slice(part, inside)

    def slice(self, part: np.ndarray, inside: np.ndarray) -> np.ndarray:
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        with np.errstate(over="ignore"):
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.power[: len(part)])])
            run = lambda i, j, kind: ((upto[j] - upto[i]) * self.back[i] + np.uint64(kind)) * ODD
            long = end - start
            found = [run(start, end, 1)]
            for n in STARTS:
                s = start[long > n]
                found.append(run(s, s + n, 2 * n))
            for n in ENDS:
                e = end[long > n]
                found.append(run(e - n, e, 2 * n + 1))
        return np.concatenate(found)

    def of(self, text: str | None) -> np.ndarray:
        """The distinct features of a text."""
        return np.unique(np.concatenate([np.empty(0, np.uint64), *(np.unique(p) for p in self.parts(text or ""))]))


@dataclass
class Vocabulary:
    """Columns of features, in hash tables by their upper bits; features whose slots are taken are in the next one."""

    features: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self):
        left = np.arange(len(self.features))
        while len(left):
            slot = self.slots(self.features[left], len(self.tables))
            _, first = np.unique(slot, return_index=True)
            keys, column = np.zeros(1 << SLOTS_LOG2, np.uint64), np.full(1 << SLOTS_LOG2, -1, np.int32)
            keys[slot[first]], column[slot[first]] = self.features[left[first]], left[first]
            self.tables.append((keys, column))
            left = np.delete(left, first)

    @staticmethod
    def slots(features: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((features * (ODD + np.uint64(2 * table * 0x632BE59BD9B4E019 & (1 << 64) - 1))) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)

    def columns(self, hasher: Hasher, text: str | None) -> np.ndarray:
        """Columns of a text: a feature has one for each of LEVELS that its occurrences reach."""
        found = []
        for part in hasher.parts(text or ""):
            for k, (keys, column) in enumerate(self.tables):
                slot = self.slots(part, k)
                hit = column[slot]
                found.append(hit[(keys[slot] == part) & (hit >= 0)])
        held, times = np.unique(np.concatenate([np.empty(0, np.int32), *found]), return_counts=True)
        return np.sort(np.concatenate([held[times >= n] * len(LEVELS) + k for k, n in enumerate(LEVELS)]))


def swapped(text: str, identities=IDENTITIES, swaps: int = SWAPS) -> list[str]:
    """The text with the identity terms of its sentences changed for others of their groups, swaps times; [] if it has none."""
    other = {t: group for group in identities for t in group}
    pattern = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, sorted(other, key=len, reverse=True))) + r")(?!\w)", re.IGNORECASE)
    if not other or not pattern.search(text):
        return []
    out = []
    for k in range(1, swaps + 1):

        def change(m):
            group = other[m[0].lower()]
            return group[(group.index(m[0].lower()) + 1 + (k - 1) % max(1, len(group) - 1)) % len(group)]

        out.append("".join(pattern.sub(change, s) for s in SENTENCE.findall(text)))
    return list(dict.fromkeys(out))


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    bias: float

    def score(self, hasher: Hasher, text: str | None) -> float:
        z = self.bias + float(self.weights[self.vocabulary.columns(hasher, text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def minimise(f, x: np.ndarray, rounds: int = 200, memory: int = 10, close: float = 1e-6) -> np.ndarray:
    """Limited-memory quasi-Newton descent; f gives the value and the gradient."""
    value, slope = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, held = slope.copy(), []
        for s, y in reversed(steps):
            held.append(a := s @ d / (s @ y))
            d -= a * y
        if steps:
            s, y = steps[-1]
            d *= s @ y / (y @ y)
        for (s, y), a in zip(steps, reversed(held)):
            d += s * (a - y @ d / (s @ y))
        if d @ slope <= 0:
            d, steps = slope.copy(), []
        rate = 1.0 if steps else 1 / max(1.0, np.linalg.norm(d))
        while True:
            there = x - rate * d
            new, new_slope = f(there)
            if new <= value - 1e-4 * rate * (d @ slope) or rate < 1e-12:
                break
            rate /= 2
        s, y = there - x, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y)]
        done = abs(value - new) <= close * max(1e-9, abs(value)) or rate < 1e-12
        x, value, slope = there, new, new_slope
        if done:
            break
    return x


def fit(rows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray, ridge: float = RIDGE, fair: float = FAIR) -> tuple[np.ndarray, float]:
    """(weights, bias) for presence features of the given scale; pairs are columns of texts and of their swapped versions."""
    d, lengths = len(scale), [len(r) for r in rows]
    at, cols = np.repeat(np.arange(len(rows)), lengths), np.concatenate([np.empty(0, np.int32), *rows])
    value = scale[cols]
    gone, new = [np.setdiff1d(x, y) for x, y in pairs], [np.setdiff1d(y, x) for x, y in pairs]
    pair_at = np.concatenate([np.repeat(np.arange(len(pairs)), [len(g) for g in side]) for side in (gone, new)]).astype(np.int64)
    pair_cols = np.concatenate([np.empty(0, np.int64), *gone, *new]).astype(np.int64)
    pair_value = scale[pair_cols] * np.repeat([1.0, -1.0], [sum(map(len, gone)), sum(map(len, new))])
    weight, sign = weight / weight.sum(), np.where(toxic, 1.0, -1.0)

    def loss(x):
        w, b = x[:-1], x[-1]
        z = sign * (np.bincount(at, value * w[cols], len(rows)) + b)
        pull = -weight * sign / (1 + np.exp(np.clip(z, -500, 500)))
        slope = np.append(np.bincount(cols, value * pull[at], d) + ridge * w, pull.sum())
        out = (weight * np.logaddexp(0, -z)).sum() + ridge / 2 * (w @ w)
        if len(pairs):
            change = np.bincount(pair_at, pair_value * w[pair_cols], len(pairs))
            out += fair * (change @ change) / len(pairs)
            slope[:-1] += 2 * fair / len(pairs) * np.bincount(pair_cols, pair_value * change[pair_at], d)
        return out, slope

    x = minimise(loss, np.zeros(d + 1))
    return x[:-1] * scale, float(x[-1])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY, identities=IDENTITIES, ridge: float = RIDGE, fair: float = FAIR) -> Model:
    """Learn from labels (doc_id, toxic) of documents (doc_id, text) that aren't held out."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = save(docs.select("doc_id").join(usable, "doc_id").select("doc_id", (F.col("toxic") > 0).alias("toxic"), F.xxhash64(F.lit("toxic"), "doc_id").alias("draw")), "labelled-ids")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    nothing = Model(Vocabulary(np.empty(0, np.uint64)), np.empty(0), -500.0 if not sizes.get(True) else 500.0)
    if len(sizes) < 2:
        discard(known)
        return nothing
    few = min(sizes.values())
    most = {c: max(sample // 2, sample - few) if sizes[c] > few else sample // 2 for c in sizes}
    chosen = save(known.where("toxic").orderBy("draw").limit(most[True]).unionAll(known.where("NOT toxic").orderBy("draw").limit(most[False])).select("doc_id", "toxic").distinct(), "labelled-sample")
    discard(known)
    # Bounded: at most sample ids.
    texts = save(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "labelled-texts")

    def count(batches):
        hasher, found = Hasher(), {False: [], True: []}
        for batch in batches:
            for i in range(batch.num_rows):
                found[batch.column(0)[i].as_py()].append(hasher.of(batch.column(1)[i].as_py()))
            for c, parts in found.items():
                if parts:
                    keys, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n * (not c)), pa.array(n * c)], names=["feature", "clean", "toxic"])
                parts.clear()

    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    counted = texts.mapInArrow(lean(count), "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST)
    ratio = F.log((F.col("toxic") + 1) / (n[True] + 2)) - F.log((F.col("clean") + 1) / (n[False] + 2))
    told = F.abs(ratio) * F.sqrt(F.col("clean") + F.col("toxic"))
    # Bounded: vocabulary rows.
    rows = counted.select("feature", ratio.alias("ratio"), told.alias("told")).orderBy(F.desc("told"), "feature").limit(vocabulary).collect()
    words = Vocabulary(np.array([r["feature"] for r in rows], np.int64).astype(np.uint64))

    def present(batches):
        hasher = Hasher()
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                packed = lambda t: words.columns(hasher, t).astype("<i4").tobytes()
                out.append((batch.column(0)[i].as_py(), packed(text), [packed(s) for s in swapped(text, identities)]))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.bool_(), pa.binary(), pa.list_(pa.binary())))], names=["toxic", "own", "swapped"])

    held = save(texts.mapInArrow(lean(present), "toxic boolean, own binary, swapped array<binary>"), "labelled-features")
    found = sorted(held.collect(), key=lambda r: (r["toxic"], r["own"], r["swapped"]))
    for done in (chosen, texts, held):
        discard(done)
    columns = [np.frombuffer(r["own"], "<i4") for r in found]
    pairs = [(x, np.frombuffer(s, "<i4")) for x, r in zip(columns, found) for s in r["swapped"]]
    toxic = np.array([r["toxic"] for r in found])
    weight = np.where(toxic, sizes[True] / n[True], sizes[False] / n[False])
    scale = np.repeat(np.abs(np.array([r["ratio"] for r in rows], float)), len(LEVELS))
    return Model(words, *fit(columns, toxic, weight, pairs, scale, ridge, fair))


def predict(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, from the texts alone."""
    docs = docs.select(*[docs[c] for c in docs.columns if c != score])
    # Bounded by the vocabulary.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hasher, m = Hasher(), shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.score(hasher, texts[i].as_py()) for i in range(batch.num_rows)], pa.float64())], names=[*batch.schema.names, score])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def op12_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    found = save(predict(docs, model).drop("text"), "toxicity")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
