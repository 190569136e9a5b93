"""N-gram Jaccard join: which documents share nearly all their word n-grams.

Document x n-gram incidence is a sparse 0/1 matrix A; A times its transpose counts overlaps. Only
the part of it that can hold a link is built. With one global order of n-grams, two sets of
similarity t or more share an n-gram among the first n - ceil(t n) + 1 of each (their heads), so
heads alone are multiplied first, a bucket of n-grams at a time. The order is by hash, but n-grams in more
documents than a short posting list holds come last (they are counted exactly among the hashes that heads are taken from, and known by a
Bloom filter; any one filter gives one order, so its errors cost speed alone). A short list is multiplied
out; overlaps within heads are summed per pair, and pairs below the bound that their sizes set are
discarded. A long list stems from a family of near copies, whose every n-gram is frequent; its members are tied to its first one, not to each other.

What hangs together by such pairs and ties is a group. A group's whole sets are multiplied block by block: a task
holds two blocks of bounded size, accumulates the overlaps of all their pairs as dense products over
slices of the n-grams, and hands on a spanning forest of the links, so that no step has a row for each
pair of a group. Blocks hold sets of like size, and blocks whose sizes rule out a link never meet.

Documents with equal sets are one class and enter once.

Cases: null or white-space texts have no n-grams and link with nothing; fewer words than n make
one n-gram of all; a null doc_id takes no part (component null, size counted); rows that repeat
a doc_id are one document with the links of all; equal sets always link; no rows, no result.
Other columns than doc_id and text aren't read. Very long texts are read whole; one is a block of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, lean, read, save

M1, M2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A fixed odd 64-bit number per byte value, A-Z as a-z.
with np.errstate(over="ignore"):
    _seed = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * STEP
    _seed = (_seed ^ (_seed >> np.uint64(30))) * M1
    BYTE = ((_seed ^ (_seed >> np.uint64(27))) * M2) | np.uint64(1)
BYTE[65:91] = BYTE[97:123]
#: Posting lists up to this length are multiplied out at once; an n-gram in more documents is frequent.
SHORT = 32
#: n-grams of a bucket, about; share of all hashes, as a multiple of a head's share of its set, among which frequent n-grams are told.
BUCKET, MARGIN = 1 << 19, 2.5
BLOOM_BITS = 12
GROUP_BYTES = 1 << 18
PAGE = 1 << 14
#: n-grams that a task sorts at once; sets and n-grams of a block of a group, at most (but for a set that is larger alone); cells of a dense slice.
CHUNK, ROWS, BLOCK, CELLS = 1 << 19, 1024, 1 << 18, 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes other than ASCII white space), A-Z lower-cased."""
    b = np.frombuffer(data, np.uint8)
    inside = ~SPACE[b]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    letters = np.flatnonzero(inside)
    lengths = stops - starts
    firsts = np.r_[0, np.cumsum(lengths)[:-1]]
    place = np.arange(len(letters)) - np.repeat(firsts, lengths)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), STEP, np.uint64))
        sums = np.add.reduceat(BYTE[b[letters]] * powers[place], firsts)
        return mixed(sums + lengths.astype(np.uint64))


def ngram_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes; all words as one n-gram where there are fewer than n."""
    if not len(words):
        return words
    k = min(n, len(words))
    with np.errstate(over="ignore"):
        h = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            h = mixed(h * STEP + words[j : len(words) - k + 1 + j])
        return np.unique(h + np.uint64(k))


def sets_of(batch: pa.RecordBatch, text: str, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of an Arrow batch; words of several texts are hashed together, about GROUP_BYTES at a time."""
    column, group, size = batch.column(batch.schema.get_field_index(text)), [], 0

    def settle():
        parts = [x for _, x in group]
        hashes = word_hashes(b" ".join(parts))
        joined = np.frombuffer(b" ".join(parts), np.uint8)
        inside = ~SPACE[joined]
        starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
        bounds = np.cumsum([0, *(len(x) + 1 for x in parts)])
        at = np.searchsorted(starts, bounds)
        for (i, _), lo, hi in zip(group, at[:-1], at[1:]):
            yield i, ngram_set(hashes[lo:hi], n)

    for i in range(batch.num_rows):
        x = (column[i].as_py() or "").encode("utf-8", "surrogatepass")
        group.append((i, x))
        size += len(x)
        if size > GROUP_BYTES:
            yield from settle()
            group, size = [], 0
    if group:
        yield from settle()


def class_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def head_size(n: int, t: Fraction) -> int:
    return n - math.ceil(t * n) + 1


def dealt(bucket: np.ndarray, arrays: list[np.ndarray]) -> tuple[np.ndarray, list[list[bytes]]]:
    """The numbers of the buckets that occur, and for each array the bytes that each of them gets."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
    return bucket[cuts[:-1]], [[x[order[lo:hi]].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])] for x in arrays]


def bucket_of(g: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(g) >> np.uint64(16)).astype(np.int64) % buckets


def cut_of(t: Fraction) -> np.uint64:
    """Hashes below it are where frequent n-grams are told."""
    return np.uint64(min((1 << 64) - 1, int(MARGIN * float(1 - t) * (1 << 64))))


def scan(docs: DataFrame, n: int, t: Fraction, buckets: int) -> DataFrame:
    """One pass over the texts: kind 0 rows (doc_id, n, class), and kind 1 rows (bucket, how many, n-grams and their counts).

    Counts are summed over a chunk of a task before they leave, so a frequent n-gram leaves once a chunk.
    """
    cut = cut_of(t)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, out = batch.column(0), []
            for i, s in sets_of(batch, "text", n):
                out.append((0, ids[i].as_py(), len(s), class_key(s) if len(s) else None))
                held.append(s[: np.searchsorted(s, cut)])
                size += len(held[-1])
                if size > CHUNK:
                    yield counted(held)
                    held, size = [], 0
            yield rows(*zip(*out)) if out else rows((), (), (), ())
        if size:
            yield counted(held)

    def counted(held):
        g, c = np.unique(np.concatenate(held), return_counts=True)
        at, (raw_g, raw_c) = dealt(bucket_of(g, buckets), [g, c.astype(np.uint32)])
        return rows(np.ones(len(at), int), at, [len(x) // 4 for x in raw_c], [x + y for x, y in zip(raw_g, raw_c)])

    def rows(kind, a, b, key):
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.binary())], names=["kind", "a", "b", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "kind int, a long, b long, key binary")


def frequent_of(counts: DataFrame, short: int) -> DataFrame:
    """The n-grams in more than short documents, from scan()'s rows of kind 1."""

    def run(batches):
        current, held = None, []

        def close():
            g = np.concatenate([x[: 8 * k].view(np.uint64) for k, x in held])
            c = np.concatenate([x[8 * k :].view(np.uint32) for k, x in held])
            order = np.argsort(g, kind="stable")
            g, c = g[order], c[order].astype(np.int64)
            new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(g[new][np.add.reduceat(c, new) > short].view(np.int64))], names=["gram"])

        for batch in batches:
            for bucket, k, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket != current and held:
                    yield close()
                    held = []
                current = bucket
                held.append((k, np.frombuffer(raw, np.uint8)))
        if held:
            yield close()

    return counts.select("a", "b", "key").repartition("a").sortWithinPartitions("a").mapInArrow(lean(run), "gram long")


def head_of(s: np.ndarray, t: Fraction, bits: np.ndarray) -> np.ndarray:
    """The first n-grams of a sorted set, frequent ones coming last."""
    h = head_size(len(s), t)
    for upto in (3 * h, len(s)):
        part = s[:upto]
        rare = ~known(part, bits)
        if rare.sum() >= h:
            return part[rare][:h]
    return np.concatenate([part[rare], part[~rare]])[:h]


def heads(docs: DataFrame, n: int, t: Fraction, frequent) -> DataFrame:
    """(key, n, head): the head of every set, once for each task and class."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for _, s in sets_of(batch, "text", n):
                if len(s) and (key := class_key(s)) not in seen:
                    if len(seen) < 200_000:
                        seen.add(key)
                    out.append((key, len(s), head_of(s, t, frequent.value).tobytes()))
            key, size, head = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(size, pa.int32()), pa.array(head, pa.binary())], names=["key", "n", "head"])

    return docs.select("text").mapInArrow(lean(run), "key binary, n int, head binary")


def postings(classes: DataFrame, buckets: int, short: int = SHORT) -> DataFrame:
    """(bucket, grams, nodes, sizes, ties): the n-grams of heads (node, n, head), dealt to buckets as raw arrays.

    Of an n-gram that more than short sets of a chunk hold, one posting leaves for each tie: the smallest node stands for the others,
    which are listed in ties rows (bucket null; nodes: pairs). Its size is negative then, which marks the list as long.
    """

    def run(batches):
        held, size = [], 0
        for batch in batches:
            found = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            lengths = [len(x) for x in found]
            held.append((np.concatenate([np.empty(0, np.uint64), *found]), np.repeat(np.asarray(batch.column(0), dtype=np.int64), lengths), np.repeat(np.asarray(batch.column(1), dtype=np.int32), lengths)))
            size += sum(lengths)
            if size > CHUNK:
                yield leaving(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if size:
            yield leaving(*(np.concatenate(x) for x in zip(*held)))

    def leaving(g, own, n):
        order = np.lexsort((own, g))
        g, own, n = g[order], own[order], n[order]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        length = np.diff(np.r_[start, len(g)])
        long = length > short
        ties = np.stack([np.repeat(own[start], length), own], 1)[np.repeat(long, length)]
        ties = np.unique(ties[ties[:, 0] != ties[:, 1]], axis=0)
        stay = np.repeat(~long, length)
        stay[start] = True
        n[start[long]] *= -1
        at, raw = dealt(bucket_of(g[stay], buckets), [g[stay], own[stay], n[stay]])
        binary = lambda x, more: pa.array([*x, more], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([*at.tolist(), None], pa.int64()), *(binary(x, None) for x in raw), binary([None] * len(at), ties.tobytes())], names=["bucket", "grams", "nodes", "sizes", "ties"])

    return classes.select("node", "n", "head").mapInArrow(lean(run), "bucket long, grams binary, nodes binary, sizes binary, ties binary")


def product(lists: DataFrame, t: Fraction, short: int = SHORT) -> DataFrame:
    """(a, b, na, nb, c) from postings(): a row with the overlaps c > 0 that a bucket has of a pair, na <= nb, or
    a tie of two nodes of a long list (c = 0). Short lists are multiplied out."""
    num, den = t.numerator, t.denominator
    types = (np.uint64, np.int64, np.int32)

    def run(batches):
        current, held = None, []
        for batch in batches:
            for bucket, *raw, ties in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if bucket is None:
                    yield tied(np.frombuffer(ties, np.int64).reshape(-1, 2))
                    continue
                if bucket != current and held:
                    yield from multiplied(held)
                    held = []
                current = bucket
                held.append(raw)
        if held:
            yield from multiplied(held)

    def tied(pairs):
        return frame(pairs[:, 0], pairs[:, 1], 0, 0, 0)

    def multiplied(held):
        g, node, n = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held), types))
        order = np.lexsort((node, np.abs(n), g))
        g, node, n = g[order], node[order], n[order].astype(np.int64)
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        length = np.diff(np.r_[start, len(g)])
        long = (length > short) | (np.minimum.reduceat(n, start) < 0)
        for k in np.unique(length[~long & (length > 1)]):
            lists_of = start[~long & (length == k)]
            i, j = np.triu_indices(k, 1)
            step = max(1, CHUNK // (2 * len(i)))
            for at in range(0, len(lists_of), step):
                here = lists_of[at : at + step, None]
                x, y = (here + i).ravel(), (here + j).ravel()
                fits = (den * n[x] >= num * n[y]) & (node[x] != node[y])
                yield from summed(node[x[fits]], node[y[fits]], n[x[fits]], n[y[fits]])
        if long.any():
            ties = np.stack([np.repeat(np.minimum.reduceat(node, start), length), node], 1)[np.repeat(long, length)]
            yield tied(np.unique(ties[ties[:, 0] != ties[:, 1]], axis=0))

    def summed(a, b, na, nb):
        if len(a):
            order = np.lexsort((nb, na, b, a))
            rows = np.stack([a, b, na, nb], 1)[order]
            new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)])
            yield frame(*rows[new].T, np.diff(np.r_[new, len(rows)]))

    def frame(*columns):
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(x, len(columns[0])).copy(), pa.int64()) for x in columns], names=["a", "b", "na", "nb", "c"])

    # Rows of ties alone have no bucket; they needn't meet and are spread.
    spread = lists.withColumn("at", F.coalesce("bucket", -1 - F.pmod(F.xxhash64("ties"), F.lit(1 << 20))))
    return spread.repartition("at").sortWithinPartitions("at").drop("at").mapInArrow(lean(run), "a long, b long, na long, nb long, c long")


def bloom_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter over one long column, of BLOOM_BITS a number but 2^28 in all at most: a few tasks set bits of their own, which are merged."""
    log2 = min(28, max(20, math.ceil(math.log2(max(1, ids.count()) * BLOOM_BITS))))

    def run(batches):
        bits = np.zeros(1 << log2 >> 3, np.uint8)
        for batch in batches:
            for p in places(np.asarray(batch.column(0), dtype=np.int64).view(np.uint64), log2):
                np.bitwise_or.at(bits, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
        for i in np.flatnonzero(bits.reshape(-1, PAGE).any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(i)]), pa.array([bits[i * PAGE : (i + 1) * PAGE].tobytes()], pa.binary())], names=["part", "bits"])

    merged = ids.coalesce(4).mapInArrow(lean(run), "part long, bits binary").toArrow()
    bits = np.zeros(1 << log2 >> 3, np.uint8)
    for i, b in zip(merged.column(0).to_pylist(), merged.column(1).to_pylist()):
        bits[i * PAGE : (i + 1) * PAGE] |= np.frombuffer(b, np.uint8)
    return bits


def places(ids: np.ndarray, log2: int) -> list[np.ndarray]:
    """Where in a filter of 2^log2 bits each number has its own."""
    h, mask = mixed(ids + STEP), np.uint64((1 << log2) - 1)
    return [((h >> np.uint64(shift)) & mask).astype(np.int64) for shift in (0, 18, 36)]


def known(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which numbers may be in the filter."""
    with np.errstate(over="ignore"):
        hit = np.ones(len(ids), bool)
        for p in places(ids, len(bits).bit_length() + 2):
            hit &= (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return hit


def blocks(groups: DataFrame, classes: DataFrame, t: Fraction) -> DataFrame:
    """(component, s, i, s2, j, side, node, key): the pairs of blocks in which each set of a group meets others.

    A group of no more than a block's size is one block. A larger one is parted by size class (a power of 1/t; sets
    that link are in the same class or in neighbours) and by hash. groups: (node, component); classes: (key, node, n).
    """
    member = groups.join(classes, "node").withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / float(t))) + 1e-9))
    fits = lambda: F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / ROWS))
    whole = member.groupBy("component").agg(fits().alias("of")).select("component", (F.col("of") == 1).alias("one"))
    member = save(member.join(whole, "component").withColumn("cls", F.when(F.col("one"), F.lit(0)).otherwise(F.col("cls"))).drop("one"), "members")
    next_to = Window.partitionBy("component").orderBy("cls")  # a row for each size class
    per = member.groupBy("component", "cls").agg(fits().alias("k")).withColumn("after", F.lead(F.struct("cls", "k")).over(next_to)).withColumn("before", F.lag(F.struct("cls", "k")).over(next_to))
    per = per.select("component", "cls", "k", F.when(F.col("after.cls") == F.col("cls") + 1, F.col("after.k")).alias("up"), F.when(F.col("before.cls") == F.col("cls") - 1, F.col("before.k")).alias("down"))
    dealt = member.join(per, ["component", "cls"]).withColumn("own", F.pmod(F.xxhash64("key"), "k"))

    def tiles(other: str, s, i, s2, j, side):
        numbers = F.sequence(F.lit(0).cast("long"), F.col(other) - 1)
        return F.when(F.col(other).isNull(), F.array().cast("array<struct<s:bigint,i:bigint,s2:bigint,j:bigint,side:int>>")).otherwise(
            F.transform(numbers, lambda x: F.struct(*[y(x).cast("int" if name == "side" else "long").alias(name) for name, y in zip(("s", "i", "s2", "j", "side"), (s, i, s2, j, side))]))
        )

    cls, own, at, zero, one = (lambda x: F.col("cls")), (lambda x: F.col("own")), (lambda x: x), (lambda x: F.lit(0)), (lambda x: F.lit(1))
    inside = tiles("k", cls, lambda x: F.least(x, "own"), cls, lambda x: F.greatest(x, "own"), lambda x: (F.col("own") > x))
    above, below = tiles("up", cls, own, lambda x: F.col("cls") + 1, at, zero), tiles("down", lambda x: F.col("cls") - 1, at, cls, own, one)
    return dealt.select("component", "node", "key", F.explode(F.concat(inside, above, below)).alias("tile")).select("component", "tile.*", "node", "key")


def forest(left: list[np.ndarray], right: list[np.ndarray], t: Fraction) -> np.ndarray:
    """For each set (left ones, then right ones) the first that it hangs together with by links.

    Links are between left and right ones, or among the left ones where there are no right ones.
    """
    sets, m = left + right, len(left)
    sizes = np.array([len(x) for x in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    other, across = (slice(m, None), True) if right else (slice(0, m), False)
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64
    total = np.zeros((m, len(right) or m), kind)
    width = max(64, CELLS // len(sets))
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        dense = np.zeros((len(sets), width), kind)
        dense[row[a:b], column[a:b] - lo] = 1
        total += dense[:m] @ dense[other].T
    overlap = total.astype(np.int64)
    linked = t.denominator * overlap >= t.numerator * (sizes[:m, None] + sizes[other][None] - overlap)
    label = np.arange(len(sets))
    while True:  # the least label of all neighbours, until none changes
        before = label.copy()
        label[:m] = np.minimum(label[:m], np.where(linked, label[other][None], len(sets)).min(1))
        if across:
            label[m:] = np.minimum(label[m:], np.where(linked, label[:m, None], len(sets)).min(0))
        label = label[label]
        if (label == before).all():
            return label


def linked(docs: DataFrame, dealt: DataFrame, n: int, t: Fraction) -> DataFrame:
    """(a, b): a spanning forest of the links of each pair of blocks. dealt: as from blocks()."""
    spark = docs.sparkSession
    need = save(dealt, "tiles")
    shared = spark.sparkContext.broadcast(bloom_of(need.select("node").distinct()))

    def wanted(batches):
        bits = shared.value
        for batch in batches:
            hit = known(np.asarray(batch.column(0), dtype=np.int64).view(np.uint64), bits)
            keys, sets, size = [], [], 0
            for _, s in sets_of(batch.filter(pa.array(hit)), "text", n):
                if len(s):
                    keys.append(class_key(s))
                    sets.append(s.tobytes())
                    size += len(s)
                if size > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "set"])
                    keys, sets, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "set"])

    # A class's set is read from the rows of its own document, so copies aren't even hashed.
    sets = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(wanted), "key binary, set binary")
    tile = ["component", "s", "i", "s2", "j"]
    rows = sets.dropDuplicates(["key"]).join(need, "key").select(*tile, "side", "node", "set")

    def compare(batches):
        current, nodes, held = None, ([], []), ([], [])
        out: list[tuple[int, int]] = []

        def close():
            if held[0] and (held[1] or len(held[0]) > 1):
                names = nodes[0] + nodes[1]
                for k, first in enumerate(forest(held[0], held[1], t)):
                    if names[k] != names[first]:
                        out.append((names[first], names[k]))

        for batch in batches:
            for *at, side, node, data in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if at != current:
                    close()
                    current, nodes, held = at, ([], []), ([], [])
                nodes[side].append(node)
                held[side].append(np.frombuffer(data, np.uint64))
            if out:
                yield pairs_of(out)
                out.clear()
        close()
        if out:
            yield pairs_of(out)

    def pairs_of(out):
        a, b = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return save(rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(lean(compare), "a long, b long"), "links")


def enough(t: Fraction) -> F.Column:
    """Whether the overlap c of two heads can belong to a link: the bound that sizes na <= nb set."""
    r = float(t)
    return F.col("c") >= F.ceil(r / (1 + r) * (F.col("na") + F.col("nb")) - 1e-6) - (F.ceil(r * F.col("nb") - 1e-6) - 1)


def join(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), short: int = SHORT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    # The buckets' number follows from the texts' bytes, which file sizes bound below; a bucket is sorted in memory.
    chars = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / 6 * MARGIN * float(1 - threshold) / BUCKET))
    first = save(scan(docs, n, threshold, buckets), "scan")
    rows = save(first.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), "key"), "rows")
    frequent = spark.sparkContext.broadcast(bloom_of(save(frequent_of(first.where("kind = 1"), short), "frequent")))
    discard(first)
    ids = rows.where("key IS NOT NULL AND doc_id IS NOT NULL")
    # Nodes are documents: a class stands at its smallest doc_id, and a doc_id in several classes ties them.
    classes = save(ids.groupBy("key").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n")), "classes")
    ties = ids.join(classes, "key").where("doc_id <> node").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    again = ties.join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("lo").alias("v")).unionAll(ties.where("lo <> hi").select("lo", "hi"))
    again = save(again, "ties")
    found = save(heads(docs, n, threshold, frequent).join(classes.select("key", "node"), "key").dropDuplicates(["key"]).select("node", "n", "head"), "heads")
    counted = save(product(postings(found, buckets, short), threshold, short), "product")
    discard(found)
    pairs = counted.where("c > 0").groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c")).where(enough(threshold)).select("a", "b")
    groups = save(connected_components(pairs.unionAll(counted.where("c = 0").select("a", "b")).toDF("u", "v")), "groups")
    discard(counted)
    links = linked(docs, blocks(groups, classes, threshold), n, threshold)
    at = save(connected_components(links.toDF("u", "v").unionAll(again)), "components")
    named = classes.join(at, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    # Rows of a class meet by key; a hot class is a hot key of an equi-join that Spark may split.
    out = rows.join(named, "key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def op1_ngram_join(spark, sf_dir):
    return join(read(spark, sf_dir, "documents"), 3, Fraction(9, 10))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), chr(10))) AS k, sh FROM s
), c AS (
  SELECT k, any_value(n) AS n, any_value(sh) AS sh, min(doc_id) AS node FROM e WHERE n > 0 GROUP BY k
), g AS (
  SELECT node, n, unnest(sh) AS h FROM c
), h AS (
  SELECT g.node, g.n, g.h FROM g JOIN (SELECT h FROM g GROUP BY h HAVING count(*) >= 2) USING (h)
), p AS (
  SELECT x.node AS u, y.node AS v FROM h x JOIN h y ON x.h = y.h AND x.node < y.node GROUP BY x.node, y.node, x.n, y.n
  HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), both_ways AS (
  SELECT u, v FROM p UNION SELECT v, u FROM p
), r AS (
  SELECT u AS node, v AS other FROM both_ways UNION SELECT r.node, b.v FROM r JOIN both_ways b ON r.other = b.u
), m AS (
  SELECT node, min(other) AS least_other FROM r GROUP BY node
)
SELECT e.doc_id, e.n::BIGINT AS n_shingles, CASE WHEN e.n = 0 THEN e.doc_id ELSE least(c.node, coalesce(m.least_other, c.node)) END AS component_id
FROM e LEFT JOIN c USING (k) LEFT JOIN m ON m.node = c.node
"""
