"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one from each of several codebooks,
found by beam search; the squared norm of that sum is stored beside the codes. A query's distance from a code
is that norm less twice its inner product with the sum, for blocks of queries and codes by one matrix product.
The best of a block by that distance are reranked exactly, in double precision, on the original vectors, which lie beside the codes.

Codebooks are fitted on at most ``sample`` vectors. Every distinct vector is coded; of the ids that share one, the smallest
k + 1 stand in the answer, which are all that can, so that a vector in a third of all rows crowds out no other. Queries are scored in
blocks against all blocks of codes, each of which is in one lane; queries are copied to all lanes, and each lane gives only its nearest.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, as
queries or candidates; nor do rows with a null id. Vectors of different dimensions have no distance: each dimension is searched by itself.
Ties go to the smaller id. Rows alike in id and vector count once; an id with several vectors is as near as its nearest, and never its own
neighbour. Distances beyond double precision are infinite and come last. Other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, read, save

#: Numbers in a block of vectors and of queries.
CODE_BLOCK, QUERY_BLOCK = 1 << 20, 1 << 17
#: Queries that are scored at once, and codes whose smallest distance is looked at first.
TILE, NEAR = 32, 32
#: Places in lists that a lane holds before it gives them away.
HELD = 1 << 22


def usable(table: DataFrame, dim: int | None = None) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    v = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND size(vector) > 0")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return v.where(fine) if dim is None else v.where(fine & (F.size("vector") == dim))


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes by beam search, and the sums that they stand for."""
    n, m, k = len(x), books.shape[0], books.shape[1]
    square = (books**2).sum(2)
    left, cost, codes = x[:, None, :], (x**2).sum(1)[:, None], np.zeros((n, 1, 0), np.uint8)
    rows = np.arange(n)[:, None]
    for b in range(m):
        # |r - c|^2 = |r|^2 + |c|^2 - 2 r.c, and |r|^2 is the cost so far.
        d = (left.reshape(-1, x.shape[1]) @ (-2 * books[b].T)).reshape(n, -1, k)
        d += square[b]
        d += cost[:, :, None]
        flat = d.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, 1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
        parent, word = best // k, best % k
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], 2)
        left, cost = left[rows, parent], flat[rows, best]
        left -= books[b][word]
    at = cost.argmin(1)
    return codes[np.arange(n), at], x - left[np.arange(n), at]


def train(x: np.ndarray, books: int = 32, words: int = 64, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Full-dimensional codebooks, one after another: k-means over what the earlier ones leave."""
    rng, out, left = np.random.default_rng(seed), [], x.copy()
    for _ in range(books):
        centres = left[rng.choice(len(left), words, replace=len(left) < words)].copy()
        for _ in range(rounds):
            near = ((centres**2).sum(1)[None] - 2 * left @ centres.T).argmin(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, left)
            n = np.bincount(near, minlength=words)
            centres[n > 0] = sums[n > 0] / n[n > 0, None]
            centres[n == 0] = left[rng.integers(len(left), size=int((n == 0).sum()))]
        near = ((centres**2).sum(1)[None] - 2 * left @ centres.T).argmin(1)
        left -= centres[near]
        out.append(centres)
    return np.array(out)


def gathered(batches, most: int):
    """(ids, vectors) of batches of arrays, most rows at a time."""
    ids, vectors, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            ids.append(np.asarray(part.column(0).flatten(), dtype=np.int64).reshape(part.num_rows, -1))
            vectors.append(np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(part.num_rows, -1))
            held += part.num_rows
            if held >= most:
                i, v = np.concatenate(ids), np.concatenate(vectors)
                yield i[:most], v[:most]
                ids, vectors, held = [i[most:]], [v[most:]], held - most
    if held:
        yield np.concatenate(ids), np.concatenate(vectors)


def index(vectors: DataFrame, books: np.ndarray, beam: int = 4) -> DataFrame:
    """Blocks of vectors (ids, vector) and their codes: (block, ids, vectors, codes, norms), the last four as raw bytes. ids: [vec_id, rep]."""
    shared, most = vectors.sparkSession.sparkContext.broadcast(books), max(1, CODE_BLOCK // books.shape[2])

    def run(batches):
        b, task = shared.value, TaskContext.get().partitionId()
        for n, (ids, x) in enumerate(gathered(batches, most)):
            coded = [encode(x[at : at + 2048], b, beam) for at in range(0, len(x), 2048)]
            codes, norms = np.concatenate([c for c, _ in coded]), np.concatenate([(sums**2).sum(1) for _, sums in coded])
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + n]), *(pa.array([v.tobytes()], pa.binary()) for v in (ids, x, codes, norms))], names=["block", "ids", "vectors", "codes", "norms"])

    return vectors.mapInArrow(lean(run), "block long, ids binary, vectors binary, codes binary, norms binary")


def blocks(queries: DataFrame, dim: int) -> DataFrame:
    """Blocks of queries (ids, vector): (chunk, query_ids, queries). ids: [vec_id]."""

    def run(batches):
        task = TaskContext.get().partitionId()
        for n, (ids, x) in enumerate(gathered(batches, max(1, QUERY_BLOCK // dim))):
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + n]), *(pa.array([v.tobytes()], pa.binary()) for v in (ids, x))], names=["chunk", "query_ids", "queries"])

    return queries.mapInArrow(lean(run), "chunk long, query_ids binary, queries binary")


def smallest(d: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row of d the places of its n smallest numbers, in order; of equal ones the first."""
    if d.shape[1] <= n:
        return [np.argsort(row, kind="stable") for row in d]
    wide = -(-d.shape[1] // NEAR) * NEAR
    if wide // NEAR <= n:
        places = [np.flatnonzero(row <= most) for row, most in zip(d, np.partition(d, n - 1, 1)[:, n - 1])]
    else:
        groups = (d if wide == d.shape[1] else np.concatenate([d, np.full((len(d), wide - d.shape[1]), np.inf)], 1)).reshape(len(d), -1, NEAR)
        lowest, places = groups.min(2), []
        # The nth smallest of the groups' minima is no less than the nth smallest of all.
        for row, low, most in zip(groups, lowest, np.partition(lowest, n - 1, 1)[:, n - 1]):
            of = np.flatnonzero(low <= most)
            at = np.flatnonzero(row[of].ravel() <= most)
            at = of[at // NEAR] * NEAR + at % NEAR
            places.append(at[at < d.shape[1]])
    return [at[np.argsort(row[at], kind="stable")[:n]] for row, at in zip(d, places)]


def nearest(ids: np.ndarray, x: np.ndarray, sums: np.ndarray, norms: np.ndarray, queries: np.ndarray, most: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores), a row a query: of the most nearest sums the top nearest vectors, by exact distance and then ids; NaN where there are fewer."""
    found, scores = np.zeros((len(queries), top, 2), np.int64), np.full((len(queries), top), np.nan)
    away = -2 * sums.T
    for first in range(0, len(queries), TILE):
        tile = queries[first : first + TILE]
        d = tile @ away
        d += norms
        if not np.isfinite(d).all():
            d[np.isnan(d)] = np.inf
        for i, at in enumerate(smallest(d, most)):
            # A component a row, so that squares are added one after another, as a fold adds them.
            gap = np.sqrt(((np.ascontiguousarray(x[at].T) - tile[i][:, None]) ** 2).sum(0))
            best = np.lexsort((ids[at, 1], ids[at, 0], gap))[:top]
            found[first + i, : len(best)], scores[first + i, : len(best)] = ids[at[best]], gap[best]
    return found, scores


def shortlist(coded: DataFrame, queries: DataFrame, books: np.ndarray, keep: int, top: int, total: int) -> DataFrame:
    """(query_id, stands, rep, score): for each query vector at least the top nearest of the keep best by codes; score is exact.

    Vectors are dealt to blocks by hash, so a block with a share f of all has keep * f of the best on average, and
    six standard deviations more are reranked with them. A lane gives top rows a query, however many blocks it has.
    """
    spark = coded.sparkSession
    shared, dim, m = spark.sparkContext.broadcast(books), books.shape[2], books.shape[0]
    lanes = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), coded.select("block").count()))
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")
    # Numbers of partitions that are named are kept, so that lanes are tasks however few bytes they have.
    dealt = blocks(queries, dim).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).repartition(lanes, "lane")
    met = coded.withColumn("lane", lane).repartition(lanes, "lane").join(dealt.hint("merge"), "lane")

    def given(found):
        for qids, ids, scores in found.values():
            row, at = np.nonzero(~np.isnan(scores))
            for first in range(0, len(row), 65536):
                r, a = row[first : first + 65536], at[first : first + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(qids[r]), pa.array(ids[r, a, 0]), pa.array(ids[r, a, 1]), pa.array(scores[r, a])], names=["query_id", "stands", "rep", "score"])

    def run(batches):
        b, held, found = shared.value, None, {}
        with np.errstate(over="ignore", invalid="ignore"):
            for batch in batches:
                for i in range(batch.num_rows):
                    block, chunk = batch.column(0)[i].as_py(), batch.column(5)[i].as_py()
                    ids, x, codes, norms, qids, q = (batch.column(k)[i].as_buffer() for k in (1, 2, 3, 4, 6, 7))
                    if held is None or held[0] != block:
                        codes = np.frombuffer(codes, np.uint8).reshape(-1, m)
                        sums = np.zeros((len(codes), dim))
                        for k in range(m):
                            sums += b[k][codes[:, k]]
                        held = block, sums
                    ids, x, norms = np.frombuffer(ids, np.int64).reshape(-1, 2), np.frombuffer(x, np.float64).reshape(-1, dim), np.frombuffer(norms, np.float64)
                    mean = keep * len(ids) / max(1, total)
                    new = nearest(ids, x, held[1], norms, np.frombuffer(q, np.float64).reshape(-1, dim), min(keep, int(mean + 6 * mean**0.5 + 10)), top)
                    if chunk in found:
                        qids, *old = found[chunk]
                        names, scores = (np.concatenate(pair, 1) for pair in zip(old, new))
                        order = np.lexsort((names[..., 1], names[..., 0], scores))[:, :top]
                        new = np.take_along_axis(names, order[..., None], 1), np.take_along_axis(scores, order, 1)
                    else:
                        qids = np.frombuffer(qids, np.int64).copy()
                    found[chunk] = qids, *new
                    if sum(scores.size for *_, scores in found.values()) > HELD:
                        yield from given(found)
                        found = {}
        yield from given(found)

    return met.select("block", "ids", "vectors", "codes", "norms", "chunk", "query_ids", "queries").mapInArrow(lean(run), "query_id long, stands long, rep long, score double")


def search(table: DataFrame, queries: DataFrame, k: int = 10, keep: int = 500, sample: int = 8192) -> DataFrame:
    """The k nearest rows of table to each row of queries (both: vec_id, embedding): query_id, rank, vec_id, score."""
    out = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for (dim,) in usable(queries).select(F.size("vector")).distinct().collect():  # a model's dimensions, one as a rule
        out = out.unionByName(search_alike(usable(table, dim), usable(queries, dim), k, keep, sample))
    return out


def search_alike(table: DataFrame, queries: DataFrame, k: int, keep: int, sample: int) -> DataFrame:
    """search() over usable vectors (vec_id, vector) of one dimension."""
    # Ids that share a vector: the smallest stands for them in the index, under a number of the vector's own. Only k + 1 ids a vector leave a task.
    # A hash goes first, as vectors are compared one component after another.
    hashed = Window.partitionBy("hash", "vector").orderBy("vec_id")
    members = table.distinct().withColumn("hash", F.xxhash64("vector")).withColumn("nth", F.row_number().over(hashed)).where(F.col("nth") <= k + 1)
    members = members.withColumn("row", F.monotonically_increasing_id()).withColumn("rep", F.first("row").over(hashed))
    members = save(members.select("vec_id", "vector", "nth", "rep"), "members")
    wanted = save(queries.distinct().select(F.array("vec_id").alias("ids"), "vector"), "queries")
    distinct = members.where("nth = 1").select("vec_id", F.array("vec_id", "rep").alias("ids"), "vector")
    head = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").collect()
    if not head:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = train(np.array([r[0] for r in head]))
    # An id with several vectors can hold as many places of a query's nearest vectors, and one place in each of its lists.
    several = lambda t: t.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    top = min(keep, (k + 1) * several(members))
    found = save(shortlist(save(index(distinct.select("ids", "vector"), books), "codes"), wanted, books, keep, top, distinct.count()), "nearest-vectors")
    first = found.groupBy("query_id", "stands", "rep").agg(F.min("score").alias("score"))
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "stands", "rep"))).where(F.col("nth") <= top)
    ids = first.select("query_id", "rep", "score").join(members.select("rep", "vec_id"), "rep").where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return ids.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_additive_ann(spark, sf_dir):
    table = read(spark, sf_dir, "embeddings")
    return search(table, table.where("vec_id % 100 = 0"))
