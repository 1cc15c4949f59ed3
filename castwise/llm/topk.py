"""Exact top-k inner products by columnar branch and bound.

Candidates are held in vertical layout (one row of numbers per dimension).
Scores accumulate block by block of ``BLOCK_DIMS`` dimensions; after each
block a candidate's score can grow by at most |rest of query| * |rest of
candidate| (Cauchy-Schwarz over the remaining dimensions, its remaining
mass). Candidates whose bound is below the query's k-th best score so far are
dropped and the survivors' columns compacted before the next block.

The queries are a stated set, so they are taken in blocks of at most
``QUERY_BLOCK`` vectors: each block is broadcast, every partition scans its
candidates against it and returns k rows a query at most, and the partial
lists are merged by a top-k window. No candidate is left out, so results are
exact.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BLOCK_DIMS = 16
QUERY_BLOCK = 4096
QUERY_VALUES = 1 << 20   # numbers in a block of queries at most
CANDIDATES = 4096        # columns scanned at a time
SCALE = 256
ROUNDING = 2.0 ** -50    # of a sum's largest value, for each of its terms


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, x as double.

    Rows whose id or vector is null, or whose vector is empty or holds null or
    non-finite components, take no part.
    """
    x = F.col("x")
    # an aggregate that is null unless every component is a finite number
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
            .where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & finite)
            .select("vec_id", F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v")))


def _norms(m: np.ndarray) -> np.ndarray:
    """Euclidean norms of what remains from each block of dimensions on ((blocks + 1) x columns)."""
    sq = m * m
    cuts = range(0, len(m), BLOCK_DIMS)
    tail = [np.zeros(m.shape[1])]
    for s in reversed(cuts):
        tail.append(tail[-1] + sq[s:s + BLOCK_DIMS].sum(axis=0))
    return np.sqrt(np.array(tail[::-1]))


class Best:
    """The k best (whole score, id) of every query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64) for _ in range(n)]
        self.ids = [np.zeros(0, np.int64) for _ in range(n)]

    def floor(self, q: int) -> float:
        """The score that a newcomer must reach."""
        return float(self.scores[q][-1]) if len(self.scores[q]) == self.k else -np.inf

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        if len(s) > 4 * self.k:  # a cheap cut that keeps all ties
            keep = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, i = s[keep], i[keep]
        order = np.lexsort((i, ~s))[:self.k]
        self.scores[q], self.ids[q] = s[order], i[order]


def whole_scores(query: np.ndarray, columns: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products of one query with columns; ``bound`` is the largest they can be.

    Sums that may leave 64 bits are taken in Python integers; one that does is an OverflowError.
    """
    if bound < 1 << 62:
        return query @ columns  # sums modulo 2^64, and the result fits
    return np.array(query.astype(object) @ columns.astype(object), np.int64)


def scan(best: Best, queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray) -> None:
    """Branch and bound of all queries (n x dims) over candidates in vertical layout (dims x m), all whole numbers.

    Bounds are kept in floating point with a margin for its rounding; where
    inner products may pass 2^53 the survivors' scores are taken anew in integers.
    """
    real_q, real_c = queries.astype(float), columns.astype(float)
    q_rest, c_rest = _norms(real_q.T), _norms(real_c)
    cuts = list(range(0, len(columns), BLOCK_DIMS))
    first = real_q[:, :BLOCK_DIMS] @ real_c[:BLOCK_DIMS]  # the first block for all queries at once
    order = np.argsort(ids, kind="stable")
    for q in range(len(queries)):
        floor, score = best.floor(q), first[q]
        bound = float(q_rest[0, q] * c_rest[0].max(initial=0.0))  # no inner product is larger
        margin = 1 + bound * len(columns) * ROUNDING
        alive = None
        for b, s in enumerate(cuts):
            if b:
                part = real_c[s:s + BLOCK_DIMS]
                score = score + real_q[q, s:s + BLOCK_DIMS] @ (part if alive is None else part[:, alive])
            if floor > -np.inf:
                rest = c_rest[b + 1] if alive is None else c_rest[b + 1][alive]
                keep = score + q_rest[b + 1, q] * rest + margin >= floor
                if not keep.all():
                    alive = np.flatnonzero(keep) if alive is None else alive[keep]
                    score = score[keep]
                    if not len(alive):
                        break
        found = ids if alive is None else ids[alive]
        if bound < 1 << 52:
            score = score.astype(np.int64)
        elif len(found):
            score = whole_scores(queries[q], columns if alive is None else columns[:, alive], bound)
        own = np.searchsorted(ids, query_ids[q], sorter=order)
        if own < len(ids) and ids[order[own]] == query_ids[q]:
            other = found != query_ids[q]
            found, score = found[other], score[other]
        if len(found):
            best.add(q, score, found)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest integer inner products.

    Both frames as from ``quantised``. A candidate with the query's id is the
    query's own row and left out; ties go to the smaller id, and an id that
    comes several times as a candidate is ranked as often. Queries that repeat
    an id count once (the smallest vector). Vectors of another length than the
    query are no candidates. Fewer candidates give fewer rows, none give none.
    Scores are exact up to 64 bits; one beyond is an OverflowError.
    """
    spark = vectors.sparkSession
    stated = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v")), "topk-queries")
    parts = []
    for size in [r.dims for r in stated.select("dims").distinct().orderBy("dims").collect()]:
        mine, per = stated.where(F.col("dims") == size), max(1, min(QUERY_BLOCK, QUERY_VALUES // size))
        blocks = -(-mine.count() // per)
        for b in range(blocks):
            rows = mine.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()  # a bounded block
            if rows:
                shared = spark.sparkContext.broadcast((np.array([r.vec_id for r in rows], np.int64), np.array([r.v for r in rows], np.int64)))
                parts.append(materialize(_scan_all(vectors.where(F.size("v") == size), shared, k, size), "topk-block"))
                shared.unpersist()  # one block of queries is out at a time
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = reduce(DataFrame.union, parts)
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scan_all(vectors: DataFrame, shared, k: int, size: int) -> DataFrame:
    def run(batches):
        query_ids, queries = shared.value
        best = Best(len(queries), k)
        for batch in batches:
            for s in range(0, batch.num_rows, CANDIDATES):
                sub = batch.slice(s, CANDIDATES)
                columns = np.ascontiguousarray(sub.column("v").flatten().to_numpy().reshape(-1, size).T)
                scan(best, queries, query_ids, columns, sub.column("vec_id").to_numpy())
        n = [len(s) for s in best.scores]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, n)), pa.array(np.concatenate(best.ids) if n else [], pa.int64()),
                                          pa.array(np.concatenate(best.scores) if n else [], pa.int64())], names=["query_id", "vec_id", "score"])

    return vectors.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
