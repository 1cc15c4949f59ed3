"""Exact top-n neighbours of a large query set, scoring few of the pairs.

A vector has a common part (features that many items hold, as a short array)
and a rare part (feature ids with weights). With rho the length of the rare
part, (common, rho) is a short vector whose inner products bound the full ones
from above: c.c' + rho rho' >= x.x' (Cauchy-Schwarz on the rare part).

Items are dealt to cells: the nearest of a bounded number of pivot directions
and a band of lengths. A cell knows its largest angle to the pivot, so no item
in it can score more than |q| * band's top * cos(angle(q, pivot) - that angle)
with a query. Two joins follow, both on (query, cell) pairs:

1. every query visits its most promising cells, enough of them to hold top_n
   items besides itself; the n-th best score there is its floor;
2. it then visits only those other cells whose bound reaches the floor. Within
   a cell an item's own bound is compared first, and the rare parts, joined
   through an index of the cell's features, count only where it passes.

No pair that could rank is left out, whatever the signs. A cell heavy with
items, or wanted by many queries, is dealt over a grid of tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .joins import gridded

PIVOTS = 4096          # pivot directions at most (the square root of the items, if less)
COMMON_SHARE = 8       # a feature is common if one item in so many holds it
BANDS = 4              # bands of lengths an octave
SENT_FEATURES = 200_000  # rare features whose numbers are sent to the rows; more are joined
CELL_ROWS = 4096       # items of a cell, and queries that want it, that meet in one place
ASKED = 512            # queries scored against them at a time
BLOCK_VALUES = 1 << 20  # numbers of a matrix, of the rows sent on, or of matching rare features, made at a time
SLACK = 1e-8           # rounding margin of the bounds
DIGITS = 9             # scores are ranked by this many digits


@dataclass
class Vectors:
    """Packed vectors, written: (id, name, vec, rare, weight); ``vec`` is (common..., rho)."""
    table: DataFrame
    width: int


def pack_features(features: DataFrame, names: DataFrame, unit: bool = True) -> Vectors:
    """Vectors of every row of ``names`` (id, name) from (id, feature, value); scaled to length 1 if ``unit``.

    Items without features have the zero vector; a feature of one id comes once.
    The number of common features is at most ``COMMON_SHARE`` times the mean
    number of features an item holds.
    """
    from .factor import dense_index

    n = names.agg(F.countDistinct("id")).first()[0]
    per = materialize(features.groupBy("feature").agg(F.count(F.lit(1)).alias("n")), "feature-counts")
    common = sorted(r.feature for r in per.where(F.col("n") * COMMON_SHARE >= n).select("feature").collect())  # bounded, see above
    rare = per.where(F.col("n") * COMMON_SHARE < n)
    ids = dense_index(rare, "feature", "fid").select("feature", F.lit(None).cast("long").alias("at"), "fid")
    marks = features.sparkSession.createDataFrame([(f, i + 1, None) for i, f in enumerate(common)], "feature string, at long, fid long").unionByName(ids)
    if rare.count() <= SENT_FEATURES:  # else a feature that most items hold would be one key of a join
        marks = F.broadcast(marks)
    # an item's features meet once, as numbers; its length is summed on the way
    w = features.select("id", "feature", F.col("value").cast("double").alias("value")).join(marks, "feature", "left")
    packed = w.groupBy("id").agg(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "value"))).alias("c"),
                                 F.sort_array(F.collect_list(F.when(F.col("fid").isNotNull(), F.struct("fid", "value")))).alias("r"),  # one item's features
                                 F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    if unit:
        scaled = lambda of, k: F.transform(of, lambda x: F.struct(x[k].alias(k), F.when(F.col("norm") > 0, x["value"] / F.col("norm")).otherwise(0.0).alias("value")))
        packed = packed.select("id", scaled("c", "at").alias("c"), scaled("r", "fid").alias("r"))
    places = F.array(*(F.lit(i + 1).cast("long") for i in range(len(common)))).cast("array<bigint>")
    held = F.map_from_entries("c")
    vec = F.transform(places, lambda i: F.coalesce(F.element_at(held, i), F.lit(0.0)))
    rho = F.sqrt(F.aggregate("r", F.lit(0.0), lambda s, x: s + x["value"] * x["value"]))
    packed = packed.select("id", F.concat(vec, F.array(rho)).alias("vec"), F.col("r.fid").alias("rare"), F.col("r.value").alias("weight"))
    zero = F.array_repeat(F.lit(0.0), len(common) + 1)
    table = names.select("id", "name").join(packed, "id", "left").select(
        "id", "name", F.coalesce("vec", zero).alias("vec"), F.coalesce("rare", F.array().cast("array<bigint>")).alias("rare"),
        F.coalesce("weight", F.array().cast("array<double>")).alias("weight"))
    return Vectors(materialize(table, "packed-vectors"), len(common) + 1)


def pack_dense(rows: DataFrame, unit: bool) -> Vectors:
    """Vectors from (id, vec) of one length; null vectors take no part, names are null."""
    v = rows.select("id", F.col("vec").cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
    if unit:
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
        v = v.withColumn("norm", norm).select("id", F.transform("vec", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0)).alias("vec"))
    none = [F.array().cast(f"array<{t}>") for t in ("bigint", "double")]
    table = materialize(v.select("id", F.lit(None).cast("string").alias("name"), F.concat("vec", F.array(F.lit(0.0))).alias("vec"),
                                 none[0].alias("rare"), none[1].alias("weight")), "packed-vectors")
    first = table.select(F.size("vec").alias("n")).first()
    return Vectors(table, first.n if first else 1)


def _matrix(column, width: int) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _cosines(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, cosines of the angles to every pivot); a zero vector is at a right angle."""
    length = np.sqrt((m * m).sum(axis=1))
    return length, np.clip((m / np.where(length > 0, length, 1)[:, None]) @ pivots.T, -1, 1)


def _angles(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length, cosine = _cosines(m, pivots)
    return length, np.arccos(cosine)


class Index:
    """Items in cells: ``table`` (cell, id, name, vec, rare, weight) and ``cells`` (cell, pivot, n, top, reach)."""

    def __init__(self, vectors: Vectors, pivots: int | None = None):
        v, width = vectors.table, vectors.width
        some = pivots or min(PIVOTS, max(1, int(v.count() ** 0.5)))
        chosen = v.where(F.exists("vec", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(some).select("vec").collect()  # PIVOTS rows
        m = np.array([r.vec for r in chosen], float).reshape(-1, width)
        self.width, self.pivots = width, m / np.sqrt((m * m).sum(axis=1, keepdims=True)) if len(m) else m
        shared, columns = v.sparkSession.sparkContext.broadcast(self.pivots), v.columns

        def place(batches):
            for b in batches:
                p, x = shared.value, _matrix(b.column("vec"), width)
                length, near, reach = np.zeros(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
                step = max(1, BLOCK_VALUES // max(1, len(p)))
                for s in range(0, len(x) if len(p) else 0, step):
                    length[s:s + step], cosine = _cosines(x[s:s + step], p)
                    near[s:s + step] = cosine.argmax(axis=1)
                    reach[s:s + step] = np.arccos(cosine.max(axis=1))
                band = np.floor(np.log2(np.where(length > 0, length, 1)) * BANDS).astype(np.int64)
                cell = np.where(length > 0, near * (1 << 20) + band + (1 << 19), -1)  # zero vectors: a cell of their own
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.where(length > 0, near, -1)), pa.array(length), pa.array(reach),
                                                  *(b.column(c) for c in columns)], names=["cell", "pivot", "length", "reach", *columns])

        schema = T.StructType([*T.StructType.fromDDL("cell long, pivot long, length double, reach double").fields, *v.schema.fields])
        self.table = materialize(v.mapInArrow(place, schema), "neighbour-cells")
        self.cells = (self.table.groupBy("cell", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("top"), F.max("reach").alias("reach"))
                      .orderBy("cell").toArrow())  # pivots x bands of lengths

    def wanted(self, queries: DataFrame, top_n: int) -> DataFrame:
        """(cell, second, the query's columns): the cells that a query visits first (floor null) or besides (floor given)."""
        width = self.width
        shared = queries.sparkSession.sparkContext.broadcast((self.pivots, *(self.cells[c].to_numpy() for c in ("cell", "pivot", "n", "top", "reach"))))

        def run(batches):
            pivots, cell, pivot, n, top, reach = shared.value
            step = min(ASKED, max(1, BLOCK_VALUES // max(1, len(cell))))
            for b in batches:
                for s in range(0, b.num_rows, step):
                    sub = b.slice(s, step)
                    x = _matrix(sub.column("vec"), width)
                    if len(pivots):
                        length, angle = _angles(x, pivots)
                        gap = np.maximum(angle[:, np.maximum(pivot, 0)] - reach, 0)
                        bound = length[:, None] * np.where(pivot >= 0, top * np.maximum(np.cos(gap), 0), 0)
                    else:
                        bound = np.zeros((len(x), len(cell)))
                    order = np.argsort(-bound, axis=1, kind="stable")
                    filled = np.cumsum(n[order], axis=1)
                    first = np.zeros(bound.shape, bool)  # until the cells before hold top_n items and the query itself
                    np.put_along_axis(first, order, filled - n[order] < top_n + 1, axis=1)
                    floor = sub.column("floor").to_numpy(zero_copy_only=False)
                    visit = np.where(np.isnan(floor)[:, None], first, ~first & (bound >= floor[:, None] - SLACK))
                    at, to = np.nonzero(visit)
                    # a query's vector goes to every cell it visits: some of those rows at a time
                    most = max(1, 8 * BLOCK_VALUES * sub.num_rows // max(1, sub.nbytes))
                    for k in range(0, len(at), most):
                        rows = sub.take(pa.array(at[k:k + most]))
                        yield pa.RecordBatch.from_arrays([pa.array(cell[to[k:k + most]]), *rows.columns], names=["cell", *rows.schema.names])

        return queries.mapInArrow(run, T.StructType([T.StructField("cell", T.LongType()), *queries.schema.fields]))


def _rare_products(q_lists: list, q_weights: list, i_lists: list, i_weights: list) -> np.ndarray:
    """Inner products of rare parts (queries x items) through the items' inverted index."""
    out = np.zeros((len(q_lists), len(i_lists)))
    qn, xn = [len(x) for x in q_lists], [len(x) for x in i_lists]
    if not sum(qn) or not sum(xn):
        return out
    feature, holder, weight = np.concatenate(i_lists), np.repeat(np.arange(len(xn)), xn), np.concatenate(i_weights)
    order = np.argsort(feature, kind="stable")
    feature, holder, weight = feature[order], holder[order], weight[order]
    asked, asker, w = np.concatenate(q_lists), np.repeat(np.arange(len(qn)), qn), np.concatenate(q_weights)
    lo, hi = np.searchsorted(feature, asked, "left"), np.searchsorted(feature, asked, "right")
    # matches are expanded some at a time: many askers may want a feature that many items hold
    block = np.cumsum(hi - lo) // BLOCK_VALUES
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    for s, e in zip(cuts, [*cuts[1:], len(asked)], strict=True):
        n = hi[s:e] - lo[s:e]
        at = np.repeat(lo[s:e] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        np.add.at(out, (np.repeat(asker[s:e], n), holder[at]), np.repeat(w[s:e], n) * weight[at])
    return out


def _visit(index: Index, wanted: DataFrame, top_n: int, id_type: T.DataType) -> DataFrame:
    """(qid, id, name, score, scored): the best items of every visited cell, and the pairs scored in full there (id null)."""
    items, queries = gridded(index.table.select("cell", "id", "name", "vec", "rare", "weight"), wanted, ["cell"], CELL_ROWS)
    width, key = index.width, ["cell", "_row", "_col"]
    schema = T.StructType([T.StructField("qid", id_type), T.StructField("id", id_type), *T.StructType.fromDDL("name string, score double, scored long").fields])

    def lists(table: pa.Table, name: str) -> list:
        return [np.asarray(x.values) for x in table[name].combine_chunks()]

    def block(x: pa.Table, q: pa.Table, rows: list[tuple]) -> None:
        names, ids = x["name"].to_pylist(), x["id"].to_pylist()
        a, b = _matrix(q["vec"], width), _matrix(x["vec"], width)
        short = a[:, :-1] @ b[:, :-1].T
        floor = np.nan_to_num(q["floor"].to_numpy(), nan=-np.inf)
        passing = short + np.outer(a[:, -1], b[:, -1]) >= floor[:, None] - SLACK
        scores = short + _rare_products(lists(q, "rare"), lists(q, "weight"), lists(x, "rare"), lists(x, "weight")) if passing.any() and a[:, -1].any() else short
        for k, qid in enumerate(q["qid"].to_pylist()):
            at = np.flatnonzero(passing[k])
            rounded = np.round(scores[k, at], DIGITS)
            n = min(len(at), top_n + 1)  # one more: the query itself may be among them
            if n:
                best = at[rounded >= np.partition(rounded, len(at) - n)[len(at) - n]]
                ranked = nsmallest(top_n, ((-round(float(scores[k, i]), DIGITS), names[i] is None, names[i] or "", ids[i], float(scores[k, i]))
                                           for i in best if ids[i] != qid))
                rows += [(qid, r[3], None if r[1] else r[2], r[4], 0) for r in ranked]
            rows.append((qid, None, None, None, len(at)))

    def meet(x, q):
        rows: list[tuple] = []
        for i in range(0, len(x), CELL_ROWS):
            for k in range(0, len(q), ASKED):
                block(x.slice(i, CELL_ROWS).combine_chunks(), q.slice(k, ASKED).combine_chunks(), rows)
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return items.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(meet, schema)


def _best(found: DataFrame, top_n: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.round("score", DIGITS).desc(), F.col("name").asc_nulls_last(), F.col("id"))
    return found.where(F.col("id").isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def nearest(vectors: Vectors, queries: DataFrame, top_n: int = 10, pivots: int | None = None, index: Index | None = None) -> tuple[DataFrame, DataFrame]:
    """((qid, rank, id, name, score), (qid, scored)): the top_n largest inner products of each query id with all others.

    ``queries`` has ``qid``; ids that no vector has give no rows (and keep the
    types). The query itself is left out; ties in the score's nine digits order
    by name, then id. ``scored`` counts the items whose bound reached the
    query's floor; the others were never ranked. ``index``: the cells of these
    vectors if they have been made.
    """
    index = index or Index(vectors, pivots)
    v = vectors.table
    id_type = v.schema["id"].dataType
    q = queries.select(F.col("qid").cast(id_type)).distinct().join(v.dropDuplicates(["id"]), F.col("qid") == F.col("id"))
    every = materialize(q.select("qid", "vec", "rare", "weight", F.lit(None).cast("double").alias("floor")), "neighbour-queries")
    is_zero = ~F.exists("vec", lambda x: x != 0)
    asked = every.where(~is_zero)
    first = materialize(_visit(index, index.wanted(asked, top_n), top_n, id_type), "neighbours-first")
    floors = _best(first, top_n).where(F.col("rank") == top_n).select("qid", F.round("score", DIGITS).alias("floor"))
    again = asked.drop("floor").join(floors, "qid")  # without a floor all items have been visited
    rest = materialize(_visit(index, index.wanted(materialize(again, "neighbour-floors"), top_n), top_n, id_type), "neighbours-rest")
    # every item scores 0 with a zero vector: the same few lead for all of them
    lead = v.select("id", "name").orderBy(F.col("name").asc_nulls_last(), "id").limit(top_n + 1).withColumn("at", F.lit(0))
    zero = every.where(is_zero).select("qid").withColumn("at", F.lit(0)).join(F.broadcast(lead), "at")
    zero = zero.where(F.col("qid") != F.col("id")).select("qid", "id", "name", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("scored"))
    both = first.unionByName(rest).unionByName(zero)
    return (_best(both, top_n).select("qid", "rank", "id", "name", "score"),
            both.where(F.col("id").isNull()).groupBy("qid").agg(F.sum("scored").alias("scored")))
