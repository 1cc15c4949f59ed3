"""Nearest neighbours for a stated query set.

The reference builds the full n x n similarity matrix and then reads one row
per query. Here only the asked rows are ranked, by the exact engine of
:mod:`castwise.operators.neighbors`, which deals the catalog to cells and
scores a pair only where a bound says that it could rank. Query set and
catalog are both distributed; no query and no candidate is left out, whatever
the sign of the scores.

Two vector layouts:
* long ``(id, feature, value)`` (sparse + dense feature store);
* dense ``(id, array<double>)`` (embeddings, latent factors).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neighbors as NB


def cosine_long(vectors: DataFrame, queries: DataFrame, names: DataFrame, top_n: int = 10,
                id_col: str = "item_id", name_col: str = "item_name") -> DataFrame:
    """Cosine top-n of each query id over a long vector table.

    ``vectors``: (id, feature, value); ``queries``: (qid); ``names``:
    (id, name) for every catalog id. Returns (qid, rank, id, name, score).
    A zero vector has similarity 0 to everything; the query itself is always
    excluded; ties order by name, then id; a query outside the catalog has no
    rows.
    """
    return nearest(*cosine_index(vectors, names, id_col, name_col), queries, top_n)


def cosine_index(vectors: DataFrame, names: DataFrame, id_col: str = "item_id", name_col: str = "item_name") -> tuple[NB.Vectors, NB.Index]:
    """The packed vectors of :func:`cosine_long` and their cells, both written: several query sets may ask them."""
    v = vectors.select(F.col(id_col).alias("id"), "feature", "value").where(F.col("value") != 0)
    packed = NB.pack_features(v, names.select(F.col(id_col).alias("id"), F.col(name_col).alias("name")))
    return packed, NB.Index(packed)


def nearest(vectors: NB.Vectors, index: NB.Index, queries: DataFrame, top_n: int = 10) -> DataFrame:
    """(qid, rank, id, name, score) of ``queries`` (qid) by a ready index."""
    return NB.nearest(vectors, queries, top_n, index=index)[0]


def dot_dense(vectors: DataFrame, queries: DataFrame, top_n: int = 10, id_col: str = "id",
              vec_col: str = "vec", cosine: bool = False) -> DataFrame:
    """Dot-product (or cosine) top-n over dense arrays; (qid, rank, id, score).

    Vectors of one table have one length; null vectors take no part. Self is
    excluded; ties order by id.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    return NB.nearest(NB.pack_dense(v, cosine), queries, top_n)[0].select("qid", "rank", "id", "score")


def sample_queries(items: DataFrame, n: int = 50, seed: int = 42, key: str = "item_id") -> DataFrame:
    """C17: ``min(n, rows)`` catalog rows in md5(seed|key) order (reproducible)."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return items.orderBy(h, key).limit(n)
