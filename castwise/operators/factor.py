"""Ratings, key encoding, split and matrix factorisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .joins import lookup_join


def split_ratings(reviews_clean: DataFrame, test_per_mille: int = 100, seed: int = 42) -> DataFrame:
    """Add ``part`` = 'test' / 'train' by an md5 bucket of the row.

    Disjoint and exhaustive, reproducible across partitionings and engines;
    identical rows land in the same part.
    """
    key = F.concat_ws("|", F.col("user_id").cast("string"), F.col("title"),
                      F.col("overall_score").cast("string"))
    b = S.md5_bucket(key, seed)
    return reviews_clean.withColumn("part", F.when(b < test_per_mille, "test").otherwise("train"))


# ------------------------------------------------------------ key encoding

def dense_index(df: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """M2: ``(col, out)`` with out = position of the value in sorted order.

    Distributed: a range-partitioned sort of the distinct values, then each
    row's index is its partition's offset (a running sum over one row per
    partition) plus its position within the partition. The tagged table is
    written once so both uses see the same partition layout.
    """
    from ..session import materialize
    keys = df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
    tagged = materialize(keys.select(col, F.spark_partition_id().alias("_p"),
                                     F.monotonically_increasing_id().alias("_m")), f"index-{col}")
    counts = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = counts.select("_p", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return tagged.join(F.broadcast(offs), "_p").select(
        col, (F.col("_off") + F.col("_m") - F.col("_m0")).cast("long").alias(out))


def summed_ratings(ratings: DataFrame) -> DataFrame:
    """Duplicate (user, title) ratings are summed, as a sparse matrix
    constructor does."""
    return ratings.groupBy("user_id", "title").agg(F.sum("overall_score").alias("score_sum"),
                                                    F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ factorisation

@dataclass
class Factors:
    """Result of :func:`fit_svd`; every table is keyed by the dense index."""
    users: DataFrame          # (user_id, u)
    titles: DataFrame         # (title, t)
    user_factors: DataFrame   # (u, uf array<double>)  = U * sigma
    item_factors: DataFrame   # (t, vf array<double>)  = V
    sigma: list[float]
    residual: float           # largest |X^T X v - sigma^2 v| / sigma_1^2 of the kept vectors
    n_users: int
    n_titles: int
    train: DataFrame          # (u, t, v) summed training entries
    test: DataFrame           # (user_id, title, overall_score, u, t)


@dataclass
class Ratings:
    """Encoded ratings: dense indices of users and titles, summed training entries, test rows."""
    users: DataFrame
    titles: DataFrame
    n_users: int
    n_titles: int
    train: DataFrame          # (u, t, v)
    test: DataFrame           # (user_id, title, overall_score, u, t)


def encode_ratings(reviews_clean: DataFrame, test_per_mille: int = 100, seed: int = 42) -> Ratings:
    """Drop nulls, index keys over all rows, split, sum duplicates of the training part."""
    from ..session import materialize

    r = (reviews_clean.select("user_id", S.norm_key("title").alias("title"), "overall_score")
         .na.drop())  # C5
    users = materialize(dense_index(r, "user_id", "u"), "users")
    titles = materialize(dense_index(r, "title", "t"), "titles")
    parts = materialize(split_ratings(r, test_per_mille, seed).join(users, "user_id").join(titles, "title"), "encoded-ratings")
    train = materialize(parts.where(F.col("part") == "train").groupBy("u", "t")
                        .agg(F.sum("overall_score").alias("v")), "train")
    test = parts.where(F.col("part") == "test").select("user_id", "title", "overall_score", "u", "t")
    return Ratings(users, titles, users.count(), titles.count(), train, test)


def fit_svd(reviews_clean: DataFrame, k: int = 50, test_per_mille: int = 100, seed: int = 42, tol: float = 1e-4) -> Factors:
    """M3: truncated SVD of the user x title training matrix.

    Encoders see all rows (train and test), as in the reference; the split
    is the md5 split of :func:`split_ratings`; duplicate (user, title)
    ratings are summed; unrated cells are 0 and nothing is centred.

    One path for every width (:mod:`castwise.operators.tallskinny`): both
    factors are tables from the first random block to the result, and the
    driver only holds matrices of the factors' width.
    """
    from ..session import materialize
    from .tallskinny import truncated_svd

    e = encode_ratings(reviews_clean, test_per_mille, seed)
    k_eff = max(1, min(k, e.n_titles - 1 if e.n_titles > 1 else 1))
    uf, vf, sigma, residual = truncated_svd(e.train, "u", "t", "v", e.n_users, e.n_titles, k_eff, tol=tol, seed=seed)
    uf = materialize(uf.select(F.col("id").alias("u"), F.col("vec").alias("uf")), "user_factors")
    # every encoded title has a factor row; one seen only in the test split
    # has an all-zero column in X and so a zero vector, as in a dense V
    vf = materialize(e.titles.select("t").join(vf.select(F.col("id").alias("t"), F.col("vec").alias("vf")), "t", "left")
                     .select("t", F.coalesce("vf", F.array_repeat(F.lit(0.0), len(sigma))).alias("vf")), "item_factors")
    return Factors(e.users, e.titles, uf, vf, sigma, residual, e.n_users, e.n_titles, e.train, e.test)


def _times_train(f: Factors, by: str, factors: DataFrame, vec: str, other: str) -> DataFrame:
    """(other, c, x): the training matrix (or its transpose) times a factor table, in SQL."""
    return (f.train.join(factors, by).select(other, F.posexplode(F.transform(vec, lambda x: x * F.col("v"))).alias("c", "x"))
            .groupBy(other, "c").agg(F.sum("x").alias("x")))


def factor_check(f: Factors) -> DataFrame:
    """(component, n_users, n_titles, normal, descending, residual_us, residual_v, off_diagonal) of the written factors.

    residual_us = |X v - U sigma| / sigma_1 and residual_v = |X^T X v -
    sigma^2 v| / sigma_1^2 over all rows; off_diagonal = the largest
    |v_i . v_j| over j != i; normal = |v|. Everything is computed from the
    training entries and the written tables by plain joins and sums, not by
    the code that made them. Rounded to 3 digits.
    """
    sig = F.element_at(F.lit([float(x) for x in f.sigma]), F.col("c") + 1)
    xv = _times_train(f, "t", f.item_factors, "vf", "u")
    us = f.user_factors.select("u", F.posexplode("uf").alias("c", "us"))
    diff = F.coalesce("x", F.lit(0.0)) - F.coalesce("us", F.lit(0.0))
    res_us = xv.join(us, ["u", "c"], "full_outer").groupBy("c").agg((F.sqrt(F.sum(diff * diff)) / f.sigma[0]).alias("residual_us"))
    xxv = _times_train(f, "u", xv.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("xs"))  # k numbers
                       .select("u", F.col("xs.x").alias("xs")), "xs", "t")
    vs = f.item_factors.select("t", F.posexplode("vf").alias("c", "v"))
    diff = F.coalesce("x", F.lit(0.0)) - sig * sig * F.coalesce("v", F.lit(0.0))
    res_v = xxv.join(vs, ["t", "c"], "full_outer").groupBy("c").agg((F.sqrt(F.sum(diff * diff)) / f.sigma[0] ** 2).alias("residual_v"))
    pairs = (f.item_factors.select(F.posexplode("vf").alias("c", "a"), "vf").select("c", "a", F.posexplode("vf").alias("d", "b"))
             .groupBy("c", "d").agg(F.sum(F.col("a") * F.col("b")).alias("dot")))
    gram = pairs.groupBy("c").agg(F.sqrt(F.max(F.when(F.col("c") == F.col("d"), F.col("dot")))).alias("normal"),
                                  F.max(F.when(F.col("c") != F.col("d"), F.abs("dot"))).alias("off_diagonal"))
    falls = F.col("c").isin([i for i in range(len(f.sigma)) if i == 0 or f.sigma[i - 1] >= f.sigma[i]])
    return gram.join(res_us, "c").join(res_v, "c").select(
        F.col("c").cast("int").alias("component"), F.lit(f.n_users).cast("long").alias("n_users"), F.lit(f.n_titles).cast("long").alias("n_titles"),
        F.round("normal", 3).alias("normal"), falls.alias("descending"), *(F.abs(F.round(c, 3)).alias(c) for c in ("residual_us", "residual_v")),
        F.abs(F.round(F.coalesce("off_diagonal", F.lit(0.0)), 3)).alias("off_diagonal"))


def predictions(f: Factors, rows: DataFrame | None = None) -> DataFrame:
    """J13 + F10: (user_id, title, actual, pred) with pred = clip(u . v, 1, 10).

    Left joins: a user or title without factors predicts 0 before clipping
    (the reference's validity filter never removes a row). Factor tables hold
    one row a key; a user or title heavy with ratings is spread.
    """
    rows = rows if rows is not None else f.test
    j = lookup_join(lookup_join(rows, f.user_factors, ["u"]), f.item_factors, ["t"])
    raw = F.when(F.col("uf").isNull() | F.col("vf").isNull(), F.lit(0.0)).otherwise(S.dot("uf", "vf"))
    return j.select("user_id", "title", F.col("overall_score").alias("actual"),
                    S.clip(raw, 1, 10).alias("pred"))


def error_report(pred: DataFrame) -> DataFrame:
    """One row (rmse, mae, n); no rows -> nulls."""
    d = F.col("actual") - F.col("pred")
    return pred.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
                    F.count(F.lit(1)).alias("n"))


def explained_variance(f: Factors) -> DataFrame:
    """Sum of var(U sigma columns) / sum of var(X columns), zeros included."""
    n = float(f.n_users)
    kk = len(f.sigma)
    comp = f.user_factors.select(F.posexplode("uf").alias("c", "x"))
    ev = (comp.groupBy("c").agg((F.sum(F.col("x") * F.col("x")) / n - F.pow(F.sum("x") / n, 2)).alias("ev"))
          .agg(F.sum("ev").alias("explained")))
    tv = (f.train.groupBy("t").agg((F.sum(F.col("v") * F.col("v")) / n - F.pow(F.sum("v") / n, 2)).alias("tv"))
          .agg(F.sum("tv").alias("total")))
    return ev.crossJoin(tv).select(F.lit(kk).alias("k"), "explained", "total",
                                   F.try_divide(F.col("explained"), F.col("total")).alias("explained_variance_ratio"))
