"""Per-item feature blocks and the feature store (A6, A9, A10, A18, X-T7, M1).

Blocks are keyed by ``item_id``. Dense blocks are wide rows; sparse blocks
(one-hot levels, TF-IDF terms) are long ``(item_id, feature, value)`` rows so
that the number of dynamic columns never enters the schema.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import clean as C
from . import credits as K
from .joins import salted_join

# Numeric item columns that are min-max scaled, and the
# categorical columns that are one-hot encoded.
NUMERIC_COLS = ("year", "tot_eps", "duration", "rank", "pop", "start_month",
                "start_day_of_week", "duration_days")
CATEGORICAL_COLS = ("org_net", "content_rt", "aired_on")
# Names of the review and cast feature columns.
REVIEW_AGG_COLS = ("avg_overall", "avg_story", "avg_acting", "avg_music", "avg_rewatch",
                   "review_count", "pct_positive", "pct_neutral", "pct_negative")
CAST_COLS = ("cast_avg_score", "cast_size", "main_role_count", "support_role_count")
# The two counted roles, after title-casing.
MAIN_ROLE, SUPPORT_ROLE = "Main Role", "Support Role"


def scaled_numerics(items_clean: DataFrame, cols=NUMERIC_COLS) -> DataFrame:
    """Fill 0, then (x - min) / (max - min); a constant column gives 0.

    One global min/max aggregate, attached as a one-row broadcast.
    """
    cols = [c for c in cols if c in items_clean.columns]  # C13
    filled = items_clean.select("item_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                             for c in cols])
    bounds = filled.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols],
                        *[F.max(c).alias(f"_hi_{c}") for c in cols])
    df = filled.crossJoin(F.broadcast(bounds))
    out = []
    for c in cols:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out.append(F.when(hi == lo, F.lit(0.0)).otherwise((F.col(c) - lo) / (hi - lo)).alias(c))
    return df.select("item_id", *out)


def one_hot_long(items_clean: DataFrame, cols=CATEGORICAL_COLS) -> DataFrame:
    """X-T7: one row ``(item_id, '<col>_<level>', 1.0)`` per non-null level.

    Long form: no level is dropped, a null level gives no row (all zeros),
    and the level count never limits the plan (no pivot). One scan: an item's
    levels are exploded from one array.
    """
    levels = F.array(*[F.concat(F.lit(f"{c}_"), F.col(c)) for c in cols if c in items_clean.columns])
    return (items_clean.select("item_id", F.explode(levels).alias("feature")).where(F.col("feature").isNotNull())
            .select("item_id", "feature", F.lit(1.0).alias("value")))


def review_aggregates(reviews_clean: DataFrame, items: DataFrame) -> DataFrame:
    """Per-title review statistics mapped to item ids.

    Means skip nulls; ``review_count`` counts non-null user ids; shares are
    means of label indicators. Titles without a catalog name are dropped.
    """
    agg = (reviews_clean.where(F.col("title").isNotNull())
           .groupBy(S.norm_key("title").alias("name_key"))
           .agg(F.avg("overall_score").alias("avg_overall"),
                F.avg("story_score").alias("avg_story"),
                F.avg("acting_cast_score").alias("avg_acting"),
                F.avg("music_score").alias("avg_music"),
                F.avg("rewatch_value_score").alias("avg_rewatch"),
                F.count("user_id").alias("review_count"),
                *[F.avg((F.col("sentiment_label") == k).cast("double")).alias(n)
                  for k, n in ((2, "pct_positive"), (1, "pct_neutral"), (0, "pct_negative"))]))
    return agg.join(C.name_lookup(items), "name_key").drop("name_key")


def cast_features(credits_clean: DataFrame, reviews_clean: DataFrame, items: DataFrame) -> DataFrame:
    """A10: per-item cast statistics from person reputation.

    ``cast_avg_score`` is the mean of the members' reputation over credit
    rows (nulls skipped), ``cast_size`` the distinct person count, role
    counts count credit rows with the exact title-cased role.
    """
    rep = K.person_reputation(credits_clean, reviews_clean)
    # one reputation row per person, replicated per salt: a person credited
    # on a third of all items is spread over the salt buckets
    per_item = (salted_join(credits_clean, rep, ["actor_name"], "item_name", how="left")
                .groupBy(F.col("item_name").alias("name_key"))
                .agg(F.avg("actor_avg_score").alias("cast_avg_score"),
                     F.count_distinct("actor_name").alias("cast_size"),
                     F.count_if(F.col("role") == MAIN_ROLE).alias("main_role_count"),
                     F.count_if(F.col("role") == SUPPORT_ROLE).alias("support_role_count")))
    return per_item.join(C.name_lookup(items), "name_key").drop("name_key")


def dense_features(items_clean: DataFrame, reviews_clean: DataFrame, credits_clean: DataFrame,
                   items: DataFrame | None = None) -> DataFrame:
    """Wide dense part of the feature store: numerics + review + cast blocks.

    Left joins on ``item_id`` from the scaled numerics (one row per catalog
    row); missing aggregates become 0 (C6).
    """
    items = items if items is not None else items_clean
    num = scaled_numerics(items_clean)
    rev = review_aggregates(reviews_clean, items)
    cast = cast_features(credits_clean, reviews_clean, items)
    df = num.join(rev, "item_id", "left").join(cast, "item_id", "left")
    return df.na.fill(0, subset=list(REVIEW_AGG_COLS + CAST_COLS))


def to_long(wide: DataFrame, key: str = "item_id") -> DataFrame:
    """Unpivot wide numeric columns into ``(key, feature, value)``."""
    cols = [c for c in wide.columns if c != key]
    return wide.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        key, cols, "feature", "value")


def feature_store_long(items_clean: DataFrame, reviews_clean: DataFrame,
                       credits_clean: DataFrame, tfidf: DataFrame,
                       items: DataFrame | None = None) -> DataFrame:
    """M1 in long form: every non-zero feature of every catalog row.

    ``tfidf`` is the long ``(item_id, term, weight)`` table of
    :func:`castwise.operators.tfidf.tfidf_weights`; terms are prefixed
    ``tfidf_`` as the wide store would name them.
    """
    dense = to_long(dense_features(items_clean, reviews_clean, credits_clean, items))
    parts = [dense,
             one_hot_long(items_clean),
             tfidf.select("item_id", F.concat(F.lit("tfidf_"), "term").alias("feature"),
                          F.col("weight").alias("value"))]
    return reduce(DataFrame.unionByName, parts).where(F.col("value") != 0)
