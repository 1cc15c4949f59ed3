"""Person statistics over credits x reviews.

The reference computes these over the materialised many-to-many join of
credits and reviews. That product grows with (credits per title) x (reviews
per title) and explodes on a hot title. Here each side is first reduced to
one row per join key -- reviews to per-title sums and counts, credits to
per-(person, title) multiplicities -- and only those rows are joined. The
results are identical: a mean over the product equals
sum(mult * score_sum) / sum(mult * score_count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def title_stats(reviews_clean: DataFrame) -> DataFrame:
    """One row per normalised title: score sum / count and user-id count."""
    return (reviews_clean.where(F.col("title").isNotNull())
            .groupBy("title")
            .agg(F.sum("overall_score").alias("score_sum"),
                 F.count("overall_score").alias("score_n"),
                 F.count("user_id").alias("user_n")))


def _credit_mult(credits_clean: DataFrame, keys: list[str]) -> DataFrame:
    return (credits_clean.where(F.col("item_name").isNotNull())
            .groupBy(*keys, "item_name").agg(F.count(F.lit(1)).alias("mult")))


def _joined(credits_clean: DataFrame, reviews_clean: DataFrame, keys: list[str]) -> DataFrame:
    m = _credit_mult(credits_clean, keys)
    t = title_stats(reviews_clean)
    return m.join(t, m.item_name == t.title, "inner")


def person_reputation(credits_clean: DataFrame, reviews_clean: DataFrame) -> DataFrame:
    """Per person, mean overall score over merged rows and distinct items."""
    j = _joined(credits_clean, reviews_clean, ["actor_name"])
    return (j.groupBy("actor_name")
            .agg(F.try_divide(F.sum(F.col("mult") * F.col("score_sum")),
                              F.sum(F.col("mult") * F.col("score_n"))).alias("actor_avg_score"),
                 F.count(F.lit(1)).alias("actor_appearances")))  # (person, item) is unique here


def person_score_ranking(credits_clean: DataFrame, reviews_clean: DataFrame,
                         top_n: int = 10) -> DataFrame:
    """A7 + T3: mean score and review count per person, best ``top_n``.

    Sorted by mean desc, review count desc, name; a null mean sorts last.
    """
    j = _joined(credits_clean, reviews_clean, ["actor_name"])
    agg = (j.groupBy("actor_name")
           .agg(F.try_divide(F.sum(F.col("mult") * F.col("score_sum")),
                             F.sum(F.col("mult") * F.col("score_n"))).alias("avg_score"),
                F.sum(F.col("mult") * F.col("user_n")).alias("review_count")))
    return (agg.orderBy(F.col("avg_score").desc_nulls_last(), F.col("review_count").desc(),
                        "actor_name").limit(top_n))


def person_role_impact(credits_clean: DataFrame, reviews_clean: DataFrame) -> DataFrame:
    """(person, role) mean score and true merged-row count."""
    j = _joined(credits_clean, reviews_clean, ["actor_name", "role"])
    return (j.groupBy("actor_name", "role")
            .agg(F.try_divide(F.sum(F.col("mult") * F.col("score_sum")),
                              F.sum(F.col("mult") * F.col("score_n"))).alias("avg_score"),
                 F.sum(F.col("mult") * F.col("user_n")).alias("review_count")))


def top_persons_by_items(credits_clean: DataFrame, top_n: int = 10) -> DataFrame:
    """T4: persons with the most distinct items; ties by name."""
    return (credits_clean.where(F.col("actor_name").isNotNull())
            .groupBy("actor_name").agg(F.count_distinct("item_name").alias("n_items"))
            .orderBy(F.col("n_items").desc(), "actor_name").limit(top_n))
