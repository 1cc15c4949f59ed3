"""Cleaning and imputation of the three roles.

Global fill values (mode, median) come from grouped counts and are attached as
a one-row broadcast table: no ``collect``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .joins import grid_join

# Constant fills of the item and review tables.
ITEM_FILLS = {"director": "Unknown", "screenwriter": "Unknown",
              "synopsis": "No synopsis available"}
REVIEW_FILLS = {"review_text": "No review provided"}
UNKNOWN = "Unknown"


def fill_constants(df: DataFrame, fills: dict[str, str]) -> DataFrame:
    """Constant fill of the given columns."""
    return df.na.fill({c: v for c, v in fills.items() if c in df.columns})


def item_fill_values(items: DataFrame) -> DataFrame:
    """One row of global fill values: modes, median duration, median dates.

    The smallest value wins a tie for the mode; the median is exact (linear
    between the two middle values). Dates enter it as whole days since 1970.
    Both come from grouped counts, so no task gathers a column.
    """
    from . import profile as P
    days = items.select("duration", F.unix_date("start_dt").alias("start"), F.unix_date("end_dt").alias("end"))
    m = P.modes(items, ("aired_on", "org_net")).select("column_name", "value", F.lit(None).cast("double").alias("x"))
    q = P.exact_quantiles(days, ("duration", "start", "end"), (0.5,)).select("column_name", F.lit(None).cast("string").alias("value"), F.col("value").alias("x"))
    of = lambda name, col: F.max(F.when(F.col("column_name") == name, F.col(col)))
    return m.unionByName(q).agg(  # five rows
        of("aired_on", "value").alias("_mode_aired_on"), of("org_net", "value").alias("_mode_org_net"),
        of("duration", "x").alias("_med_duration"), of("start", "x").alias("_med_start"), of("end", "x").alias("_med_end"))


def clean_items(items: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """Clean the item catalog and add its derived columns.

    ``core``: the same rows without their text, if there is such a table; the
    fill values are then computed from it and the text is read once.

    Fills (C1-C4), then month, weekday (Mon=0), whole days between end and
    start (0 -> 1, null -> 0) and a duration category. Dates carry as
    fractional days so that a median falling between two days keeps its
    half day, as a timestamp median would.
    """
    fills = F.broadcast(item_fill_values(core if core is not None else items))
    df = fill_constants(items, ITEM_FILLS).crossJoin(fills)
    start_days = F.coalesce(F.unix_date("start_dt").cast("double"), F.col("_med_start"))
    end_days = F.coalesce(F.unix_date("end_dt").cast("double"), F.col("_med_end"))
    df = df.withColumns({
        "aired_on": F.coalesce("aired_on", "_mode_aired_on", F.lit(UNKNOWN)),
        "org_net": F.coalesce("org_net", "_mode_org_net", F.lit(UNKNOWN)),
        "duration": F.coalesce("duration", "_med_duration"),
        "_start_days": start_days,
        "_end_days": end_days,
    })
    start_date = F.date_from_unix_date(F.floor("_start_days").cast("int"))
    days = F.floor(F.col("_end_days") - F.col("_start_days")).cast("int")
    df = df.withColumns({
        "start_dt": S.days_to_timestamp("_start_days"),
        "end_dt": S.days_to_timestamp("_end_days"),
        "start_month": F.month(start_date),
        "start_day_of_week": F.weekday(start_date),
        "duration_days": F.coalesce(F.when(days == 0, F.lit(1)).otherwise(days), F.lit(0)),
        "duration_category": S.duration_category("duration"),
    })
    return df.drop("_mode_aired_on", "_mode_org_net", "_med_duration", "_med_start",
                   "_med_end", "_start_days", "_end_days")


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """Fill text, parse progress, normalise title, label the overall score."""
    df = fill_constants(reviews, REVIEW_FILLS)
    return df.withColumns({
        "episodes_watched": S.episodes_watched("ep_watched"),
        "total_episodes": S.total_episodes("ep_watched"),
        "title": S.norm_key("title"),
        "sentiment_label": S.score_label("overall_score"),
    })


def clean_credits(credits: DataFrame) -> DataFrame:
    """Title-case the role, normalise the item name."""
    return credits.withColumns({"role": S.title_case("role"),
                                "item_name": S.norm_key("item_name")})


def merge_credits_reviews(credits_clean: DataFrame, reviews_clean: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Inner equi join on the normalised name, many-to-many kept.

    Null names never match (SQL semantics). The fan-out is the result itself;
    a title heavy on either side, or on both, is dealt over a grid of tasks.
    ``keys``: a plainer table with the titles of the reviews, to find the heavy ones.
    Aggregates over this product should use :mod:`castwise.operators.credits`,
    which pre-aggregates per title instead of materialising it.
    """
    left = credits_clean.withColumn("title", F.col("item_name"))
    return grid_join(left, reviews_clean, ["title"], right_keys=keys).select(*credits_clean.columns, *reviews_clean.columns)


def name_lookup(items: DataFrame) -> DataFrame:
    """Normalised name -> item id, one row per name; highest id wins."""
    return (items.where(F.col("item_name").isNotNull())
            .groupBy(S.norm_key("item_name").alias("name_key"))
            .agg(F.max("item_id").alias("item_id")))


def replace_zero(c: str, by: int = 1):
    """0 -> ``by``; other values (negatives too) kept."""
    return F.when(F.col(c) == 0, F.lit(by)).otherwise(F.col(c))


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in ``subset`` (all columns when None)."""
    return df.na.drop(subset=subset)
