"""Row rules and dataset verdicts (Q1-Q9).

Each rule is a boolean column that is true when the row *violates* it. A row
fails once however many rules it breaks. The verdict is one aggregate pass;
the sample of failing rows is a bounded top-k by key (no driver loop).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required columns and rules per dataset.
#   items:   strings and ints must be present; 2000 <= year <= 2030;
#            tot_eps, duration, rank, pop must not be negative (null passes).
#   reviews: strings and ints present; every score in [1, 10] (null fails).
#   credits: every listed column present.
ITEM_COLUMNS = ("item_id", "item_name", "year", "country", "type", "tot_eps", "duration", "rank", "pop")
ITEM_STR = ("item_name", "country", "type")
ITEM_NONNEG = ("tot_eps", "duration", "rank", "pop")
REVIEW_STR = ("user_id", "title")
REVIEW_SCORES = ("story_score", "acting_cast_score", "music_score", "rewatch_value_score",
                 "overall_score")
CREDIT_STR = ("actor_id", "actor_name", "item_name", "character_name", "role")
YEAR_RANGE = (2000, 2030)
SCORE_RANGE = (1.0, 10.0)

REQUIRED = {
    "items": ITEM_COLUMNS,
    "reviews": REVIEW_STR + REVIEW_SCORES + ("n_helpful",),
    "credits": CREDIT_STR,
}
KEYS = {"items": ("item_id",), "reviews": ("user_id", "title"),
        "credits": ("actor_id", "item_name", "character_name")}


def required_columns(df: DataFrame, dataset: str) -> DataFrame:
    """Q1: project the checked columns; a missing one is an error."""
    cols = REQUIRED[dataset]
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{dataset}: missing required columns {missing}")
    return df.select(*cols)


def _number(c: str) -> Column:
    """The value as a number; null if it is none (raw tables may hold text)."""
    return F.col(c).try_cast("double")


def _is_int(c: str) -> Column:
    # integers and integral floats (2020.0) pass; fractions, text and null do not
    return F.coalesce(F.floor(_number(c)) == _number(c), F.lit(False))


def _not_number(c: str) -> Column:
    return F.col(c).isNotNull() & _number(c).isNull()


def rules(dataset: str, types: dict[str, str] | None = None) -> list[tuple[str, Column]]:
    """(rule name, violation condition) pairs for one dataset (Q3-Q6).

    ``types``: column types of the table; a string column held as anything
    else breaks its type rule in every row with a value.
    """
    out: list[tuple[str, Column]] = []
    strings = {"items": ITEM_STR, "reviews": REVIEW_STR, "credits": CREDIT_STR[1:]}.get(dataset, ())
    for c in strings:
        if types and types.get(c, "string") != "string":
            out.append((f"{c}_type", F.col(c).isNotNull()))
    if dataset == "items":
        out += [(f"{c}_missing", F.col(c).isNull()) for c in ("item_name", "country", "type")]
        y = _number("year")
        out.append(("year_type", ~_is_int("year")))
        out.append(("year_range", F.coalesce(~y.between(*YEAR_RANGE), F.lit(False))))
        out += [(f"{c}_negative", F.coalesce(_number(c) < 0, F.lit(False))) for c in ITEM_NONNEG]
        out += [(f"{c}_type", _not_number(c)) for c in ITEM_NONNEG]
    elif dataset == "reviews":
        out += [(f"{c}_missing", F.col(c).isNull()) for c in REVIEW_STR]
        out += [(f"{c}_range", ~F.coalesce(_number(c).between(*SCORE_RANGE) & ~F.isnan(_number(c)),
                                            F.lit(False))) for c in REVIEW_SCORES]
        out.append(("n_helpful_type", ~_is_int("n_helpful")))
    elif dataset == "credits":
        out += [(f"{c}_missing", F.col(c).isNull()) for c in CREDIT_STR]
    else:
        raise ValueError(f"unknown dataset {dataset!r}")
    return out


def with_violations(df: DataFrame, dataset: str) -> DataFrame:
    """Q2 + Q3-Q7: checked rows with an array of broken rule names."""
    df = required_columns(df, dataset)
    if dataset == "items":
        df = df.where(F.col("item_id").isNotNull())  # Q2
    arr = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules(dataset, dict(df.dtypes))])
    return df.withColumn("violations", F.filter(arr, lambda x: x.isNotNull()))


def verdict(df: DataFrame, dataset: str) -> DataFrame:
    """Q8: one row ``(dataset, n_rows, n_bad, passed)``."""
    v = with_violations(df, dataset)
    bad = F.size("violations") > 0
    return v.agg(F.lit(dataset).alias("dataset"),
                 F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(bad).alias("n_bad"),
                 (F.count_if(bad) == 0).alias("passed"))


def report(datasets: dict[str, DataFrame]) -> DataFrame:
    """Q9: verdicts of all datasets, advisory (never raises on failure)."""
    return reduce(DataFrame.unionByName, [verdict(df, name) for name, df in datasets.items()])


def violation_counts(df: DataFrame, dataset: str) -> DataFrame:
    """Rows broken per rule: ``(dataset, rule, n_rows)``."""
    v = with_violations(df, dataset)
    return (v.select(F.explode("violations").alias("rule"))
            .groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows"))
            .select(F.lit(dataset).alias("dataset"), "rule", "n_rows"))


def violation_sample(df: DataFrame, dataset: str, n: int = 5) -> DataFrame:
    """Q7: the first ``n`` failing rows by key, with their broken rules."""
    v = with_violations(df, dataset).where(F.size("violations") > 0)
    order = list(KEYS[dataset]) + [c for c in REQUIRED[dataset] if c not in KEYS[dataset]]
    return v.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(n)
