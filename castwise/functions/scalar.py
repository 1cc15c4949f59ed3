"""Scalar column functions used by the cleaning, feature and ranking operators.

Each returns a ``Column``; those with lambdas (``dot``, ``title_case``) are
interpreted, the others stay inside whole-stage codegen. ANSI mode is
on by default in Spark 4, so every parse uses ``try_*`` forms and every
division that can see zero is guarded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColLike = Column | str

# Label thresholds and bins that define the reference's
# derived columns. Score label: >= 7 positive (2), >= 4 neutral (1), else
# negative (0). Polarity label: above +0.1 positive, below -0.1 negative.
# Duration bins in seconds, right-closed: (0, 1800] short, (1800, 3600]
# medium, (3600, inf) long. Label names of classes 0, 1, 2.
SCORE_POSITIVE, SCORE_NEUTRAL = 7, 4
POLARITY_BAND = 0.1
DURATION_SHORT_MAX, DURATION_MEDIUM_MAX = 1800, 3600
LABEL_NAMES = ("Negative", "Neutral", "Positive")


def _c(c: ColLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_key(c: ColLike) -> Column:
    """Join key: strip surrounding whitespace (tabs and newlines too), lower."""
    return F.lower(F.regexp_replace(_c(c), r"^\s+|\s+$", ""))


def title_case(c: ColLike) -> Column:
    """Capitalise every run of letters (after a hyphen or bracket too), lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def nan_to_null(c: ColLike) -> Column:
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def episodes_watched(c: ColLike) -> Column:
    """Leading integer of ``"<n> of <m> ..."``; anything unparsable -> 0."""
    first = F.get(F.split(_c(c), " "), 0)
    return F.coalesce(_int_token(first), F.lit(0))


def total_episodes(c: ColLike) -> Column:
    """Third space-separated token as a number; missing or bad -> null."""
    third = F.get(F.split(_c(c), " "), 2)
    return _int_token(third).cast("double")


def _int_token(tok: Column) -> Column:
    # only optional sign + digits count as an int (no fractions, no blanks)
    return F.when(tok.rlike(r"^[+-]?[0-9]+$"), tok.try_cast("int"))


def score_label(c: ColLike) -> Column:
    """Three-way label of a 1-10 score: >=7 -> 2, >=4 -> 1, else (null too) 0."""
    s = nan_to_null(c)
    return (F.when(s >= SCORE_POSITIVE, F.lit(2)).when(s >= SCORE_NEUTRAL, F.lit(1))
            .otherwise(F.lit(0))).cast("int")


def polarity_label(c: ColLike) -> Column:
    """Polarity in [-1, 1] to a label: > 0.1 -> 2, < -0.1 -> 0, else 1."""
    p = _c(c)
    return (F.when(p > POLARITY_BAND, F.lit(2)).when(p < -POLARITY_BAND, F.lit(0))
            .otherwise(F.lit(1))).cast("int")


def label_name(c: ColLike) -> Column:
    c = _c(c)
    return (F.when(c == 0, F.lit(LABEL_NAMES[0])).when(c == 1, F.lit(LABEL_NAMES[1]))
            .when(c == 2, F.lit(LABEL_NAMES[2])))


def duration_category(c: ColLike) -> Column:
    """Right-closed bins (0,1800], (1800,3600], (3600,inf) seconds."""
    d = _c(c)
    return (F.when((d > 0) & (d <= DURATION_SHORT_MAX), F.lit("short"))
            .when((d > DURATION_SHORT_MAX) & (d <= DURATION_MEDIUM_MAX), F.lit("medium"))
            .when(d > DURATION_MEDIUM_MAX, F.lit("long")))


def parse_timestamp(c: ColLike, formats: list[str]) -> Column:
    """Lenient parse: first format that parses wins; nothing parses -> null."""
    c = _c(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


# Accepted date formats of the lenient parser (Spark patterns).
DATE_FORMATS = ["yyyy-MM-dd", "MMM d, yyyy", "d/M/yyyy"]


def parse_date(c: ColLike) -> Column:
    """a date in any accepted format; anything else is null."""
    return parse_timestamp(c, DATE_FORMATS).cast("date")


def days_to_timestamp(days: ColLike) -> Column:
    """Fractional days since 1970-01-01 -> TIMESTAMP_NTZ (time-zone free)."""
    d = _c(days)
    whole = F.floor(d)
    micros = F.round((d - whole) * F.lit(86400 * 1_000_000)).cast("bigint")
    base = F.date_from_unix_date(whole.cast("int")).cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", micros, base)


def clip(c: ColLike, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(c), F.lit(float(lo))), F.lit(float(hi)))


def dot(a: ColLike, b: ColLike) -> Column:
    """Dot product of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def log2_discount(rank: ColLike) -> Column:
    """1 / log2(rank + 1) for ranks counted from 1."""
    return F.lit(1.0) / F.log2(_c(rank) + 1)


def md5_bucket(key: Column, seed: int | str = 42, buckets: int = 1000) -> Column:
    """Portable hash bucket in [0, buckets): first 32 bits of md5(seed|key).

    md5 is the one hash both Spark and DuckDB compute identically, so a split
    or a sample made with it is reproducible in the SQL oracle.
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def r6(c: ColLike) -> Column:
    """Round a floating result to 6 digits (engine-independent comparison)."""
    return F.round(_c(c).cast("double"), 6)
