"""File sources and sinks.

CSV is read with an explicit schema (no inference pass over the data),
header on, quoted fields that may span lines. Stage outputs are parquet;
every sink overwrites its folder and reports the row count it wrote through
``df.observe`` (no second pass).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S

# Logical dataset names and their raw CSV schemas.
RAW_SCHEMAS = {
    "items": T.StructType([
        T.StructField("item_id", T.LongType()), T.StructField("item_name", T.StringType()),
        T.StructField("year", T.IntegerType()), T.StructField("country", T.StringType()),
        T.StructField("type", T.StringType()), T.StructField("content_rt", T.StringType()),
        T.StructField("director", T.StringType()), T.StructField("screenwriter", T.StringType()),
        T.StructField("org_net", T.StringType()), T.StructField("aired_on", T.StringType()),
        T.StructField("duration", T.DoubleType()), T.StructField("tot_eps", T.DoubleType()),
        T.StructField("rank", T.DoubleType()), T.StructField("pop", T.DoubleType()),
        T.StructField("start_dt", T.DateType()), T.StructField("end_dt", T.DateType()),
        T.StructField("synopsis", T.StringType())]),
    "reviews": T.StructType([
        T.StructField("user_id", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("overall_score", T.DoubleType()), T.StructField("story_score", T.DoubleType()),
        T.StructField("acting_cast_score", T.DoubleType()), T.StructField("music_score", T.DoubleType()),
        T.StructField("rewatch_value_score", T.DoubleType()), T.StructField("n_helpful", T.LongType()),
        T.StructField("ep_watched", T.StringType()), T.StructField("review_text", T.StringType())]),
    "credits": T.StructType([
        T.StructField("actor_id", T.LongType()), T.StructField("actor_name", T.StringType()),
        T.StructField("item_name", T.StringType()), T.StructField("character_name", T.StringType()),
        T.StructField("role", T.StringType())]),
}
RAW_FILES = {"items": "items.csv", "reviews": "reviews.csv", "credits": "credits.csv"}


CORRUPT = "corrupt_record"


def _csv_reader(spark: SparkSession, schema: T.StructType):
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of CSV files whose quoted fields may span lines, read by byte ranges.

    Lines are read in parallel, a range of a file a task. A line begins a
    record if the quotes before it are even in number: quotes are summed by
    range, the sums of the ranges before give each range's parity, and a
    running sum within the range decides for its lines. Numbers of records
    come from the same two-level sums, so a record may reach over ranges.
    """
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
             .withColumn("at", F.monotonically_increasing_id())
             .withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"')))))
    whole = "partition by file order by block rows between unbounded preceding and 1 preceding"  # a row a range
    here = "partition by file, block order by at"
    ranges = lines.groupBy("file", "block").agg(F.sum("quotes").alias("n"))
    ranges = ranges.select("file", "block", F.expr(f"coalesce(sum(n) over ({whole}), 0)").alias("before"))
    parity = (F.col("before") + F.expr(f"sum(quotes) over ({here})") - F.col("quotes")) % 2
    marked = lines.join(ranges, ["file", "block"]).withColumn("begins", F.when(parity == 0, 1).otherwise(0))
    starts = marked.groupBy("file", "block").agg(F.sum("begins").alias("n")).select("file", "block", F.expr(f"coalesce(sum(n) over ({whole}), 0)").alias("first"))
    numbered = marked.drop("before").join(starts, ["file", "block"]).withColumn("record", F.col("first") + F.expr(f"sum(begins) over ({here})"))
    parts = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("l"))  # one record's lines
    return parts.select("file", "record", F.regexp_replace(F.array_join("l.value", "\n"), "\r$", "").alias("text"))


def _read_ranges(spark: SparkSession, path: str, raw: T.StructType) -> DataFrame:
    opts = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true"}
    rows = csv_records(spark, path).where((F.col("record") > 1) & (F.col("text") != ""))  # the first record names the columns
    return rows.select(F.from_csv("text", F.lit(raw.simpleString()[len("struct<"):-1].replace(":", " ")), opts).alias("r")).select("r.*")


def load_all_raw(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All three datasets by name."""
    return {name: load_raw(spark, name, root) for name in RAW_FILES}


def load_raw(spark: SparkSession, name: str, root: str, corrupt: bool = False, ranges: bool = False) -> DataFrame:
    """CSV scan of a logical dataset; unknown name or missing file -> error.

    Dates are read as text and parsed leniently (F9), other values by type;
    ``corrupt=True`` adds the column ``corrupt_record`` with the raw text of
    rows that do not fit the schema. A file is one task (its fields may span
    lines) unless ``ranges``, which reads a large file in parallel.
    """
    if name not in RAW_SCHEMAS:
        raise ValueError(f"unknown dataset {name!r}; expected one of {sorted(RAW_SCHEMAS)}")
    path = os.path.join(root, RAW_FILES[name])
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    schema = RAW_SCHEMAS[name]
    dates = [f.name for f in schema if isinstance(f.dataType, T.DateType)]
    raw = T.StructType([T.StructField(f.name, T.StringType() if f.name in dates else f.dataType) for f in schema]
                       + ([T.StructField(CORRUPT, T.StringType())] if corrupt else []))
    table = _read_ranges(spark, path, raw) if ranges else _csv_reader(spark, raw).csv(path)
    return table.withColumns({c: S.parse_date(c) for c in dates})


def write_csv(df: DataFrame, path: str, compression: str = "none") -> int:
    """CSV sink (header, quoted multi-line text), packed by ``compression``; returns rows written."""
    obs = Observation("csv_sink")
    (df.observe(obs, F.count(F.lit(1)).alias("rows"))
     .write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("compression", compression).csv(path))
    return int(obs.get["rows"])


def save_processed(df: DataFrame, root: str, name: str) -> int:
    """Write a stage table as parquet (overwrite); returns rows written."""
    obs = Observation(f"sink_{name}")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(os.path.join(root, name))
    return int(obs.get["rows"])


def read_processed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read a stage table back; types travel with parquet."""
    return spark.read.parquet(os.path.join(root, name))


def parse_list_column(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """A list that arrives as JSON text becomes ``array<string>``."""
    return df.withColumn(out or col, F.from_json(F.col(col), T.ArrayType(T.StringType())))
