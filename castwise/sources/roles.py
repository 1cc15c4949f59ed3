"""The three input roles (items, reviews, credits) derived from driver tables.

The catalog of the original system has an item table, a review table with
scores and text, and a person-item credit table. The driver ships TPC-H-like
tables instead, so each role is a deterministic projection of them. Nulls,
mixed case and padded keys are injected on purpose so that the cleaning
operators have work to do. The same definitions exist as SQL in
``castwise.plans.sqlbase`` (``ROLE_CTES``); both must stay in step.

* items: every ``part``; names hold the part key, but a few pairs of parts
  share a name on purpose (the name lookup must pick one).
* reviews: every ``lineitem`` row rates its part; the lines of the order whose
  key is a document's id carry that document as review text.
* credits: four credits for every part, to three suppliers (one twice).

All three are plain lazy plans: joins on keys, one aggregate for item dates,
and a one-row document count. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables

_DAYS = "MonTueWedThuFriSatSun"
#: The column of a keyed review that names the document holding its text.
TEXT_KEY = "text_id"


def _null_if(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def _name() -> Column:
    """Item name of a part."""
    k = F.col("p_partkey")
    own = F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" "), k.cast("string"))
    return F.when(k % 101 == 0, F.concat(F.lit("twin title "), F.floor(k / 202).cast("string"))).otherwise(own)


def _docs(t: Tables) -> DataFrame:
    """The document text side of a join (large: the join strategy is Spark's)."""
    return t.documents.select(F.col("doc_id"), F.col("text").alias("d_text"))


def _doc_count(t: Tables) -> DataFrame:
    # one row: proven size bound, broadcast is safe
    return F.broadcast(t.documents.agg(F.count(F.lit(1)).alias("nd")))


def items(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """The item catalog; ``with_text=False`` leaves out the synopsis (and so
    never touches the documents table)."""
    t = Tables(spark, sf_dir)
    ship = (t.lineitem.groupBy("l_partkey")
            .agg(F.min("l_shipdate").alias("st"), F.max("l_shipdate").alias("en"),
                 F.count(F.lit(1)).alias("n")))
    p = t.part
    k = F.col("p_partkey")
    base = p.join(ship, k == ship.l_partkey, "left")
    cols = [
        k.alias("item_id"),
        _name().alias("item_name"),
        F.year("st").cast("int").alias("year"),
        F.lit("KR").alias("country"),
        F.lit("series").alias("type"),
        F.col("p_type").alias("content_rt"),
        _null_if(k % 5 == 0, F.concat(F.lit("dir "), (k % 40).cast("string"))).alias("director"),
        _null_if(k % 3 == 0, F.concat(F.lit("wri "), (k % 30).cast("string"))).alias("screenwriter"),
        _null_if(k % 11 == 0, F.col("p_brand")).alias("org_net"),
        _null_if(k % 7 == 0, F.substring(F.lit(_DAYS), 1 + 3 * (k % 7), 3)).alias("aired_on"),
        _null_if(k % 13 == 0, (F.col("p_size") * 100).cast("double")).alias("duration"),
        F.col("p_size").cast("double").alias("tot_eps"),
        F.col("p_retailprice").alias("rank"),
        F.col("n").cast("double").alias("pop"),
        _null_if(k % 17 == 0, F.col("st").cast("date")).alias("start_dt"),
        _null_if(k % 19 == 0, F.col("en").cast("date")).alias("end_dt"),
    ]
    rows = base.select(*cols)
    return with_synopsis(rows, t) if with_text else rows


def text_keys(items: DataFrame, t: Tables) -> DataFrame:
    """Rows with an ``item_id``, with the key of the document that is their synopsis, and whether they have one."""
    k = F.col("item_id")
    return items.crossJoin(_doc_count(t)).withColumns({"doc_key": k % F.col("nd"), "has_text": F.coalesce(k % 23 != 0, F.lit(True))}).drop("nd")


def with_synopsis(items: DataFrame, t: Tables) -> DataFrame:
    """Items with the column ``synopsis``."""
    docs = _docs(t)
    base = text_keys(items, t)
    return (base.join(docs, base.doc_key == docs.doc_id, "left")
            .select(*items.columns, F.when(F.col("has_text"), F.col("d_text")).alias("synopsis")))


def item_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id, item_name)`` of the item role, straight from ``part``."""
    p = Tables(spark, sf_dir).part
    return p.select(F.col("p_partkey").alias("item_id"), _name().alias("item_name"))


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(text_id, review_text)``: the texts of the review role, a row a document."""
    k = F.col("doc_id")
    return Tables(spark, sf_dir).documents.select(k.alias(TEXT_KEY), _null_if(k % 23 == 0, F.col("text")).alias("review_text"))


def reviews(spark: SparkSession, sf_dir: str, with_text: bool = True, keyed: bool = False) -> DataFrame:
    """User-item ratings; ``with_text=False`` leaves out the review text; ``keyed`` adds its key, ``text_id`` (null: no document)."""
    t = Tables(spark, sf_dir)
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                           "l_extendedprice", "l_discount", "l_tax")
    o = t.orders.select("o_orderkey", "o_custkey")
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_size")
    # keys of the documents, beside the orders' (same exchange): later only reviews that hold a text meet the texts
    held = t.documents.select(F.col("doc_id").alias(TEXT_KEY)).where(F.col(TEXT_KEY).isNotNull()).distinct()
    base = (li.join(o, li.l_orderkey == o.o_orderkey).join(held, li.l_orderkey == held[TEXT_KEY], "left")
            .join(p, li.l_partkey == p.p_partkey))
    ok = F.col("l_orderkey")

    def score(c: Column) -> Column:
        return F.lit(1.0) + (c % 10).cast("double")

    ep = (F.when(ok % 29 == 0, F.lit("unknown"))
          .when(ok % 31 == 0, F.col("l_linenumber").cast("string"))
          .otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit(" of "),
                              F.col("p_size").cast("string"), F.lit(" episodes seen"))))
    cols = [
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.concat(F.lit(" "), F.upper(_name()), F.lit(" ")).alias("title"),
        score(F.floor("l_quantity")).alias("overall_score"),
        score(F.floor("l_extendedprice")).alias("story_score"),
        score(F.round(F.col("l_discount") * 100).cast("bigint")).alias("acting_cast_score"),
        (F.lit(1.0) + F.round(F.col("l_tax") * 100)).cast("double").alias("music_score"),
        score(F.col("l_orderkey") + F.col("l_partkey")).alias("rewatch_value_score"),
        F.col("l_suppkey").alias("n_helpful"),
        ep.alias("ep_watched"),
    ]
    rows = base.select(*cols, TEXT_KEY)
    if with_text:
        rows = rows.join(review_texts(spark, sf_dir), TEXT_KEY, "left").select(*rows.columns, "review_text")
    return rows if keyed else rows.drop(TEXT_KEY)


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    s = t.supplier.select("s_suppkey", "s_name")
    ns = F.broadcast(t.supplier.agg(F.count(F.lit(1)).alias("ns")))  # one row
    k, i = F.col("p_partkey"), F.col("i")
    cast = (t.part.select("p_partkey", "p_name", "p_brand", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).crossJoin(ns)
            .withColumn("suppkey", (k + (i % 3) * (k % 5 + 1)) % F.col("ns")))
    role = (F.when(i == 0, F.lit("main role")).when(i == 1, F.lit("SUPPORT ROLE"))
            .when(i == 2, F.lit("guest role")).otherwise(F.lit("co-lead (main) role")))
    return cast.join(s, F.col("suppkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("actor_id"),
        F.col("s_name").alias("actor_name"),
        _name().alias("item_name"),
        F.concat(F.lit("char "), i.cast("string")).alias("character_name"),
        role.alias("role"),
    )
