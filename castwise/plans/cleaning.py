"""Quality, cleaning and imputation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import clean as C
from ..operators import quality as Q
from .catalog import Ctx, register
from .sqlbase import md5_bucket, r6, with_ctes

# ---------------------------------------------------------------- quality

_ITEM_BAD = """(item_name IS NULL OR country IS NULL OR type IS NULL OR year IS NULL
 OR coalesce(NOT (year BETWEEN 2000 AND 2030), false)
 OR coalesce(tot_eps < 0, false) OR coalesce(duration < 0, false)
 OR coalesce(rank < 0, false) OR coalesce(pop < 0, false))"""
_REVIEW_BAD = "(user_id IS NULL OR title IS NULL OR n_helpful IS NULL OR " + " OR ".join(
    f"NOT coalesce({c} BETWEEN 1.0 AND 10.0 AND NOT isnan({c}), false)" for c in Q.REVIEW_SCORES) + ")"
_CREDIT_BAD = "(" + " OR ".join(f"{c} IS NULL" for c in Q.CREDIT_STR) + ")"


def _verdict_sql(name: str, table: str, bad: str, where: str = "true") -> str:
    return (f"SELECT '{name}' AS dataset, count(*) AS n_rows, count_if({bad}) AS n_bad, "
            f"count_if({bad}) = 0 AS passed FROM {table} WHERE {where}")


@register("quality_report", with_ctes(
    _verdict_sql("items", "items", _ITEM_BAD, "item_id IS NOT NULL") + " UNION ALL "
    + _verdict_sql("reviews", "reviews", _REVIEW_BAD) + " UNION ALL "
    + _verdict_sql("credits", "credits", _CREDIT_BAD)), ids="Q1-Q3,Q5,Q6,Q8,Q9")
def quality_report(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return Q.report({"items": c.items_core, "reviews": c.reviews_core, "credits": c.credits})


@register("quality_items_passing", with_ctes(
    _verdict_sql("items", "(SELECT * REPLACE (year + 7 AS year) FROM items)", _ITEM_BAD,
                 "item_id IS NOT NULL")), ids="Q4,Q8")
def quality_items_passing(spark, sf_dir):
    """The item check on years shifted into range: the passing fixture."""
    c = Ctx(spark, sf_dir)
    return Q.verdict(c.items_core.withColumn("year", F.col("year") + 7), "items")


_ITEM_RULES_SQL = """
SELECT 'items' AS dataset, rule, count(*) AS n_rows FROM (
 SELECT unnest(list_filter([
  CASE WHEN item_name IS NULL THEN 'item_name_missing' END,
  CASE WHEN country IS NULL THEN 'country_missing' END,
  CASE WHEN type IS NULL THEN 'type_missing' END,
  CASE WHEN year IS NULL THEN 'year_type' END,
  CASE WHEN coalesce(NOT (year BETWEEN 2000 AND 2030), false) THEN 'year_range' END,
  CASE WHEN coalesce(tot_eps < 0, false) THEN 'tot_eps_negative' END,
  CASE WHEN coalesce(duration < 0, false) THEN 'duration_negative' END,
  CASE WHEN coalesce(rank < 0, false) THEN 'rank_negative' END,
  CASE WHEN coalesce(pop < 0, false) THEN 'pop_negative' END], lambda x: x IS NOT NULL)) AS rule
 FROM items WHERE item_id IS NOT NULL) GROUP BY rule"""


@register("quality_violation_counts", with_ctes(_ITEM_RULES_SQL), ids="Q3-Q7")
def quality_violation_counts(spark, sf_dir):
    return Q.violation_counts(Ctx(spark, sf_dir).items_core, "items")


@register("quality_violation_sample", with_ctes("""
SELECT item_id, item_name, year, country, type, tot_eps, duration, rank, pop,
 list_filter([
  CASE WHEN item_name IS NULL THEN 'item_name_missing' END,
  CASE WHEN country IS NULL THEN 'country_missing' END,
  CASE WHEN type IS NULL THEN 'type_missing' END,
  CASE WHEN year IS NULL THEN 'year_type' END,
  CASE WHEN coalesce(NOT (year BETWEEN 2000 AND 2030), false) THEN 'year_range' END,
  CASE WHEN coalesce(tot_eps < 0, false) THEN 'tot_eps_negative' END,
  CASE WHEN coalesce(duration < 0, false) THEN 'duration_negative' END,
  CASE WHEN coalesce(rank < 0, false) THEN 'rank_negative' END,
  CASE WHEN coalesce(pop < 0, false) THEN 'pop_negative' END], lambda x: x IS NOT NULL) AS violations
FROM items WHERE item_id IS NOT NULL AND """ + _ITEM_BAD + """
ORDER BY item_id LIMIT 5"""), ids="Q7")
def quality_violation_sample(spark, sf_dir):
    return Q.violation_sample(Ctx(spark, sf_dir).items_core, "items", 5)


_DIRTY = """SELECT item_id, item_id AS item_name, country, type, duration, rank, pop,
  CASE WHEN item_id % 50 = 0 THEN 'n/a' WHEN item_id % 50 = 1 THEN '2015.5' WHEN item_id % 50 = 2 THEN '1890' ELSE CAST(year + 7 AS VARCHAR) END AS year,
  CASE WHEN item_id % 40 = 0 THEN 'many' WHEN item_id % 40 = 1 THEN '-3' ELSE CAST(tot_eps AS VARCHAR) END AS tot_eps,
  CASE WHEN item_id % 4 = 0 THEN 'soon' WHEN item_id % 4 = 1 THEN strftime(start_dt, '%Y-%m-%d') WHEN item_id % 4 = 2 THEN strftime(start_dt, '%b %-d, %Y')
    ELSE strftime(start_dt, '%-d/%-m/%Y') END AS start_text FROM items"""


def dirty_items(c: Ctx):
    """Items as a careless raw table has them: names as numbers, years and counts as text, dates in three formats."""
    k, y, d = F.col("item_id"), (F.col("year") + 7).cast("string"), F.col("start_dt")
    return c.items_core.select(
        "item_id", k.alias("item_name"), "country", "type", "duration", "rank", "pop",
        F.when(k % 50 == 0, "n/a").when(k % 50 == 1, "2015.5").when(k % 50 == 2, "1890").otherwise(y).alias("year"),
        F.when(k % 40 == 0, "many").when(k % 40 == 1, "-3").otherwise(F.col("tot_eps").cast("string")).alias("tot_eps"),
        F.when(k % 4 == 0, "soon").when(k % 4 == 1, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 2, F.date_format(d, "MMM d, yyyy"))
        .otherwise(F.date_format(d, "d/M/yyyy")).alias("start_text"))


@register("quality_dirty_items", with_ctes(f"""
SELECT rule, count(*) AS n_rows FROM (SELECT unnest(list_filter([
  CASE WHEN item_name IS NOT NULL THEN 'item_name_type' END,
  CASE WHEN item_name IS NULL THEN 'item_name_missing' END,
  CASE WHEN coalesce(floor(TRY_CAST(year AS DOUBLE)) <> TRY_CAST(year AS DOUBLE), true) THEN 'year_type' END,
  CASE WHEN coalesce(NOT (TRY_CAST(year AS DOUBLE) BETWEEN 2000 AND 2030), false) THEN 'year_range' END,
  CASE WHEN coalesce(TRY_CAST(tot_eps AS DOUBLE) < 0, false) THEN 'tot_eps_negative' END,
  CASE WHEN tot_eps IS NOT NULL AND TRY_CAST(tot_eps AS DOUBLE) IS NULL THEN 'tot_eps_type' END], lambda x: x IS NOT NULL)) AS rule
 FROM ({_DIRTY}) WHERE item_id IS NOT NULL) GROUP BY rule"""), ids="Q3-Q5")
def quality_dirty_items(spark, sf_dir):
    return Q.violation_counts(dirty_items(Ctx(spark, sf_dir)), "items").select("rule", "n_rows")


@register("lenient_item_dates", with_ctes(f"""
SELECT item_id, start_text, CAST(coalesce(try_strptime(start_text, '%Y-%m-%d'), try_strptime(start_text, '%b %-d, %Y'),
  try_strptime(start_text, '%-d/%-m/%Y')) AS DATE) AS start_dt FROM ({_DIRTY})"""), ids="F9,S1")
def lenient_item_dates(spark, sf_dir):
    return dirty_items(Ctx(spark, sf_dir)).select("item_id", "start_text", S.parse_date("start_text").alias("start_dt"))


# ---------------------------------------------------------------- cleaning

_ITEMS_CLEAN_COLS = ("item_id, item_name, year, country, type, content_rt, director, screenwriter, "
                     "org_net, aired_on, duration, tot_eps, rank, pop, start_dt, end_dt, synopsis, "
                     "start_month, start_day_of_week, duration_days, duration_category")


@register("clean_items", with_ctes(f"SELECT {_ITEMS_CLEAN_COLS} FROM items_clean"),
          ids="C1-C4,C7,C15,F6-F8")
def clean_items(spark, sf_dir):
    return Ctx(spark, sf_dir).items_clean.select(*[c.strip() for c in _ITEMS_CLEAN_COLS.split(",")])


_REVIEWS_CLEAN_COLS = ("user_id, title, overall_score, story_score, acting_cast_score, music_score, "
                       "rewatch_value_score, n_helpful, ep_watched, review_text, episodes_watched, "
                       "total_episodes, sentiment_label")


@register("clean_reviews", with_ctes(f"SELECT {_REVIEWS_CLEAN_COLS} FROM reviews_clean"),
          ids="C1,F1,F3-F5")
def clean_reviews(spark, sf_dir):
    return Ctx(spark, sf_dir).reviews_clean.select(*[c.strip() for c in _REVIEWS_CLEAN_COLS.split(",")])


@register("clean_credits", with_ctes(
    "SELECT actor_id, actor_name, item_name, character_name, role FROM credits_clean"), ids="F1,F2")
def clean_credits(spark, sf_dir):
    return Ctx(spark, sf_dir).credits_clean


@register("merge_credits_reviews", with_ctes("""
SELECT c.*, r.* EXCLUDE (review_text), md5(review_text) AS review_text_md5
FROM credits_clean c JOIN reviews_clean r ON c.item_name = r.title"""), ids="J1,S9")
def merge_credits_reviews(spark, sf_dir):
    """Every merged row with all its columns; the text is returned as its md5."""
    c = Ctx(spark, sf_dir)
    r = c.by_text(c.reviews_clean_keyed, lambda t: t.select("text_id", F.md5("review_text").alias("review_text_md5")))
    return C.merge_credits_reviews(c.credits_clean, r, c.reviews_clean_core)


@register("impute_values", with_ctes(f"""
SELECT m_aired AS mode_aired_on, m_org AS mode_org_net, {r6('med_dur')} AS median_duration,
 {r6('med_start')} AS median_start_days, {r6('med_end')} AS median_end_days FROM item_fill"""),
          ids="C2-C4")
def impute_values(spark, sf_dir):
    f = C.item_fill_values(Ctx(spark, sf_dir).items_core)
    return f.select(F.col("_mode_aired_on").alias("mode_aired_on"),
                    F.col("_mode_org_net").alias("mode_org_net"),
                    S.r6("_med_duration").alias("median_duration"),
                    S.r6("_med_start").alias("median_start_days"),
                    S.r6("_med_end").alias("median_end_days"))


@register("parse_progress", with_ctes("""
SELECT ep_watched, episodes_watched, total_episodes, count(*) AS n_rows
FROM reviews_clean GROUP BY ALL"""), ids="F3,F4")
def parse_progress(spark, sf_dir):
    r = Ctx(spark, sf_dir).reviews_clean_core
    return (r.groupBy("ep_watched", "episodes_watched", "total_episodes")
            .agg(F.count(F.lit(1)).alias("n_rows")))


@register("duration_bins", with_ctes("""
SELECT duration_category, count(*) AS n_items FROM items_clean
WHERE duration_category IS NOT NULL GROUP BY 1"""), ids="F8,A13")
def duration_bins(spark, sf_dir):
    i = Ctx(spark, sf_dir).items_clean_core
    return (i.where(F.col("duration_category").isNotNull())
            .groupBy("duration_category").agg(F.count(F.lit(1)).alias("n_items")))


_NULL_COLS = ("item_id", "item_name", "year", "country", "type", "content_rt", "director", "screenwriter", "org_net",
              "aired_on", "duration", "tot_eps", "rank", "pop", "start_dt", "end_dt", "synopsis")


@register("null_profile", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS n_null FROM items" for c in _NULL_COLS)),
          ids="C8")
def null_profile(spark, sf_dir):
    from ..operators.profile import null_profile as np_
    return np_(Ctx(spark, sf_dir).items, list(_NULL_COLS))


@register("null_row_filter", with_ctes("""
SELECT item_id, item_name, org_net, aired_on FROM items WHERE org_net IS NULL OR aired_on IS NULL"""),
          ids="C12")
def null_row_filter(spark, sf_dir):
    i = Ctx(spark, sf_dir).items_core
    return (i.where(F.col("org_net").isNull() | F.col("aired_on").isNull())
            .select("item_id", "item_name", "org_net", "aired_on"))


_SPLIT_BUCKET = md5_bucket("CAST(user_id AS VARCHAR) || '|' || title || '|' || CAST(overall_score AS VARCHAR)")


@register("review_split", with_ctes(f"""
SELECT CASE WHEN {_SPLIT_BUCKET} < 100 THEN 'test' ELSE 'train' END AS part, count(*) AS n_rows,
 count(DISTINCT user_id) AS n_users FROM reviews_clean GROUP BY 1"""), ids="C18")
def review_split(spark, sf_dir):
    from ..operators.factor import split_ratings
    r = Ctx(spark, sf_dir).reviews_clean_core
    return (split_ratings(r).groupBy("part")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users")))


# ---------------------------------------------------------------- files and lists

@register("csv_roundtrip_items", with_ctes("SELECT * FROM items"), ids="S1,S2,S5")
def csv_roundtrip_items(spark, sf_dir):
    """Items written as CSV (header, quoted multi-line text) under the
    checkpoint folder and read back with the fixed schema."""
    import os
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import files as FI
    root = os.path.join(ensure_checkpoint_dir(spark), f"raw-{uuid.uuid4().hex}")
    FI.write_csv(Ctx(spark, sf_dir).items, os.path.join(root, FI.RAW_FILES["items"]))
    return FI.load_raw(spark, "items", root)


@register("raw_table_rows", with_ctes("""
SELECT 'items' AS name, count(*) AS n_rows FROM items UNION ALL SELECT 'reviews', count(*) FROM reviews UNION ALL SELECT 'credits', count(*) FROM credits"""), ids="S2,S1")
def raw_table_rows(spark, sf_dir):
    """All three tables written as (packed) CSV and loaded back together."""
    import os
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import files as FI
    c, root = Ctx(spark, sf_dir), os.path.join(ensure_checkpoint_dir(spark), f"raw-{uuid.uuid4().hex}")
    for name, df in (("items", c.items), ("reviews", c.reviews), ("credits", c.credits)):
        FI.write_csv(df, os.path.join(root, FI.RAW_FILES[name]), "gzip")  # a file is read by one task, packed or not
    rows = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows") for name, df in FI.load_all_raw(spark, root).items()]
    return rows[0].union(rows[1]).union(rows[2])


@register("one_file_csv", with_ctes("SELECT * FROM items"), ids="S1")
def one_file_csv(spark, sf_dir):
    """The items as one CSV file, its quoted texts over several lines, read by byte ranges in parallel."""
    import os
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import files as FI
    root = os.path.join(ensure_checkpoint_dir(spark), f"raw-{uuid.uuid4().hex}")
    FI.write_csv(Ctx(spark, sf_dir).items.coalesce(1), os.path.join(root, FI.RAW_FILES["items"]))
    return FI.load_raw(spark, "items", root, ranges=True)


@register("merged_file", with_ctes("""
SELECT c.actor_id, c.item_name, c.role, r.user_id, r.overall_score, r.review_text FROM credits_clean c JOIN reviews_clean r ON c.item_name = r.title WHERE c.role = 'Main Role'"""), ids="S9,J1")
def merged_file(spark, sf_dir):
    """The merged table with its text, written and read back; the main roles of it."""
    import os
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import files as FI
    c, root = Ctx(spark, sf_dir), os.path.join(ensure_checkpoint_dir(spark), f"processed-{uuid.uuid4().hex}")
    main = c.credits_clean.where("role = 'Main Role'")
    # the texts join the merged rows, by their key: they are moved once, not with every join before
    m = c.by_text(c.reviews_clean_keyed, lambda t: t, lambda r: C.merge_credits_reviews(main, r))
    FI.save_processed(m.select(*c.credits_clean.columns, *c.reviews_clean.columns), root, "merged")
    return FI.read_processed(spark, root, "merged").select("actor_id", "item_name", "role", "user_id", "overall_score", "review_text")


@register("processed_items", with_ctes(f"SELECT {_ITEMS_CLEAN_COLS} FROM items_clean"), ids="S3-S6")
def processed_items(spark, sf_dir):
    """The cleaned items through the processed-table sink and back."""
    import os
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import files as FI
    root = os.path.join(ensure_checkpoint_dir(spark), f"processed-{uuid.uuid4().hex}")
    FI.save_processed(Ctx(spark, sf_dir).items_clean, root, "items")
    return FI.read_processed(spark, root, "items").select(*[c.strip() for c in _ITEMS_CLEAN_COLS.split(",")])


@register("most_common_elements", with_ctes("""
SELECT e AS element, count(*) AS n FROM (
 SELECT unnest(CAST(lst AS VARCHAR[])) AS e FROM (
  SELECT l.l_orderkey, to_json(list(concat(p.p_name, ' ', p.p_brand) ORDER BY l.l_linenumber)) AS lst
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY l.l_orderkey))
GROUP BY e ORDER BY n DESC, element LIMIT 10"""), ids="S10,T6,U5")
def most_common_elements(spark, sf_dir):
    """Each order's item names travel as a JSON list text (as a CSV list
    column would); it is parsed to an array, flattened and counted."""
    from ..sources import files as FI
    t = Ctx(spark, sf_dir).t
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber")
    p = t.part.select("p_partkey", F.concat("p_name", F.lit(" "), "p_brand").alias("name"))
    lists = (li.join(p, li.l_partkey == p.p_partkey)
             .groupBy("l_orderkey")  # an order's lines: a bounded group
             .agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "name"))),
                                        lambda x: x["name"])).alias("lst")))
    parsed = FI.parse_list_column(lists, "lst")
    return (parsed.select(F.explode("lst").alias("element")).groupBy("element")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "element").limit(10))


@register("parse_dates", with_ctes("""
SELECT o_orderkey, s, CAST(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%b %-d, %Y'),
  try_strptime(s, '%-d/%-m/%Y')) AS DATE) AS parsed FROM (
 SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'not a date'
   WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
   WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%b %-d, %Y')
   ELSE strftime(o_orderdate, '%-d/%-m/%Y') END AS s FROM orders)"""), ids="F9")
def parse_dates(spark, sf_dir):
    """Order dates rendered in three formats (and some junk), parsed back."""
    o = Ctx(spark, sf_dir).t.orders
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    s = (F.when(k % 97 == 0, F.lit("not a date"))
         .when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd"))
         .when(k % 3 == 1, F.date_format(d, "MMM d, yyyy"))
         .otherwise(F.date_format(d, "d/M/yyyy")))
    x = o.select("o_orderkey", s.alias("s"))
    return x.select("o_orderkey", "s", S.parse_date("s").alias("parsed"))


@register("review_sample", with_ctes(f"""
SELECT sentiment_label, count(*) AS n_rows FROM reviews_clean
WHERE {md5_bucket("CAST(user_id AS VARCHAR) || '|' || title || '|' || CAST(overall_score AS VARCHAR)", "sample")} < 100
GROUP BY 1"""), ids="C16")
def review_sample(spark, sf_dir):
    """A reproducible ~10 % row sample (md5 bucket), counted per label."""
    r = Ctx(spark, sf_dir).reviews_clean_core
    key = F.concat_ws("|", F.col("user_id").cast("string"), F.col("title"), F.col("overall_score").cast("string"))
    return (r.where(S.md5_bucket(key, "sample") < 100).groupBy("sentiment_label")
            .agg(F.count(F.lit(1)).alias("n_rows")))
