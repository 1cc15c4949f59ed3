"""Profiling, listing and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import credits as K
from ..operators import graph as G
from ..operators import profile as P
from .catalog import Ctx, register
from .sqlbase import r6, with_ctes

_RN = P.REVIEW_NUMERIC
_IN = P.ITEM_NUMERIC


def _describe_sql(table: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS count, {r6(f'avg({c})')} AS mean, "
        f"{r6(f'stddev_samp({c})')} AS std, {r6(f'min({c})')} AS min, "
        f"{r6(f'quantile_cont({c}, 0.25)')} AS p25, {r6(f'quantile_cont({c}, 0.5)')} AS p50, "
        f"{r6(f'quantile_cont({c}, 0.75)')} AS p75, {r6(f'max({c})')} AS max FROM {table}"
        for c in cols)


@register("describe_reviews", with_ctes(_describe_sql(
    "(SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _RN) + " FROM reviews_clean)", _RN)),
          ids="C9")
def describe_reviews(spark, sf_dir):
    return P.describe(Ctx(spark, sf_dir).reviews_clean_core, _RN)


_ITEM_NUMBERS = ("year", "duration", "tot_eps", "rank", "pop")


@register("describe_items", with_ctes(_describe_sql(
    "(SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _ITEM_NUMBERS) + " FROM items)", _ITEM_NUMBERS)), ids="C9")
def describe_items(spark, sf_dir):
    return P.describe(Ctx(spark, sf_dir).items_core, _ITEM_NUMBERS)


@register("describe_credits", with_ctes(_describe_sql("(SELECT CAST(actor_id AS DOUBLE) AS actor_id FROM credits)", ("actor_id",))), ids="C9")
def describe_credits(spark, sf_dir):
    return P.describe(Ctx(spark, sf_dir).credits, ("actor_id",))


def _corr_sql(table: str, cols) -> str:
    parts = []
    for a in cols:
        for b in cols:
            c = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                         f"{r6(f'CASE WHEN isnan({c}) THEN NULL ELSE greatest(-1.0, least(1.0, {c})) END')}"
                         f" AS corr FROM {table}")
    return " UNION ALL ".join(parts)


@register("corr_reviews", with_ctes(_corr_sql("reviews_clean", _RN)), ids="A14")
def corr_reviews(spark, sf_dir):
    return P.corr_matrix(Ctx(spark, sf_dir).reviews_clean_core, _RN)


@register("corr_items", with_ctes(_corr_sql("items_clean", _IN)), ids="A14")
def corr_items(spark, sf_dir):
    return P.corr_matrix(Ctx(spark, sf_dir).items_clean_core, _IN)


def _skew_sql(table: str, cols) -> str:
    return with_ctes(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {r6(f'CASE WHEN count({c}) < 3 THEN NULL WHEN stddev_pop({c}) = 0 THEN 0 ELSE skewness(CAST({c} AS DOUBLE)) END')} AS skewness FROM {table}"
        for c in cols))


@register("skew_items", _skew_sql("items_clean", _IN), ids="A15")
def skew_items(spark, sf_dir):
    return P.skewness(Ctx(spark, sf_dir).items_clean_core, _IN)


@register("skew_reviews", _skew_sql("reviews_clean", _RN), ids="A15")
def skew_reviews(spark, sf_dir):
    return P.skewness(Ctx(spark, sf_dir).reviews_clean_core, _RN)


_SCORES = ("story_score", "acting_cast_score", "music_score", "rewatch_value_score", "overall_score")


@register("score_histogram", with_ctes("""
WITH long AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS v FROM reviews_clean WHERE {c} IS NOT NULL"
    for c in _SCORES) + """),
b AS (SELECT column_name, min(v) AS lo, max(v) AS hi FROM long GROUP BY 1),
x AS (SELECT column_name, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 10)), 9) END AS INTEGER) AS bin
      FROM long l JOIN b USING (column_name)),
n AS (SELECT column_name, bin, count(*) AS n FROM x GROUP BY ALL),
e AS (SELECT b.*, CAST(i AS INTEGER) AS bin FROM b CROSS JOIN range(0, 10) r(i))
SELECT column_name, bin, round(lo + bin * (hi - lo) / 10, 6) AS bin_lo,
 round(lo + (bin + 1) * (hi - lo) / 10, 6) AS bin_hi, coalesce(n, 0) AS n FROM e LEFT JOIN n USING (column_name, bin)"""),
          ids="A16")
def score_histogram(spark, sf_dir):
    return P.histogram(Ctx(spark, sf_dir).reviews_clean_core, _SCORES, bins=10)


@register("score_density", with_ctes("WITH " + ", ".join(f"""
v_{c} AS (SELECT CAST({c} AS DOUBLE) AS v FROM reviews_clean WHERE {c} IS NOT NULL),
s_{c} AS (SELECT count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM v_{c}),
c_{c} AS (SELECT v, count(*) AS cnt FROM v_{c} GROUP BY v),
g_{c} AS (SELECT i AS point, lo + i * (hi - lo) / 49 AS x, n, sd * pow(CAST(n AS DOUBLE), -0.2) AS h
      FROM range(0, 50) r(i) CROSS JOIN s_{c} WHERE sd > 0)""" for c in _SCORES) + " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, CAST(point AS INTEGER) AS point, round(x, 6) AS x,
 round(sum(cnt * exp(-pow((x - v) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
FROM g_{c} CROSS JOIN c_{c} GROUP BY point, x""" for c in _SCORES)), ids="A17")
def score_density(spark, sf_dir):
    return P.density(Ctx(spark, sf_dir).reviews_clean_core, _SCORES, points=50)


@register("label_counts", with_ctes("""
SELECT CASE sentiment_label WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END AS value,
 count(*) AS n FROM reviews_clean GROUP BY 1"""), ids="A13,C19")
def label_counts(spark, sf_dir):
    r = Ctx(spark, sf_dir).reviews_clean_core.select(S.label_name("sentiment_label").alias("label"))
    return P.value_counts(r, "label")


@register("items_per_year", with_ctes(
    "SELECT year, count(*) AS n_items FROM items_clean GROUP BY year"), ids="A12")
def items_per_year(spark, sf_dir):
    return Ctx(spark, sf_dir).items_clean_core.groupBy("year").agg(F.count(F.lit(1)).alias("n_items"))


@register("top_items_duration", with_ctes("""
SELECT item_id, item_name, duration FROM items_clean WHERE duration IS NOT NULL
ORDER BY duration DESC, item_id LIMIT 10"""), ids="T1")
def top_items_duration(spark, sf_dir):
    return P.top_n_by(Ctx(spark, sf_dir).items_clean_core, "duration", "item_id", 10, cols=("item_name",))


@register("top_networks", with_ctes("""
SELECT org_net AS value, count(*) AS n FROM items_clean WHERE org_net IS NOT NULL
GROUP BY 1 ORDER BY n DESC, value LIMIT 10"""), ids="T2,A13")
def top_networks(spark, sf_dir):
    return P.value_counts(Ctx(spark, sf_dir).items_clean_core, "org_net", top_n=10)


@register("top_persons", with_ctes("""
SELECT actor_name AS value, count(*) AS n FROM credits_clean WHERE actor_name IS NOT NULL
GROUP BY 1 ORDER BY n DESC, value LIMIT 10"""), ids="T2,A13")
def top_persons(spark, sf_dir):
    return P.value_counts(Ctx(spark, sf_dir).credits_clean, "actor_name", top_n=10)


@register("role_counts", with_ctes("""
SELECT role AS value, count(*) AS n FROM credits_clean WHERE role IS NOT NULL GROUP BY 1"""),
          ids="A13")
def role_counts(spark, sf_dir):
    return P.value_counts(Ctx(spark, sf_dir).credits_clean, "role")


@register("top_persons_by_items", with_ctes("""
SELECT actor_name, count(DISTINCT item_name) AS n_items FROM credits_clean WHERE actor_name IS NOT NULL
GROUP BY 1 ORDER BY n_items DESC, actor_name LIMIT 10"""), ids="T4,A5")
def top_persons_by_items(spark, sf_dir):
    return K.top_persons_by_items(Ctx(spark, sf_dir).credits_clean, 10)


_MERGED = "(SELECT c.actor_name, c.role, c.item_name, r.user_id, r.overall_score FROM credits_clean c JOIN reviews_clean r ON c.item_name = r.title)"


@register("top_persons_by_score", with_ctes(f"""
SELECT actor_name, {r6('avg(overall_score)')} AS avg_score, count(user_id) AS review_count
FROM {_MERGED} GROUP BY actor_name
ORDER BY avg(overall_score) DESC NULLS LAST, review_count DESC, actor_name LIMIT 10"""), ids="A7,T3,J1")
def top_persons_by_score(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return K.person_score_ranking(c.credits_clean, c.reviews_clean_core, 10).select(
        "actor_name", S.r6("avg_score").alias("avg_score"), "review_count")


@register("person_role_impact", with_ctes(f"""
SELECT actor_name, role, {r6('avg(overall_score)')} AS avg_score, count(user_id) AS review_count
FROM {_MERGED} GROUP BY actor_name, role"""), ids="A8")
def person_role_impact(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return K.person_role_impact(c.credits_clean, c.reviews_clean_core).select(
        "actor_name", "role", S.r6("avg_score").alias("avg_score"), "review_count")


@register("person_reputation", with_ctes(f"""
SELECT actor_name, {r6('avg(overall_score)')} AS actor_avg_score,
 count(DISTINCT item_name) AS actor_appearances FROM {_MERGED} GROUP BY actor_name"""), ids="A6,A5")
def person_reputation(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return K.person_reputation(c.credits_clean, c.reviews_clean_core).select(
        "actor_name", S.r6("actor_avg_score").alias("actor_avg_score"), "actor_appearances")


_EDGES_SQL = """
top AS (SELECT actor_name FROM credits_clean WHERE actor_name IS NOT NULL GROUP BY 1
        ORDER BY count(DISTINCT item_name) DESC, actor_name LIMIT 25),
pairs AS (SELECT DISTINCT actor_name, item_name FROM credits_clean
          WHERE item_name IS NOT NULL AND actor_name IN (SELECT actor_name FROM top)),
edges AS (SELECT a.actor_name AS person_a, b.actor_name AS person_b, count(*) AS n_items,
          min(a.item_name) AS first_item
          FROM pairs a JOIN pairs b ON a.item_name = b.item_name AND a.actor_name < b.actor_name
          GROUP BY 1, 2)"""


@register("co_appearance_edges", with_ctes("WITH " + _EDGES_SQL + " SELECT * FROM edges"),
          ids="G1,J6,J7,T4")
def co_appearance_edges(spark, sf_dir):
    return G.co_appearance_edges(Ctx(spark, sf_dir).credits_clean, 25)


@register("co_appearance_items", with_ctes("WITH " + _EDGES_SQL + """
SELECT a.actor_name AS person_a, b.actor_name AS person_b, a.item_name AS item
FROM pairs a JOIN pairs b ON a.item_name = b.item_name AND a.actor_name < b.actor_name"""), ids="G1,J7")
def co_appearance_items(spark, sf_dir):
    return G.shared_items(Ctx(spark, sf_dir).credits_clean, 25)


@register("co_appearance_size", with_ctes("WITH " + _EDGES_SQL + """
SELECT (SELECT count(DISTINCT p) FROM (SELECT person_a AS p FROM edges UNION ALL SELECT person_b FROM edges)) AS n_nodes,
 (SELECT count(*) FROM edges) AS n_edges"""), ids="G2")
def co_appearance_size(spark, sf_dir):
    return G.graph_size(G.co_appearance_edges(Ctx(spark, sf_dir).credits_clean, 25))


# The columns of the item table and their types.
_ITEM_TYPES = {"item_id": "bigint", "item_name": "string", "year": "int", "country": "string", "type": "string", "content_rt": "string",
               "director": "string", "screenwriter": "string", "org_net": "string", "aired_on": "string", "duration": "double", "tot_eps": "double",
               "rank": "double", "pop": "double", "start_dt": "date", "end_dt": "date", "synopsis": "string"}
_CREDIT_TYPES = {"actor_id": "bigint", "actor_name": "string", "item_name": "string", "character_name": "string", "role": "string"}


def _info_sql(table: str, types: dict[str, str]) -> str:
    return with_ctes(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null FROM {table}" for c, t in types.items()))


@register("item_info", _info_sql("items", _ITEM_TYPES), ids="C10")
def item_info(spark, sf_dir):
    return P.info(Ctx(spark, sf_dir).items)


@register("credit_info", _info_sql("credits", _CREDIT_TYPES), ids="C10")
def credit_info(spark, sf_dir):
    return P.info(Ctx(spark, sf_dir).credits)


_REVIEW_TYPES = {"user_id": "string", "title": "string", "overall_score": "double", "story_score": "double", "acting_cast_score": "double",
                 "music_score": "double", "rewatch_value_score": "double", "n_helpful": "bigint", "ep_watched": "string", "review_text": "string"}


@register("review_info", _info_sql("reviews", _REVIEW_TYPES), ids="C10")
def review_info(spark, sf_dir):
    return P.info(Ctx(spark, sf_dir).reviews)


@register("price_density", """
WITH v AS (SELECT CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem WHERE l_extendedprice IS NOT NULL),
s AS (SELECT count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM v),
g AS (SELECT i AS point, lo + i * (hi - lo) / 49 AS x, n, sd * pow(CAST(n AS DOUBLE), -0.2) AS h FROM range(0, 50) r(i) CROSS JOIN s WHERE sd > 0)
SELECT 'l_extendedprice' AS column_name, CAST(point AS INTEGER) AS point, round(x, 6) AS x,
 round(sum(exp(-pow((x - v) / h, 2) / 2)) / any_value(n), 4) AS kernel_mean FROM g CROSS JOIN v GROUP BY point, x""", ids="A17")
def price_density(spark, sf_dir):
    """Density of a continuous column (nearly every value differs), as the mean kernel height at 50 points."""
    d = P.binned_density(Ctx(spark, sf_dir).t.lineitem, ["l_extendedprice"], points=50)
    return d.select("column_name", "point", S.r6("x").alias("x"), F.round("kernel_mean", 4).alias("kernel_mean"))


@register("brand_users_sketch", with_ctes("""
WITH b AS (SELECT p.p_brand AS brand, p.p_type AS maker, r.user_id FROM reviews_clean r JOIN name_lookup n ON n.name_key = r.title JOIN part p ON p.p_partkey = n.item_id)
SELECT 'brand' AS level, brand AS name, count(DISTINCT user_id) AS exact, true AS within_bound FROM b GROUP BY brand
UNION ALL SELECT 'type', maker, count(DISTINCT user_id), true FROM b GROUP BY maker
UNION ALL SELECT 'all', 'all', count(DISTINCT user_id), true FROM b"""), ids="A5")
def brand_users_sketch(spark, sf_dir):
    """Distinct reviewers per brand from written sketches, merged to types and to the total without the rows, next to exact counts."""
    from ..operators import clean as C
    from ..session import materialize
    c = Ctx(spark, sf_dir)
    brands = C.name_lookup(c.item_keys).join(c.t.part, F.col("item_id") == F.col("p_partkey")).select(
        F.col("name_key").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("maker"))
    rows = c.reviews_clean_core.select("title", "user_id").join(brands, "title")
    held = materialize(P.distinct_sketches(rows, ["brand", "maker"], "user_id"), "user-sketches")
    out = []
    for level, keys in (("brand", ["brand"]), ("type", ["maker"]), ("all", [])):
        name = F.col(keys[0]) if keys else F.lit("all")
        exact = rows.groupBy(name.alias("name")).agg(F.count_distinct("user_id").alias("exact"))
        merged = P.merged_distinct(held, keys).select(name.alias("name"), "estimate")
        near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * P.SKETCH_BOUND)
        out.append(exact.join(merged, "name").select(F.lit(level).alias("level"), "name", "exact", near.alias("within_bound")))
    return out[0].union(out[1]).union(out[2])


@register("item_preview", with_ctes("""
SELECT item_id, item_name FROM items ORDER BY md5('42|' || CAST(item_id AS VARCHAR)), item_id LIMIT 5"""),
          ids="C11")
def item_preview(spark, sf_dir):
    return P.preview(Ctx(spark, sf_dir).item_keys, "item_id", 5).select("item_id", "item_name")
