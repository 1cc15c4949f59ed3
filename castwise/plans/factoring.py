"""Ratings, encoding and factorisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import factor as FA
from ..operators import hybrid as H
from ..operators import similarity as SIM
from ..session import materialize
from .catalog import Ctx, register
from .recs import ALPHA, ASK_EVERY, POOL, TOP_N, asked_content, asked_keys, content_pool, shared_sample
from .recs import _BLEND_SQL as BLEND_SQL
from .recs import RECS_CTES
from .sqlbase import md5_bucket, norm, with_ctes


@register("key_index", with_ctes("""
SELECT title, CAST(dense_rank() OVER (ORDER BY title) - 1 AS BIGINT) AS idx
FROM (SELECT DISTINCT title FROM reviews_clean WHERE user_id IS NOT NULL AND title IS NOT NULL
      AND overall_score IS NOT NULL AND NOT isnan(overall_score))"""), ids="M2")
def key_index(spark, sf_dir):
    r = Ctx(spark, sf_dir).reviews_clean_core.select("user_id", "title", "overall_score").na.drop()
    return FA.dense_index(r, "title", "idx")


@register("ratings_summed", with_ctes("""
SELECT user_id, title, sum(overall_score) AS score_sum, count(*) AS n FROM reviews_clean
WHERE user_id IS NOT NULL AND title IS NOT NULL AND overall_score IS NOT NULL GROUP BY 1, 2"""), ids="A25,C5")
def ratings_summed(spark, sf_dir):
    r = Ctx(spark, sf_dir).reviews_clean_core.select("user_id", "title", "overall_score").na.drop()
    return FA.summed_ratings(r)


def _fit(c: Ctx, k: int = 50):
    """The factor model as a stage: fitted once per input folder and reused
    (its tables are written under the checkpoint dir)."""
    from ..session import stage
    return stage(c.spark, ("svd", c.sf_dir, k), c.inputs(), lambda: FA.fit_svd(c.reviews_clean_core, k=k))


@register("svd_factors", None, ids="M3")
def svd_factors(spark, sf_dir):
    f = _fit(Ctx(spark, sf_dir))
    rows = [(i, s) for i, s in enumerate(f.sigma)]
    sig = spark.createDataFrame(rows, "component int, sigma double")
    dims = spark.createDataFrame([(f.n_users, f.n_titles)], "n_users long, n_titles long")
    return sig.crossJoin(dims)


@register("svd_check", with_ctes("""
WITH r AS (SELECT DISTINCT user_id, title FROM reviews_clean WHERE user_id IS NOT NULL AND title IS NOT NULL AND overall_score IS NOT NULL),
d AS (SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT title) AS n_titles FROM r)
SELECT CAST(i AS INTEGER) AS component, n_users, n_titles, 1.0::DOUBLE AS normal, true AS descending,
 0.0::DOUBLE AS residual_us, 0.0::DOUBLE AS residual_v, 0.0::DOUBLE AS off_diagonal
FROM d CROSS JOIN range(0, 50) s(i) WHERE i < n_titles - 1"""), ids="M3")
def svd_check(spark, sf_dir):
    """What makes the written factors a truncated SVD, per component, by plain
    joins over the training entries: X v = U sigma, X^T X v = sigma^2 v, V^T V = I."""
    return FA.factor_check(_fit(Ctx(spark, sf_dir)))


_BY_BRAND = """
SELECT user_id, p.p_brand AS brand, sum(overall_score) AS v FROM reviews_clean r JOIN name_lookup n ON n.name_key = r.title
JOIN part p ON p.p_partkey = n.item_id WHERE user_id IS NOT NULL AND overall_score IS NOT NULL GROUP BY 1, 2"""


@register("svd_energy", with_ctes(f"""
WITH e AS ({_BY_BRAND})
SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT brand) AS n_brands, count(*) AS entries, round(sum(v * v), 2) AS energy,
 round(sum(v * v), 2) AS sigma_energy FROM e"""), ids="M3")
def svd_energy(spark, sf_dir):
    """All singular values of the user x brand matrix: their squares add up to the squared entries."""
    from ..operators import clean as C
    from ..operators.tallskinny import truncated_svd
    c = Ctx(spark, sf_dir)
    r = c.reviews_clean_core.select("user_id", "title", "overall_score").na.drop()
    brands = C.name_lookup(c.item_keys).join(c.t.part, F.col("item_id") == F.col("p_partkey")).select(F.col("name_key").alias("title"), F.col("p_brand").alias("brand"))
    e = materialize(r.join(brands, "title").groupBy("user_id", "brand").agg(F.sum("overall_score").alias("v")), "brand-entries")
    u, b = FA.dense_index(e, "user_id", "u"), FA.dense_index(e, "brand", "b")
    n = e.agg(F.countDistinct("user_id").alias("u"), F.countDistinct("brand").alias("b"), F.count(F.lit(1)).alias("n"), F.sum(F.col("v") * F.col("v")).alias("s")).first()
    sigma = truncated_svd(e.join(u, "user_id").join(b, "brand"), "u", "b", "v", n.u, n.b, n.b)[2] if n.n else []
    return spark.createDataFrame([(n.u, n.b, n.n, round(float(n.s or 0), 2), round(sum(s * s for s in sigma), 2))],
                                 "n_users long, n_brands long, entries long, energy double, sigma_energy double")


@register("svd_item_factors", None, ids="M3")
def svd_item_factors(spark, sf_dir):
    f = _fit(Ctx(spark, sf_dir))
    return f.item_factors.join(f.titles, "t").select("title", F.transform("vf", lambda x: F.round(x, 6)).alias("factors"))


@register("svd_user_factors", None, ids="M3")
def svd_user_factors(spark, sf_dir):
    f = _fit(Ctx(spark, sf_dir))
    return f.user_factors.join(f.users, "u").select("user_id", F.transform("uf", lambda x: F.round(x, 6)).alias("factors"))


@register("holdout_rmse", None, ids="M6,J13,F10,F20,A21")
def holdout_rmse(spark, sf_dir):
    return FA.error_report(FA.predictions(_fit(Ctx(spark, sf_dir))))


@register("explained_variance", None, ids="A24")
def explained_variance(spark, sf_dir):
    return FA.explained_variance(_fit(Ctx(spark, sf_dir)))


# A model with stated factors: every number follows from the dense indices, so
# that SQL can follow the steps after the factorisation (prediction, errors,
# explained variance, neighbours, blend, evaluation) digit by digit.

STATED_K = 4
_STATED_CTES = {
    "rr": "SELECT user_id, title, overall_score FROM reviews_clean WHERE user_id IS NOT NULL AND title IS NOT NULL AND overall_score IS NOT NULL",
    "ui": "SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS u FROM (SELECT DISTINCT user_id FROM rr)",
    "ti": "SELECT title, dense_rank() OVER (ORDER BY title) - 1 AS t FROM (SELECT DISTINCT title FROM rr)",
    "uf": f"SELECT u, i AS c, ((u * 7 + i * 3) % 11) / 5.0E0 AS x FROM ui CROSS JOIN range(0, {STATED_K}) s(i) WHERE u % 97 <> 5",
    "vf": f"SELECT t, i AS c, ((t * 5 + i * i) % 13 - 3) / 4.0E0 AS x FROM ti CROSS JOIN range(0, {STATED_K}) s(i) WHERE t % 89 <> 7",
    "parts": f"SELECT rr.*, u, t, {md5_bucket("concat_ws('|', user_id, title, overall_score)")} < 100 AS is_test FROM rr JOIN ui USING (user_id) JOIN ti USING (title)",
    "preds": """
SELECT user_id, title, overall_score AS actual, least(greatest(coalesce(dot, 0.0), 1), 10) AS pred FROM parts
LEFT JOIN (SELECT u, t, sum(a.x * b.x) AS dot FROM (SELECT DISTINCT u, t FROM parts WHERE is_test) p JOIN uf a USING (u) JOIN vf b USING (t) WHERE a.c = b.c GROUP BY u, t) USING (u, t)
WHERE is_test""",
}


def _stated_sql(body: str, **more: str) -> str:
    return with_ctes(body, {**RECS_CTES, **_STATED_CTES, **more})


def _stated(c: Ctx) -> FA.Factors:
    """The factor model's tables with stated numbers in place of fitted ones; a few users and titles have no factors."""
    from ..session import stage

    def build():
        e = FA.encode_ratings(c.reviews_clean_core)
        number = lambda n: F.array(*n)
        uf = e.users.where("u % 97 <> 5").select("u", number([(F.col("u") * 7 + i * 3) % 11 / 5.0 for i in range(STATED_K)]).alias("uf"))
        vf = e.titles.where("t % 89 <> 7").select("t", number([((F.col("t") * 5 + i * i) % 13 - 3) / 4.0 for i in range(STATED_K)]).alias("vf"))
        return FA.Factors(e.users, e.titles, materialize(uf, "stated-users"), materialize(vf, "stated-titles"), [1.0] * STATED_K, 0.0,
                          e.n_users, e.n_titles, e.train, e.test)
    return stage(c.spark, ("stated-factors", c.sf_dir), c.inputs(), build)


@register("stated_predictions", _stated_sql("SELECT user_id, title, actual, round(pred, 6) AS pred FROM preds"), ids="M6,J13,F10")
def stated_predictions(spark, sf_dir):
    return FA.predictions(_stated(Ctx(spark, sf_dir))).withColumn("pred", S.r6("pred"))


@register("stated_errors", _stated_sql("""
SELECT round(sqrt(avg((actual - pred) * (actual - pred))), 6) AS rmse, round(avg(abs(actual - pred)), 6) AS mae, count(*) AS n FROM preds"""), ids="A21,F20,M6")
def stated_errors(spark, sf_dir):
    r = FA.error_report(FA.predictions(_stated(Ctx(spark, sf_dir))))
    return r.select(S.r6("rmse").alias("rmse"), S.r6("mae").alias("mae"), "n")


@register("stated_variance", _stated_sql(f"""
SELECT {STATED_K} AS k, round(ev, 6) AS explained, round(tv, 6) AS total, round(ev / tv, 6) AS explained_variance_ratio FROM
(SELECT sum(s2 / n - (s1 / n) ** 2) AS ev FROM (SELECT c, sum(x * x) AS s2, sum(x) AS s1 FROM uf GROUP BY c), (SELECT count(*) AS n FROM ui)),
(SELECT sum(s2 / n - (s1 / n) ** 2) AS tv FROM (SELECT t, sum(v * v) AS s2, sum(v) AS s1 FROM
  (SELECT u, t, sum(overall_score) AS v FROM parts WHERE NOT is_test GROUP BY u, t) GROUP BY t), (SELECT count(*) AS n FROM ui))"""), ids="A24")
def stated_variance(spark, sf_dir):
    r = FA.explained_variance(_stated(Ctx(spark, sf_dir)))
    return r.select("k", *(S.r6(x).alias(x) for x in ("explained", "total", "explained_variance_ratio")))


_CF_CTES = {
    "cfdot": """
SELECT q.query_key, ti.title AS rec_key, d.score FROM (SELECT DISTINCT query_key FROM sample) q JOIN ti qt ON qt.title = q.query_key
JOIN (SELECT a.t AS qt, b.t, sum(a.x * b.x) AS score FROM vf a JOIN vf b ON a.c = b.c AND a.t <> b.t
  WHERE a.t IN (SELECT t FROM ti JOIN sample ON title = query_key) GROUP BY 1, 2) d ON d.qt = qt.t JOIN ti ON ti.t = d.t""",
    "cfk": """
SELECT query_key, rec_key, rec_key AS name, score,
 CAST(row_number() OVER (PARTITION BY query_key ORDER BY round(score, 9) DESC, rec_key) AS INTEGER) AS rank FROM cfdot""",
}
_ASKED = f"SELECT item_id AS sid, {norm('item_name')} AS query_key FROM items WHERE item_id % {ASK_EVERY} = 0"


def _stated_cf_sql(body: str, sample: str | None = None) -> str:
    """The neighbour SQL with the stated factors' inner products in place of the co-review counts."""
    own = {**RECS_CTES, "sample": sample or RECS_CTES["sample"], **_STATED_CTES}
    order = [k for k in own if k != "cfk"]
    at = order.index("srecs")
    ctes = {k: own[k] for k in order[:at]} | {k: own[k] for k in _STATED_CTES} | _CF_CTES | {k: own[k] for k in order[at:]}
    return with_ctes(body, ctes)


@register("stated_neighbors", _stated_cf_sql(f"SELECT query_key, rank, rec_key, round(score, 6) AS score FROM cfk WHERE rank <= {TOP_N}", _ASKED), ids="M5,T5")
def stated_neighbors(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return cf_recs(c, _stated(c), asked_keys(c), TOP_N).select("query_key", "rank", "rec_key", S.r6("score").alias("score"))


@register("stated_hybrid", _stated_cf_sql(BLEND_SQL + f"""
SELECT query_key, rank, rec_key, name, round(cb_score, 6) AS cb_score, round(cf_score, 6) AS cf_score,
 round(hybrid_score, 6) AS hybrid_score FROM r WHERE rank <= {TOP_N}""", _ASKED), ids="M7,U6")
def stated_hybrid(spark, sf_dir):
    """The real blend (content and factor model) over stated factors."""
    c = Ctx(spark, sf_dir)
    b = blended(c, _stated(c))
    return b.select("query_key", "rank", "rec_key", "name", *[S.r6(x).alias(x) for x in ("cb_score", "cf_score", "hybrid_score")])


def cf_recs(c: Ctx, f: FA.Factors, query_keys, top_n: int):
    """M5: item-factor dot products (not cosine) for the query titles."""
    q = (query_keys.select(F.col("query_key").alias("title")).distinct()
         .join(f.titles, "title").select(F.col("t").alias("qid"), F.col("title").alias("query_key")))
    nb = SIM.dot_dense(f.item_factors, q.select("qid"), top_n, id_col="t", vec_col="vf")
    names = f.titles.select(F.col("t").alias("id"), F.col("title").alias("rec_key"))
    return nb.join(q, "qid").join(names, "id").select(
        "query_key", "rank", "rec_key", F.col("rec_key").alias("name"), "score")


@register("collaborative_neighbors", None, ids="M5,T5,J9")
def collaborative_neighbors(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    f = _fit(c)
    return cf_recs(c, f, asked_keys(c), TOP_N).select(
        "query_key", "rank", "rec_key", S.r6("score").alias("score"))


@register("factor_model_summary", None, ids="M14,U6")
def factor_model_summary(spark, sf_dir):
    """One evaluation row per (model, k) of the factor model and its blend
    with the content model, through the same evaluation as the others."""
    from functools import reduce

    from ..operators import ranking as R
    from .recs import shared_relevance
    c = Ctx(spark, sf_dir)
    f, s, rel = _fit(c), shared_sample(c), shared_relevance(c)
    cf = materialize(cf_recs(c, f, s, POOL), "factor_pool")
    hy = H.blend(content_pool(c).select("query_key", "rec_key", "name", "score"), cf.select("query_key", "rec_key", "score"), ALPHA, TOP_N)
    rows = [R.evaluate(s, recs.select("query_key", "rank", "rec_key"), rel, c.item_keys, k).select(F.lit(m).alias("model"), "*")
            for m, recs in (("collaborative", cf), ("hybrid", hy)) for k in (5, TOP_N)]
    return reduce(lambda a, b: a.unionByName(b), rows)


def blended(c: Ctx, f: FA.Factors):
    """M7 for the asked items: content pool and factor pool, blended."""
    cb = asked_content(c).select("query_key", "rec_key", "name", "score")
    cf = cf_recs(c, f, asked_keys(c), POOL).select("query_key", "rec_key", "score")
    return H.blend(cb, cf, ALPHA, TOP_N)


@register("hybrid_recommend", None, ids="M7")
def hybrid_recommend(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return blended(c, _fit(c))
