"""Similarity, relevance, ranking and blend queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import clean as C
from ..operators import hybrid as H
from ..operators import ranking as R
from ..operators import similarity as SIM
from .catalog import Ctx, register
from .featuring import FEATURE_CTES
from .sqlbase import norm, with_ctes

SAMPLE_N = 50    # the evaluation sample of the ranking reports
ASK_EVERY = 100  # neighbours are asked for every item whose id is divisible by this
TOP_N = 10
POOL = 50
ALPHA = 0.5


# ------------------------------------------------------------ Spark side

def sample_keys(c: Ctx, n: int = SAMPLE_N):
    """(sid, query_key): the evaluation sample of catalog rows."""
    s = SIM.sample_queries(c.item_keys, n)
    return s.select(F.col("item_id").alias("sid"), S.norm_key("item_name").alias("query_key"))


def asked_keys(c: Ctx, every: int = ASK_EVERY):
    """(sid, query_key): the catalog rows whose neighbours are asked for."""
    return c.item_keys.where(F.col("item_id") % every == 0).select(F.col("item_id").alias("sid"), S.norm_key("item_name").alias("query_key"))


def content_index(c: Ctx):
    """The catalog's packed features and their cells, written once: every query set asks the same ones."""
    from ..session import stage
    return stage(c.spark, ("content_index", c.sf_dir), c.inputs(), lambda: SIM.cosine_index(c.features, c.item_keys))


def content_recs(c: Ctx, query_keys, top_n: int):
    """Content model for a set of query keys: (query_key, rank, rec_key, name, score, id)."""
    qmap = (query_keys.select("query_key").distinct()
            .join(C.name_lookup(c.item_keys), F.col("query_key") == F.col("name_key"))
            .select("query_key", F.col("item_id").alias("qid")))
    nb = SIM.nearest(*content_index(c), qmap.select("qid"), top_n)
    return (nb.join(qmap, "qid")  # size left to AQE: the caller's query set
            .select("query_key", "qid", "rank", S.norm_key("name").alias("rec_key"), "name", "score", "id"))


def corev_recs(c: Ctx, query_keys, top_n: int):
    sc = R.co_review_scores(c.reviews_clean_core, query_keys)
    w = Window.partitionBy("query_key").orderBy(F.col("score").desc(), "rec_key")
    return (sc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
            .withColumn("name", F.col("rec_key")))


# Stage tables shared by the evaluation, blend and log queries: the sample,
# its relevance sets and both candidate pools (|queries| x POOL rows each) are
# written once per input folder; top-n lists are their rank <= n prefixes. The
# sample and the asked items have pools of their own: the sample's 50 rows need
# not wait for a query set that grows with the catalog.

def _stage(c: Ctx, name: str, build):
    from ..session import materialize, stage
    return stage(c.spark, (name, c.sf_dir), c.inputs(), lambda: materialize(build(), name))


def shared_sample(c: Ctx):
    return _stage(c, "sample", lambda: sample_keys(c))


def shared_relevance(c: Ctx):
    return _stage(c, "relevance", lambda: R.co_review_relevance(c.reviews_clean_core, shared_sample(c)))


def content_pool(c: Ctx):
    return _stage(c, "content_pool", lambda: content_recs(c, shared_sample(c), POOL))


def corev_pool(c: Ctx):
    return _stage(c, "co_review_pool", lambda: corev_recs(c, shared_sample(c), POOL))


def asked_content(c: Ctx):
    return _stage(c, "asked_content", lambda: content_recs(c, asked_keys(c), POOL))


def asked_corev(c: Ctx):
    return _stage(c, "asked_co_review", lambda: corev_recs(c, asked_keys(c), POOL))


# ------------------------------------------------------------ SQL side

RECS_CTES = dict(FEATURE_CTES)
RECS_CTES.update({
    "sample": f"""
SELECT item_id AS sid, {norm('item_name')} AS query_key FROM items
ORDER BY md5('42|' || CAST(item_id AS VARCHAR)), item_id LIMIT {SAMPLE_N}""",
    "qmap": """
SELECT DISTINCT s.query_key, n.item_id AS qid FROM sample s JOIN name_lookup n ON n.name_key = s.query_key""",
    "fnorms": "SELECT item_id, sqrt(sum(value * value)) AS norm FROM features GROUP BY item_id",
    "fdots": """
SELECT q.qid, f.item_id AS id, sum(f.value * g.value) AS dot
FROM (SELECT DISTINCT qid FROM qmap) q JOIN features g ON g.item_id = q.qid
JOIN features f ON f.feature = g.feature GROUP BY 1, 2""",
    "cands": """
SELECT q.qid, i.item_id AS id, i.item_name AS name,
 CASE WHEN coalesce(nq.norm, 0) = 0 OR coalesce(ni.norm, 0) = 0 THEN 0.0
      ELSE coalesce(d.dot, 0) / (nq.norm * ni.norm) END AS score
FROM (SELECT DISTINCT qid FROM qmap) q CROSS JOIN items i
LEFT JOIN fdots d ON d.qid = q.qid AND d.id = i.item_id
LEFT JOIN fnorms nq ON nq.item_id = q.qid LEFT JOIN fnorms ni ON ni.item_id = i.item_id
WHERE i.item_id <> q.qid""",
    "cb_ranked": """
SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, name NULLS LAST, id) AS INTEGER) AS rank
FROM cands""",
    "cbk": f"""
SELECT m.query_key, r.rank, {norm('r.name')} AS rec_key, r.name, r.score, r.id
FROM cb_ranked r JOIN qmap m ON m.qid = r.qid WHERE r.rank <= {POOL}""",
    "ut": "SELECT DISTINCT user_id, title FROM reviews_clean WHERE user_id IS NOT NULL AND title IS NOT NULL",
    "qusers": """
SELECT DISTINCT k.query_key, ut.user_id FROM ut JOIN (SELECT DISTINCT query_key FROM sample) k ON ut.title = k.query_key""",
    "corev": """
SELECT q.query_key, u.title AS rec_key, CAST(count(*) AS DOUBLE) AS score
FROM qusers q JOIN ut u ON u.user_id = q.user_id WHERE u.title <> q.query_key GROUP BY 1, 2""",
    "rel": "SELECT DISTINCT query_key, rec_key AS rel_key FROM corev",
    "cfk": """
SELECT query_key, rec_key, rec_key AS name, score,
 CAST(row_number() OVER (PARTITION BY query_key ORDER BY score DESC, rec_key) AS INTEGER) AS rank FROM corev""",
    "srecs": f"SELECT s.sid, r.rank, r.rec_key FROM sample s JOIN cbk r ON r.query_key = s.query_key WHERE r.rank <= {TOP_N}",
    "srel": "SELECT s.sid, r.rel_key FROM sample s JOIN rel r ON r.query_key = s.query_key",
    "hits": """
SELECT r.sid, r.rank, r.rec_key, CASE WHEN x.rel_key IS NULL THEN 0 ELSE 1 END AS hit
FROM srecs r LEFT JOIN (SELECT DISTINCT sid, rel_key FROM srel) x ON x.sid = r.sid AND x.rel_key = r.rec_key""",
    "per": """
SELECT sid, sum(hit) AS hits, sum(hit / log2(rank + 1)) AS dcg,
 sum(CASE WHEN hit = 1 THEN cum / rank ELSE 0 END) AS ap_sum FROM (
 SELECT *, sum(hit) OVER (PARTITION BY sid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
 FROM hits) GROUP BY sid""",
    "metrics": f"""
SELECT p.sid, coalesce(n.n_relevant, 0) AS n_relevant, p.hits / {float(TOP_N)} AS precision,
 CASE WHEN coalesce(n.n_relevant, 0) = 0 THEN 0.0 ELSE p.hits / n.n_relevant END AS recall,
 CASE WHEN coalesce(n.n_relevant, 0) = 0 THEN 0.0 ELSE p.dcg / list_sum(list_transform(
   range(1, least(n.n_relevant, {TOP_N}) + 1), lambda i: 1.0 / log2(i + 1))) END AS ndcg,
 CASE WHEN coalesce(n.n_relevant, 0) = 0 THEN 0.0 ELSE p.ap_sum / least(n.n_relevant, {TOP_N}) END AS ap
FROM per p LEFT JOIN (SELECT sid, count(DISTINCT rel_key) AS n_relevant FROM srel GROUP BY sid) n ON n.sid = p.sid""",
})


def rsql(body: str) -> str:
    return with_ctes(body, RECS_CTES)


def asql(body: str) -> str:
    """As ``rsql``, for the asked items in place of the sample."""
    asked = f"SELECT item_id AS sid, {norm('item_name')} AS query_key FROM items WHERE item_id % {ASK_EVERY} = 0"
    return with_ctes(body, {**RECS_CTES, "sample": asked})


# ------------------------------------------------------------ queries

@register("content_neighbors", asql(f"""
SELECT qid, rank, id, name, round(score, 6) AS score FROM cb_ranked WHERE rank <= {TOP_N}"""),
          ids="M4,T5,J9,J11,J12,C17")
def content_neighbors(spark, sf_dir):
    nb = asked_content(Ctx(spark, sf_dir)).where(F.col("rank") <= TOP_N)
    return nb.select("qid", "rank", "id", "name", S.r6("score").alias("score")).distinct()


@register("missing_name_neighbors", asql(f"""
SELECT m.query_key, r.rank, r.id FROM cb_ranked r JOIN qmap m ON m.qid = r.qid
WHERE r.rank <= {TOP_N} AND starts_with(m.query_key, 'no such title ')"""), ids="J12")
def missing_name_neighbors(spark, sf_dir):
    """Names that the catalog does not hold: an empty result with its types."""
    c = Ctx(spark, sf_dir)
    q = asked_keys(c).select(F.concat(F.lit("no such title "), F.col("query_key")).alias("query_key"))
    return content_recs(c, q, TOP_N).select("query_key", "rank", "id")


@register("embedding_neighbors", with_ctes(f"""
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
n AS (SELECT id, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS nrm FROM e),
u AS (SELECT id, CASE WHEN nrm = 0 THEN vec ELSE list_transform(vec, lambda x: x / nrm) END AS vec FROM n),
q AS (SELECT id AS qid, vec AS qvec FROM u WHERE id % {ASK_EVERY} = 0),
s AS (SELECT qid, id, list_sum(list_transform(list_zip(qvec, vec), lambda p: p[1] * p[2])) AS score
      FROM q CROSS JOIN u WHERE qid <> id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM s)
SELECT qid, rank, id, round(score, 6) AS score FROM r WHERE rank <= {TOP_N}"""), ids="M4,T5")
def embedding_neighbors(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    e = c.t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    nb = SIM.dot_dense(e, e.where(F.col("id") % ASK_EVERY == 0).select(F.col("id").alias("qid")), TOP_N, cosine=True)
    return nb.select("qid", "rank", "id", S.r6("score").alias("score"))


@register("embedding_lsh_recall", f"""
SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % {ASK_EVERY} = 0""", ids="M4")
def embedding_lsh_recall(spark, sf_dir):
    """Recall of the approximate neighbours against the exact ones: at least 0.9 of them are found."""
    from ..operators import lsh
    from ..operators import neighbors as NB
    c = Ctx(spark, sf_dir)
    v = NB.pack_dense(c.t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), unit=True)
    q = v.table.where(F.col("id") % ASK_EVERY == 0).select(F.col("id").alias("qid"))
    r = lsh.recall(lsh.BucketTables(v).nearest(q, TOP_N), NB.nearest(v, q, TOP_N)[0])
    return r.select("queries", (F.col("recall") >= 0.9).alias("reached"))


@register("co_review_relevance", rsql("SELECT query_key, rel_key FROM rel"), ids="J8,U1,U3")
def co_review_relevance(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return shared_relevance(c)


@register("co_review_neighbors", asql(f"""
SELECT query_key, rank, rec_key, score FROM cfk WHERE rank <= {TOP_N}"""), ids="J8,T5")
def co_review_neighbors(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return asked_corev(c).where(F.col("rank") <= TOP_N).select("query_key", "rank", "rec_key", "score")


@register("ranking_per_query", rsql("""
SELECT sid, n_relevant, round(precision, 6) AS precision, round(recall, 6) AS recall,
 round(ndcg, 6) AS ndcg, round(ap, 6) AS ap FROM metrics"""), ids="M8-M11,T7,T8,U2")
def ranking_per_query(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    s = shared_sample(c)
    recs = content_pool(c).where(F.col("rank") <= TOP_N)
    rel = shared_relevance(c)
    srecs = s.join(recs, "query_key").select("sid", "rank", "rec_key")
    srel = s.join(rel, "query_key").select("sid", "rel_key")
    m = R.per_query_metrics(srecs, srel, TOP_N)
    return m.select("sid", "n_relevant", *[S.r6(x).alias(x) for x in ("precision", "recall", "ndcg", "ap")])


@register("ranking_report", rsql(f"""
SELECT {TOP_N} AS k,
 round(coalesce(avg(precision) FILTER (WHERE n_relevant > 0), 0), 6) AS precision_at_k,
 round(coalesce(avg(recall) FILTER (WHERE n_relevant > 0), 0), 6) AS recall_at_k,
 round(coalesce(avg(ndcg) FILTER (WHERE n_relevant > 0), 0), 6) AS ndcg_at_k,
 round(coalesce(avg(ap) FILTER (WHERE n_relevant > 0), 0), 6) AS ap_at_k,
 round((SELECT count(DISTINCT rec_key) FROM srecs) / (SELECT count(*) FROM items), 6) AS catalog_coverage,
 count(*) FILTER (WHERE n_relevant > 0) AS queries_evaluated FROM metrics"""), ids="M12,M14,A20,U4")
def ranking_report(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    s = shared_sample(c)
    recs = content_pool(c).where(F.col("rank") <= TOP_N).select("query_key", "rank", "rec_key")
    rel = shared_relevance(c)
    return R.evaluate(s, recs, rel, c.item_keys, TOP_N)


@register("list_diversity", rsql(f"""
WITH l AS (SELECT qid AS sid, rank, id FROM cb_ranked WHERE rank <= {TOP_N}),
p AS (SELECT a.sid, a.id AS a, b.id AS b FROM l a JOIN l b ON a.sid = b.sid AND a.rank < b.rank),
d AS (SELECT p.sid, p.a, p.b, sum(fa.value * fb.value) AS dot FROM p JOIN features fa ON fa.item_id = p.a
      JOIN features fb ON fb.item_id = p.b AND fb.feature = fa.feature GROUP BY ALL),
c AS (SELECT p.sid, CASE WHEN coalesce(na.norm, 0) = 0 OR coalesce(nb.norm, 0) = 0 THEN 0.0
        ELSE coalesce(d.dot, 0) / (na.norm * nb.norm) END AS cos
      FROM p LEFT JOIN d ON d.sid = p.sid AND d.a = p.a AND d.b = p.b
      LEFT JOIN fnorms na ON na.item_id = p.a LEFT JOIN fnorms nb ON nb.item_id = p.b)
SELECT s.sid, round(coalesce(x.diversity, 0), 6) AS diversity FROM (SELECT DISTINCT sid FROM l) s
LEFT JOIN (SELECT sid, avg(1 - cos) AS diversity FROM c GROUP BY sid) x ON x.sid = s.sid"""), ids="M13")
def list_diversity(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    fs = c.features
    nb = content_pool(c).where(F.col("rank") <= TOP_N)
    d = R.list_diversity(nb.select(F.col("qid").alias("sid"), "rank", F.col("id").alias("item_id"))
                         .withColumnRenamed("item_id", "id"), fs, catalog=c.item_keys)
    return d.select("sid", S.r6("diversity").alias("diversity"))


_BLEND_SQL = f"""
WITH a AS (SELECT query_key, rec_key, name AS cb_name,
   CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.0
        ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS cb_score
   FROM cbk WINDOW w AS (PARTITION BY query_key)),
b AS (SELECT query_key, rec_key,
   CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.0
        ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS cf_score
   FROM cfk WHERE rank <= {POOL} WINDOW w AS (PARTITION BY query_key)),
j AS (SELECT coalesce(a.query_key, b.query_key) AS query_key, coalesce(a.rec_key, b.rec_key) AS rec_key,
   coalesce(a.cb_name, b.rec_key) AS name, coalesce(a.cb_score, 0.0) AS cb_score, coalesce(b.cf_score, 0.0) AS cf_score
   FROM a FULL OUTER JOIN b ON a.query_key = b.query_key AND a.rec_key = b.rec_key),
h AS (SELECT *, {ALPHA} * cb_score + {1 - ALPHA} * cf_score AS hybrid_score FROM j),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_key ORDER BY round(hybrid_score, 9) DESC, rec_key, name) AS INTEGER) AS rank FROM h)"""


@register("hybrid_blend", asql(_BLEND_SQL + f"""
SELECT query_key, rank, rec_key, name, round(cb_score, 6) AS cb_score, round(cf_score, 6) AS cf_score,
 round(hybrid_score, 6) AS hybrid_score FROM r WHERE rank <= {TOP_N}"""), ids="M7,A19,J3,F11")
def hybrid_blend(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    cb = asked_content(c).select("query_key", "rec_key", "name", "score")
    cf = asked_corev(c).select("query_key", "rec_key", "score")
    b = H.blend(cb, cf, ALPHA, TOP_N)
    return b.select("query_key", "rank", "rec_key", "name",
                    *[S.r6(x).alias(x) for x in ("cb_score", "cf_score", "hybrid_score")])


@register("recommendation_records", asql(_BLEND_SQL + f"""
SELECT query_key, 'hybrid' AS model, {TOP_N} AS top_n,
 list(struct_pack(name := name, score := round(hybrid_score, 6)) ORDER BY rank) AS recommendations
FROM r WHERE rank <= {TOP_N} GROUP BY query_key"""), ids="O1")
def recommendation_records(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    cb = asked_content(c).select("query_key", "rec_key", "name", "score")
    cf = asked_corev(c).select("query_key", "rec_key", "score")
    b = H.blend(cb, cf, ALPHA, TOP_N).select("query_key", "rank", "name", S.r6("hybrid_score").alias("score"))
    return H.records(b, "hybrid", TOP_N)
