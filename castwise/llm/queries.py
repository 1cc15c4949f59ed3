"""Thin queries: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, decontaminate, langid, licenses, merkle, packing, quality, sharding, simhash, topk, toxicity
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


_OP1_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
item AS (SELECT item_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS g, least(len(w), 10) AS n
    FROM item, unnest(generate_series(1, greatest(len(w) - 9, least(len(w), 1)))) AS s(i)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS g FROM doc, sizes, unnest(generate_series(1, len(w) - n + 1)) AS s(i)),
hit AS (SELECT r, i, occ.n, item_id FROM occ JOIN win ON occ.n = win.n AND occ.g = win.g),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(i, i + n - 1)) AS s(p) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS k FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(k, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""


@_query("op1_decontaminate", _OP1_SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@_query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


@_query("op3_simhash_golay")
def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(read_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@_query("op5_licenses", licenses.oracle())
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


@_query("op6_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(coalesce(x, 0))))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@_query("op7_perspectives", """
WITH t AS (SELECT DISTINCT conv_id, turn, role AS speaker, text FROM conversations WHERE conv_id IS NOT NULL),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS NOT NULL AND speaker <> 'system'),
marked AS (SELECT t.*, perspective, coalesce(speaker = perspective, false) AS is_target,
    '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' WHEN speaker IS NULL THEN 'user'
        ELSE 'user name=' || replace(speaker, '<|', '< |') END || chr(10) AS mark
    FROM t JOIN who USING (conv_id)),
made AS (SELECT *, mark || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS segment FROM marked),
placed AS (SELECT *, row_number() OVER w - 1 AS position, sum(length(segment)) OVER w - length(segment) AS start FROM made
    WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, turn, speaker, segment, start::BIGINT AS start, length(segment)::BIGINT AS length, is_target,
    (CASE WHEN is_target THEN start + length(mark) ELSE 0 END)::BIGINT AS target_start,
    (CASE WHEN is_target THEN start + length(segment) ELSE 0 END)::BIGINT AS target_end FROM placed
""")
def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(read_table(spark, sf_dir, "conversations"))


@_query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of ``documents``: the source is the host, the language section its path."""
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


@_query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = packing.pack_documents(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=40)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return sharded.select("doc_id", (sharding.text_bytes(F.col("text")) + sharding.ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"),
                          F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_OP11_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_OP11_LEAF = "sha256(" + " || ".join(_OP11_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_OP11_SQL = """
WITH RECURSIVE raw AS (SELECT *, doc_id::VARCHAR AS s FROM documents),
crc AS (SELECT *, xor(4294967295, list_reduce(list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT), lambda c, b:
    list_reduce(range(8), lambda a, k: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295)) AS crc FROM raw),
f AS (SELECT doc_id, lang, """ + _OP11_LEAF.format(n="n_chars") + """ AS leaf,
    CASE WHEN crc % 7 = 0 THEN """ + _OP11_LEAF.format(n="(n_chars + 1)") + """ END AS forged FROM crc),
d AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n FROM f),
t AS (SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM d UNION ALL
    SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
g AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, h, n FROM g UNION ALL
    SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n),
gs AS (SELECT g.lang, list(CASE WHEN (g.pos >> x.lvl) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(u.h, '') ORDER BY x.lvl) AS steps
    FROM g JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) AS x ON true LEFT JOIN u ON u.lvl = x.lvl AND u.pos = xor(g.pos >> x.lvl, 1) GROUP BY g.lang),
ds AS (SELECT d.r, list(CASE WHEN (d.pos >> x.lvl) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(t.h, '') ORDER BY x.lvl) AS steps
    FROM d JOIN (SELECT DISTINCT lang, lvl FROM t WHERE n > 1) AS x ON d.lang IS NOT DISTINCT FROM x.lang
    LEFT JOIN t ON t.lang IS NOT DISTINCT FROM d.lang AND t.lvl = x.lvl AND t.pos = xor(d.pos >> x.lvl, 1) GROUP BY d.r),
p AS (SELECT doc_id, leaf, forged, g.h AS subroot, list_concat(coalesce(ds.steps, []), coalesce(gs.steps, [])) AS steps
    FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang LEFT JOIN ds USING (r) LEFT JOIN gs ON gs.lang IS NOT DISTINCT FROM d.lang),
q AS (SELECT *, list_reduce(steps, lambda h, s: CASE WHEN s[1] = 'L' THEN sha256(s[2:] || h) ELSE sha256(h || s[2:]) END, coalesce(forged, leaf)) AS folded_root FROM p)
SELECT doc_id, leaf, subroot, top.h AS root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = top.h AS verified
FROM q, (SELECT h FROM u WHERE n = 1) AS top
"""


@_query("op11_merkle", _OP11_SQL)
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents`` by language; every leaf is folded to the root, the tampered ones from their changed row."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = merkle.leaf(*(F.col(c).cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS))
    m = merkle.manifest(read_table(spark, sf_dir, "documents"), claim=F.when(tampered, changed))
    folded = m.withColumn("folded_root", merkle.fold(F.coalesce("claim", "leaf"), F.col("proof")))
    return folded.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@_query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = align.alignment(read_table(spark, sf_dir, "documents"), texts=False)
    return r.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@_query("op13_bpe")
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every whole text of ``documents``."""
    e = bpe.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), back="decoded")
    return e.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
