"""SQL building blocks for the oracle queries (DuckDB dialect).

``ROLE_CTES`` defines the three roles exactly as
:mod:`castwise.sources.roles` does; ``CLEAN_CTES`` mirrors
:mod:`castwise.operators.clean`. Oracle queries are ``with_ctes(body)``.
"""

from __future__ import annotations

_NAME = ("CASE WHEN p.p_partkey % 101 = 0 THEN concat('twin title ', CAST(p.p_partkey // 202 AS VARCHAR)) "
         "ELSE concat(p.p_name, ' ', p.p_brand, ' ', CAST(p.p_partkey AS VARCHAR)) END")

ROLE_CTES = {
    "items": f"""
SELECT p.p_partkey AS item_id, {_NAME} AS item_name,
 CAST(year(s.st) AS INTEGER) AS year, 'KR' AS country, 'series' AS type, p.p_type AS content_rt,
 CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE concat('dir ', CAST(p.p_partkey % 40 AS VARCHAR)) END AS director,
 CASE WHEN p.p_partkey % 3 = 0 THEN NULL ELSE concat('wri ', CAST(p.p_partkey % 30 AS VARCHAR)) END AS screenwriter,
 CASE WHEN p.p_partkey % 11 = 0 THEN NULL ELSE p.p_brand END AS org_net,
 CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE substr('MonTueWedThuFriSatSun', CAST(1 + 3 * (p.p_partkey % 7) AS INTEGER), 3) END AS aired_on,
 CASE WHEN p.p_partkey % 13 = 0 THEN NULL ELSE CAST(p.p_size * 100 AS DOUBLE) END AS duration,
 CAST(p.p_size AS DOUBLE) AS tot_eps, p.p_retailprice AS rank, CAST(s.n AS DOUBLE) AS pop,
 CASE WHEN p.p_partkey % 17 = 0 THEN NULL ELSE CAST(s.st AS DATE) END AS start_dt,
 CASE WHEN p.p_partkey % 19 = 0 THEN NULL ELSE CAST(s.en AS DATE) END AS end_dt,
 CASE WHEN p.p_partkey % 23 = 0 THEN NULL ELSE d.text END AS synopsis
FROM part p
LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS st, max(l_shipdate) AS en, count(*) AS n
           FROM lineitem GROUP BY l_partkey) s ON s.l_partkey = p.p_partkey
CROSS JOIN (SELECT count(*) AS nd FROM documents) c
LEFT JOIN documents d ON d.doc_id = p.p_partkey % c.nd""",
    "reviews": f"""
SELECT concat('u', CAST(o.o_custkey AS VARCHAR)) AS user_id, concat(' ', upper({_NAME}), ' ') AS title,
 1.0E0 + CAST(floor(l.l_quantity) AS BIGINT) % 10 AS overall_score,
 1.0E0 + CAST(floor(l.l_extendedprice) AS BIGINT) % 10 AS story_score,
 1.0E0 + CAST(round(l.l_discount * 100) AS BIGINT) % 10 AS acting_cast_score,
 CAST(1.0E0 + round(l.l_tax * 100) AS DOUBLE) AS music_score,
 1.0E0 + (l.l_orderkey + l.l_partkey) % 10 AS rewatch_value_score,
 l.l_suppkey AS n_helpful,
 CASE WHEN l.l_orderkey % 29 = 0 THEN 'unknown' WHEN l.l_orderkey % 31 = 0 THEN CAST(l.l_linenumber AS VARCHAR)
      ELSE concat(CAST(l.l_linenumber AS VARCHAR), ' of ', CAST(p.p_size AS VARCHAR), ' episodes seen') END AS ep_watched,
 CASE WHEN l.l_orderkey % 23 = 0 THEN NULL ELSE d.text END AS review_text
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey
LEFT JOIN documents d ON d.doc_id = l.l_orderkey""",
    "credits": f"""
SELECT s.s_suppkey AS actor_id, s.s_name AS actor_name, {_NAME} AS item_name, concat('char ', CAST(i AS VARCHAR)) AS character_name,
 CASE i WHEN 0 THEN 'main role' WHEN 1 THEN 'SUPPORT ROLE' WHEN 2 THEN 'guest role' ELSE 'co-lead (main) role' END AS role
FROM part p CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i) x CROSS JOIN (SELECT count(*) AS ns FROM supplier) n
JOIN supplier s ON s.s_suppkey = (p.p_partkey + (i % 3) * (p.p_partkey % 5 + 1)) % ns""",
}


def norm(expr: str) -> str:
    """strip + lower in DuckDB (regexp_replace needs the 'g' flag)."""
    return f"lower(regexp_replace({expr}, '^\\s+|\\s+$', '', 'g'))"


def title_case(expr: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({expr}), '\\p{{L}}+|[^\\p{{L}}]+'), "
            f"lambda w: upper(w[1]) || w[2:]), '')")


def int_token(tok: str) -> str:
    return f"CASE WHEN regexp_full_match({tok}, '[+-]?[0-9]+') THEN TRY_CAST({tok} AS INTEGER) END"


def days_to_ts(d: str) -> str:
    return (f"(CAST(DATE '1970-01-01' + CAST(floor({d}) AS INTEGER) AS TIMESTAMP) + "
            f"to_microseconds(CAST(round(({d} - floor({d})) * 86400000000) AS BIGINT)))")


def score_label(s: str) -> str:
    s = f"(CASE WHEN isnan({s}) THEN NULL ELSE {s} END)"
    return f"CAST(CASE WHEN {s} >= 7 THEN 2 WHEN {s} >= 4 THEN 1 ELSE 0 END AS INTEGER)"


def md5_bucket(key: str, seed="42", buckets: int = 1000) -> str:
    return (f"CAST(CAST(('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT)"
            f" % {buckets} AS INTEGER)")


def r6(expr: str) -> str:
    # "+ 0.0" turns a rounded -0.0 into 0.0, as Spark's round returns
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


CLEAN_CTES = {
    "item_fill": f"""
SELECT
 (SELECT aired_on FROM items WHERE aired_on IS NOT NULL GROUP BY aired_on ORDER BY count(*) DESC, aired_on LIMIT 1) AS m_aired,
 (SELECT org_net FROM items WHERE org_net IS NOT NULL GROUP BY org_net ORDER BY count(*) DESC, org_net LIMIT 1) AS m_org,
 (SELECT median(duration) FROM items) AS med_dur,
 (SELECT median(date_diff('day', DATE '1970-01-01', start_dt)) FROM items) AS med_start,
 (SELECT median(date_diff('day', DATE '1970-01-01', end_dt)) FROM items) AS med_end""",
    "items_days": """
SELECT i.*, f.*,
 coalesce(CAST(date_diff('day', DATE '1970-01-01', i.start_dt) AS DOUBLE), f.med_start) AS sdays,
 coalesce(CAST(date_diff('day', DATE '1970-01-01', i.end_dt) AS DOUBLE), f.med_end) AS edays
FROM items i CROSS JOIN item_fill f""",
    "items_clean": f"""
SELECT item_id, item_name, year, country, type, content_rt,
 coalesce(director, 'Unknown') AS director, coalesce(screenwriter, 'Unknown') AS screenwriter,
 coalesce(org_net, m_org, 'Unknown') AS org_net, coalesce(aired_on, m_aired, 'Unknown') AS aired_on,
 coalesce(duration, med_dur) AS duration, tot_eps, rank, pop,
 {days_to_ts('sdays')} AS start_dt, {days_to_ts('edays')} AS end_dt,
 coalesce(synopsis, 'No synopsis available') AS synopsis,
 CAST(month(DATE '1970-01-01' + CAST(floor(sdays) AS INTEGER)) AS INTEGER) AS start_month,
 CAST(isodow(DATE '1970-01-01' + CAST(floor(sdays) AS INTEGER)) - 1 AS INTEGER) AS start_day_of_week,
 CAST(coalesce(CASE WHEN floor(edays - sdays) = 0 THEN 1 ELSE floor(edays - sdays) END, 0) AS INTEGER) AS duration_days,
 CASE WHEN coalesce(duration, med_dur) > 0 AND coalesce(duration, med_dur) <= 1800 THEN 'short'
      WHEN coalesce(duration, med_dur) > 1800 AND coalesce(duration, med_dur) <= 3600 THEN 'medium'
      WHEN coalesce(duration, med_dur) > 3600 THEN 'long' END AS duration_category
FROM items_days""",
    "reviews_clean": f"""
SELECT user_id, {norm('title')} AS title, overall_score, story_score, acting_cast_score, music_score,
 rewatch_value_score, n_helpful, ep_watched, coalesce(review_text, 'No review provided') AS review_text,
 coalesce({int_token("string_split(ep_watched, ' ')[1]")}, 0) AS episodes_watched,
 CAST({int_token("string_split(ep_watched, ' ')[3]")} AS DOUBLE) AS total_episodes,
 {score_label('overall_score')} AS sentiment_label
FROM reviews""",
    "credits_clean": f"""
SELECT actor_id, actor_name, {norm('item_name')} AS item_name, character_name,
 {title_case('role')} AS role
FROM credits""",
    "name_lookup": f"""
SELECT {norm('item_name')} AS name_key, max(item_id) AS item_id FROM items
WHERE item_name IS NOT NULL GROUP BY 1""",
    "title_stats": """
SELECT title, sum(overall_score) AS score_sum, count(overall_score) AS score_n, count(user_id) AS user_n
FROM reviews_clean WHERE title IS NOT NULL GROUP BY title""",
}

BASE_CTES = {**ROLE_CTES, **CLEAN_CTES}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    ctes = dict(BASE_CTES)
    if extra:
        ctes.update(extra)
    parts = [f"{name} AS ({sql.strip()})" for name, sql in ctes.items()]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        # splice the body's own CTEs after the shared ones
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
