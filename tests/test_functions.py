"""Edge rows of the scalar functions and small operators (FIXTURES D)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from castwise.functions import scalar as S
from castwise.functions import text as TX
from castwise.operators import clean as C
from castwise.operators import features as FE
from castwise.operators import hybrid as H
from castwise.operators import ranking as R


def col(spark, values, typ):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_progress_parsing(spark):
    rows = ["8 of 16 episodes seen", "12", "nan", None, "8  of 16", "x of y"]
    df = col(spark, rows, "string").select(S.episodes_watched("x").alias("w"), S.total_episodes("x").alias("t"))
    got = [(r.w, r.t) for r in df.collect()]
    assert got == [(8, 16.0), (12, None), (0, None), (0, None), (8, None), (0, None)]


def test_duration_bins(spark):
    vals = [0.0, 1.0, 1800.0, 1800.5, 3600.0, 3601.0, None, -5.0]
    got = [r[0] for r in col(spark, vals, "double").select(S.duration_category("x")).collect()]
    assert got == [None, "short", "short", "medium", "medium", "long", None, None]


def test_score_label(spark):
    vals = [7.0, 6.99, 4.0, 3.99, None, float("nan")]
    got = [r[0] for r in col(spark, vals, "double").select(S.score_label("x")).collect()]
    assert got == [2, 1, 1, 0, 0, 0]


def test_polarity_label(spark):
    got = [r[0] for r in col(spark, [0.1, 0.1001, -0.1, -0.1001], "double")
           .select(S.polarity_label("x")).collect()]
    assert got == [1, 2, 1, 0]


def test_norm_key_strips_tabs(spark):
    got = col(spark, ["\t Foo Bar \n"], "string").select(S.norm_key("x")).first()[0]
    assert got == "foo bar"


def test_duration_days_and_mode_tie(spark):
    d = dt.date
    rows = [(1, d(2020, 1, 1), d(2020, 1, 1), "b"), (2, d(2020, 1, 1), d(2020, 1, 2), "a"),
            (3, d(2020, 1, 5), d(2020, 1, 1), "b"), (4, None, None, "a"), (5, d(2020, 1, 3), d(2020, 1, 3), None)]
    items = spark.createDataFrame(rows, "item_id long, start_dt date, end_dt date, aired_on string")
    for c in ("item_name", "director", "screenwriter", "synopsis", "org_net"):
        items = items.withColumn(c, F.lit(None).cast("string"))
    items = items.withColumn("duration", F.lit(None).cast("double"))
    out = {r.item_id: r for r in C.clean_items(items).collect()}
    assert out[1].duration_days == 1      # same day -> 0 -> 1
    assert out[2].duration_days == 1
    assert out[3].duration_days == -4     # end < start kept
    assert out[5].aired_on == "a"         # mode tie b,a,b,a -> smallest
    assert out[1].org_net == "Unknown"    # all null -> Unknown
    assert out[1].start_month == 1 and out[1].start_day_of_week == 2  # 2020-01-01 is a Wednesday


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0)], "item_id long, year double")
    got = [r.year for r in FE.scaled_numerics(df, ("year",)).collect()]
    assert got == [0.0, 0.0, 0.0]


def test_hybrid_single_candidate(spark):
    cb = spark.createDataFrame([("q", "a", "A", 0.7)], "query_key string, rec_key string, name string, score double")
    cf = spark.createDataFrame([], "query_key string, rec_key string, score double")
    r = H.blend(cb, cf, 0.5, 10).collect()
    assert len(r) == 1 and r[0].cb_score == 0.0 and r[0].hybrid_score == 0.0


def test_hybrid_rejects_bad_alpha(spark):
    cb = spark.createDataFrame([], "query_key string, rec_key string, name string, score double")
    with pytest.raises(ValueError):
        H.blend(cb, cb.drop("name"), 1.5)


def _metrics(spark, recs, rel, k):
    r = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(recs)], "sid long, rank int, rec_key string")
    rl = spark.createDataFrame([(1, x) for x in rel] or [(2, "zz")], "sid long, rel_key string")
    return R.per_query_metrics(r, rl, k).where("sid = 1").first()


def test_ranking_metrics_example(spark):
    m = _metrics(spark, ["a", "b", "c"], ["a", "c", "d"], 3)
    assert math.isclose(m.precision, 2 / 3) and math.isclose(m.recall, 2 / 3)
    assert math.isclose(m.ap, (1 + 2 / 3) / 3, rel_tol=1e-9)
    assert math.isclose(m.ndcg, (1 + 0.5) / (1 + 1 / math.log2(3) + 0.5), rel_tol=1e-9)


def test_ranking_metrics_short_list(spark):
    m = _metrics(spark, ["a"], ["a"], 10)
    assert m.precision == 0.1 and m.recall == 1.0 and m.ap == 1.0 and math.isclose(m.ndcg, 1.0)


def test_ranking_no_relevant_excluded_but_covered(spark):
    sample = spark.createDataFrame([(1, "q1"), (2, "q2")], "sid long, query_key string")
    recs = spark.createDataFrame([("q1", 1, "a"), ("q2", 1, "b")], "query_key string, rank int, rec_key string")
    rel = spark.createDataFrame([("q1", "a")], "query_key string, rel_key string")
    cat = spark.range(4)
    rep = R.evaluate(sample, recs, rel, cat, 10).first()
    assert rep.queries_evaluated == 1 and rep.catalog_coverage == 0.5 and rep.precision_at_k == 0.1


def test_diversity_fewer_than_two(spark):
    recs = spark.createDataFrame([(1, 1, 10), (2, 1, 10), (2, 2, 11)], "sid long, rank int, id long")
    vec = spark.createDataFrame([(10, "f", 1.0), (11, "g", 1.0)], "item_id long, feature string, value double")
    got = {r.sid: r.diversity for r in R.list_diversity(recs, vec).collect()}
    assert got == {1: 0.0, 2: 1.0}


def test_diversity_counts_zero_items(spark):
    recs = spark.createDataFrame([(1, 1, 10), (1, 2, 12), (1, 3, 99)], "sid long, rank int, id long")
    vec = spark.createDataFrame([(10, "f", 1.0)], "item_id long, feature string, value double")
    cat = spark.createDataFrame([(10,), (12,)], "item_id long")
    assert [r.diversity for r in R.list_diversity(recs, vec, catalog=cat).collect()] == [1.0]


def test_clean_text(spark):
    df = col(spark, ["Visit http://x.y NOW!!! The plot, the acting: wonderful.", None], "string")
    got = [r[0] for r in df.select(TX.clean_text("x")).collect()]
    assert got == ["visit plot acting wonderful", ""]


def test_bigrams_short(spark):
    df = spark.createDataFrame([(["a"],), ([],), (["x", "y", "z"],)], "t array<string>")
    got = [r[0] for r in df.select(TX.bigrams(F.col("t"))).collect()]
    assert got == [[], [], ["x y", "y z"]]


def test_porter_examples(spark):
    from castwise.functions.stemming import stem_tokens
    cases = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "motoring": "motor",
             "hopping": "hop", "happy": "happi", "relational": "relat", "generalizations": "gener",
             "effective": "effect", "controll": "control", "roll": "roll"}
    words = [*cases, "as", "yes", "sky"]
    df = spark.createDataFrame([(words,)], "t array<string>")
    got = dict(zip(words, df.select(stem_tokens("t")).first()[0], strict=True))
    assert got == cases | {"as": "as", "yes": "ye", "sky": "sky"}


def test_quality_rules_edge_rows(spark):
    from castwise.operators import quality as Q
    items = spark.createDataFrame([
        ("1", "a", 2020.0, "KR", "s", None, 10.0, 1.0, 1.0),      # null tot_eps passes
        ("2", "b", 1999.0, "KR", "s", 1.0, 10.0, 1.0, 1.0),       # year out of range
        ("3", None, 2020.5, "KR", "s", -1.0, 10.0, 1.0, 1.0),     # three rules, one bad row
        (None, "d", 1.0, "KR", "s", 1.0, 1.0, 1.0, 1.0),          # null key: dropped first
    ], "item_id string, item_name string, year double, country string, type string, "
       "tot_eps double, duration double, rank double, pop double")
    v = Q.verdict(items, "items").first()
    assert (v.n_rows, v.n_bad, v.passed) == (3, 2, False)
    reviews = spark.createDataFrame([
        ("u1", "t", 5.0, 5.0, 5.0, 5.0, float("nan"), 1),            # NaN score fails
        ("u2", "t", 5.0, 5.0, 5.0, 5.0, 10.0, 1),
        ("u3", "t", 5.0, 5.0, 5.0, 5.0, None, 1),                    # null score fails
    ], "user_id string, title string, story_score double, acting_cast_score double, music_score double, "
       "rewatch_value_score double, overall_score double, n_helpful long")
    r = Q.verdict(reviews, "reviews").first()
    assert (r.n_rows, r.n_bad) == (3, 2)
    numbers = Q.verdict(reviews.withColumn("user_id", F.lit(7)), "reviews").first()
    assert numbers.n_bad == 3  # ids must be strings: a number breaks the type rule
    with pytest.raises(ValueError):
        Q.verdict(reviews.drop("title"), "reviews")


def test_quality_rules_on_text_columns(spark):
    from castwise.operators import quality as Q
    items = spark.createDataFrame([("1", 5, "abc", "KR", "s", "x", 10.0, 1.0, 1.0), ("2", None, "2020", "KR", "s", "3", 10.0, 1.0, 1.0)],
                                  "item_id string, item_name int, year string, country string, type string, tot_eps string, duration double, rank double, pop double")
    got = {r.item_id: r.violations for r in Q.with_violations(items, "items").collect()}
    assert got == {"1": ["item_name_type", "year_type", "tot_eps_type"], "2": ["item_name_missing"]}


def test_title_case_and_utc_stamp(spark):
    from castwise.operators import runlog as RL
    df = col(spark, ["co-lead (main) ROLE", "it's élan", None], "string")
    assert [r[0] for r in df.select(S.title_case("x")).collect()] == ["Co-Lead (Main) Role", "It'S Élan", None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert spark.range(1).select(RL.version_stamp(F.timestamp_seconds("id"))).first()[0] == "v1_19700101_000000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_raw_csv_lenient_dates_and_corrupt_rows(spark, tmp_path):
    from castwise.sources import files as FI
    head = ",".join(f.name for f in FI.RAW_SCHEMAS["items"])
    rows = ["1,a,2020,KR,s,,,,,,1.0,1.0,1.0,1.0,\"Feb 3, 2020\",2020-03-01,x", "2,b,never,KR,s,,,,,,1.0,1.0,1.0,1.0,3/2/2020,junk,y"]
    (tmp_path / "items.csv").write_text("\n".join([head, *rows]) + "\n")
    got = {r.item_id: r for r in FI.load_raw(spark, "items", str(tmp_path), corrupt=True).collect()}
    assert str(got[1].start_dt) == str(got[2].start_dt) == "2020-02-03" and str(got[1].end_dt) == "2020-03-01" and got[2].end_dt is None
    assert got[1].corrupt_record is None and "never" in got[2].corrupt_record


def test_lenient_date_parse(spark):
    df = col(spark, ["2020-02-03", "Feb 3, 2020", "3/2/2020", "junk", None], "string")
    got = [r[0] for r in df.select(S.parse_timestamp("x", ["yyyy-MM-dd", "MMM d, yyyy", "d/M/yyyy"])
                                   .cast("date")).collect()]
    d = dt.date(2020, 2, 3)
    assert got == [d, d, d, None, None]
