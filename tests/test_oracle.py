"""Every registered query with a SQL oracle must equal it (sf0.001)."""

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from conftest import SF_SMALL  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from castwise.plans.catalog import all_queries  # noqa: E402
from check import rows_of  # noqa: E402

QUERIES = {name: q.build for name, q in all_queries().items()}
ORACLES = {name: q.sql for name, q in all_queries().items() if q.sql is not None}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert rows_of(cols, srows) == rows_of(dcols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = df.collect()
    assert rows and all(any(v is not None for v in r) for r in rows)
    assert len({len(r) for r in rows}) == 1 and len(set(df.columns)) == len(df.columns)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_classifier_scores_every_review(spark):
    rows = QUERIES["text_classifier_scores"](spark, SF_SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert {r.predicted_sentiment for r in rows} <= {0, 1, 2}
    report = QUERIES["text_classifier_report"](spark, SF_SMALL).collect()
    assert all(0 <= x <= 1 for r in report for x in (r.precision, r.recall, r.f1, r.accuracy))


def test_factor_recommendations_are_ranked(spark):
    for name, score in (("collaborative_neighbors", "score"), ("hybrid_recommend", "hybrid_score")):
        by = {}
        for r in QUERIES[name](spark, SF_SMALL).collect():
            by.setdefault(r.query_key, []).append((r["rank"], r[score], r.rec_key))
        for key, recs in by.items():
            recs.sort()
            assert [x[0] for x in recs] == list(range(1, len(recs) + 1)) and key not in {x[2] for x in recs}
            assert all(a[1] >= b[1] - 1e-6 for a, b in zip(recs, recs[1:], strict=False))


def test_stems_match_plain_python(spark):
    from porter_reference import stem
    rows = QUERIES["stem_vocabulary"](spark, SF_SMALL).collect()
    # letters only: the plain stemmer also halves doubled accented letters
    assert all(stem(r.token) == r.stem for r in rows if r.token.isascii()) and all(r.n > 0 for r in rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"query_key", "rank", "hybrid_score"} <= set(df.columns) and not math.isnan(len(df.columns))
