"""Properties: splits, scaling bounds, cosine symmetry, blend limits,
edge orientation, repartition invariance, SVD against numpy, sources and
the run log."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from castwise.operators import factor as FA
from castwise.operators import graph as G
from castwise.operators import hybrid as H
from castwise.operators import runlog as RL
from castwise.operators import neighbors as NB
from castwise.operators import similarity as SIM
from castwise.plans.catalog import Ctx
from castwise.sources import files as FI


@pytest.fixture(scope="module")
def ctx(spark):
    return Ctx(spark, SF_SMALL)


def test_split_disjoint_and_exhaustive(ctx):
    r = ctx.reviews_clean
    s = FA.split_ratings(r)
    assert s.count() == r.count()
    assert set(x.part for x in s.select("part").distinct().collect()) <= {"train", "test"}
    again = FA.split_ratings(r.repartition(7))
    assert sorted(map(tuple, s.select("user_id", "title", "part").collect())) == \
        sorted(map(tuple, again.select("user_id", "title", "part").collect()))


def test_scaled_in_unit_interval(ctx):
    from castwise.operators.features import NUMERIC_COLS, scaled_numerics
    df = scaled_numerics(ctx.items_clean)
    agg = df.agg(*[F.min(c) for c in NUMERIC_COLS], *[F.max(c) for c in NUMERIC_COLS]).first()
    assert all(0.0 <= v <= 1.0 for v in agg)


def test_cosine_symmetric(spark):
    rows = [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 2.0), (2, "c", 1.0), (3, "b", 1.0), (4, "z", 0.0)]
    v = spark.createDataFrame(rows, "item_id long, feature string, value double")
    names = spark.createDataFrame([(i, f"n{i}") for i in (1, 2, 3, 4)], "item_id long, item_name string")
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    nb = {(r.qid, r.id): r.score for r in SIM.cosine_long(v, q, names, 3).collect()}
    assert abs(nb[(1, 2)] - nb[(2, 1)]) < 1e-12
    assert abs(nb[(1, 2)] - 2 / 5) < 1e-12
    assert (1, 1) not in nb and nb[(1, 4)] == 0.0   # self excluded, zero vector padded in


def test_dot_dense_self_similarity_and_order(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(1,)], "qid long")
    got = [(r.rank, r.id) for r in SIM.dot_dense(v, q, 2, cosine=True).orderBy("rank").collect()]
    assert got == [(1, 2), (2, 3)]


def test_cosine_of_signed_vectors_is_exact(spark):
    """11 negative and 4 zero neighbours: the zeros come first."""
    rows = [(0, "a", 1.0)] + [(i, "a", -1.0) for i in range(1, 12)] + [(i, "b", 1.0) for i in range(12, 16)]
    v = spark.createDataFrame(rows, "item_id long, feature string, value double")
    names = spark.createDataFrame([(i, f"n{i:02}") for i in range(16)], "item_id long, item_name string").repartition(5)
    got = [(r.id, r.score) for r in SIM.cosine_long(v, spark.createDataFrame([(0,)], "qid long"), names, 5).orderBy("rank").collect()]
    assert got == [(12, 0.0), (13, 0.0), (14, 0.0), (15, 0.0), (1, -1.0)]


def test_dense_neighbours_equal_numpy_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(NB, "CELL_ROWS", 5)
    monkeypatch.setattr(NB, "ASKED", 3)
    m = np.random.default_rng(4).normal(size=(60, 5))
    v = spark.createDataFrame([(i, m[i].tolist()) for i in range(60)], "id long, vec array<double>").repartition(4)
    got = {}
    for r in SIM.dot_dense(v, v.selectExpr("id as qid"), 3).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.id
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    assert all([got[q][k] for k in (1, 2, 3)] == np.argsort(-s[q])[:3].tolist() for q in range(60))


def test_blend_alpha_limits(spark):
    cb = spark.createDataFrame([("q", "a", "A", 0.9), ("q", "b", "B", 0.5), ("q", "c", "C", 0.1)],
                               "query_key string, rec_key string, name string, score double")
    cf = spark.createDataFrame([("q", "c", 9.0), ("q", "b", 5.0), ("q", "d", 1.0)],
                               "query_key string, rec_key string, score double")
    a1 = [r.rec_key for r in H.blend(cb, cf, 1.0, 2).orderBy("rank").collect()]
    a0 = [r.rec_key for r in H.blend(cb, cf, 0.0, 2).orderBy("rank").collect()]
    assert a1 == ["a", "b"] and a0 == ["c", "b"]


def test_edges_oriented(ctx):
    e = G.co_appearance_edges(ctx.credits_clean, 25)
    assert e.where(F.col("person_a") >= F.col("person_b")).count() == 0


def test_svd_matches_numpy(ctx):
    f = FA.fit_svd(ctx.reviews_clean, k=8, tol=1e-9)
    X = np.zeros((f.n_users, f.n_titles))
    for r in f.train.collect():
        X[r.u, r.t] = r.v
    s = np.linalg.svd(X, compute_uv=False)
    k = len(f.sigma)
    assert np.allclose(s[:k], f.sigma, atol=1e-6)
    U, S_, Vt = np.linalg.svd(X, full_matrices=False)
    vf = np.zeros((f.n_titles, k))
    for r in f.item_factors.collect():
        vf[r.t] = r.vf
    assert np.allclose(Vt[:k].T @ Vt[:k], vf @ vf.T, atol=1e-6)
    ev = FA.explained_variance(f).first().explained_variance_ratio
    uf = np.zeros((f.n_users, k))
    for r in f.user_factors.collect():
        uf[r.u] = r.uf
    assert abs(ev - uf.var(axis=0).sum() / X.var(axis=0).sum()) < 1e-9
    rep = FA.error_report(FA.predictions(f)).first()
    assert rep.rmse is None or 0 <= rep.rmse <= 9


def test_dense_index_is_dense_sorted(ctx):
    r = ctx.reviews_clean.select("user_id").distinct()
    idx = FA.dense_index(r, "user_id", "i").orderBy("i").collect()
    assert [x.i for x in idx] == list(range(len(idx)))
    assert [x.user_id for x in idx] == sorted(x.user_id for x in idx)


def test_csv_roundtrip_multiline(spark):
    root = tempfile.mkdtemp(prefix="castwise-csv-")
    df = spark.createDataFrame([(1, 'he said "hi",\nthen left'), (2, None)], "actor_id long, actor_name string")
    df = df.select("actor_id", "actor_name", *[F.lit("x").alias(c) for c in ("item_name", "character_name", "role")])
    assert FI.write_csv(df, os.path.join(root, "credits.csv")) == 2
    back = {r.actor_id: r.actor_name for r in FI.load_raw(spark, "credits", root).collect()}
    assert back == {1: 'he said "hi",\nthen left', 2: None}
    with pytest.raises(ValueError):
        FI.load_raw(spark, "nope", root)
    with pytest.raises(FileNotFoundError):
        FI.load_raw(spark, "items", root)


def test_run_log(spark):
    import datetime as dt
    root = tempfile.mkdtemp(prefix="castwise-log-")
    path = os.path.join(root, "versions")
    RL.register_version(spark, path, "content", {"k": 10}, {"ndcg": 0.2}, dt.datetime(2024, 1, 1, 0, 0, 0))
    RL.register_version(spark, path, "content", {"k": 5}, {"ndcg": 0.3}, dt.datetime(2024, 1, 2, 0, 0, 0))
    RL.register_version(spark, path, "other", {}, {}, dt.datetime(2024, 1, 3, 0, 0, 0))
    log = spark.read.parquet(path)
    assert [r.version for r in RL.list_versions(log, "content").collect()] == \
        ["v1_20240102_000000", "v1_20240101_000000"]
    assert RL.resolve_version(log, "content").first().version == "v1_20240102_000000"
    assert RL.resolve_version(log, "content", "v1_20240101_000000").first().params["k"] == "10"
    assert RL.best_version(log, "content", "ndcg").first().metrics["ndcg"] == 0.3
    assert RL.best_version(log, "other", "ndcg").count() == 0
    assert RL.list_versions(log, "missing").count() == 0
    runs = os.path.join(root, "runs")
    RL.log_run(spark, runs, "a", metrics={"p": 0.0})
    RL.log_run(spark, runs, "b", metrics={"p": 0.4}, status="failed")
    assert RL.best_run(spark.read.parquet(runs), "p").first().run_name == "b"


def test_missing_query_gives_empty_typed_result(spark, ctx):
    from castwise.plans.recs import content_recs
    q = spark.createDataFrame([("no such title",)], "query_key string")
    r = content_recs(ctx, q, 5)
    assert r.count() == 0 and {"query_key", "rank", "rec_key", "score"} <= set(r.columns)


def test_stage_sinks_roundtrip(spark, ctx):
    from castwise.operators import sentiment as SE
    root = tempfile.mkdtemp(prefix="castwise-stage-")
    scored = SE.lexicon_scores(ctx.reviews_clean)
    n1 = FI.save_processed(scored.select("title", "overall_score", "review_text", "tb_label"), root, "predictions")
    n2 = FI.save_processed(SE.item_sentiment(scored), root, "item_sentiment")
    n3 = FI.save_processed(ctx.features, root, "feature_store")
    assert n1 == ctx.reviews_clean.count()
    assert FI.read_processed(spark, root, "item_sentiment").count() == n2
    back = FI.read_processed(spark, root, "feature_store")
    assert back.count() == n3 and dict(back.dtypes)["value"] == "double"


def test_load_version_missing_raises(spark):
    log = spark.createDataFrame([], RL.VERSION_SCHEMA)
    with pytest.raises(FileNotFoundError):
        RL.load_version(log, "content")


def test_salted_join_equals_plain_join(spark):
    from castwise.operators.joins import salted_join
    big = spark.createDataFrame([(1, f"t{i}") for i in range(50)] + [(2, "a"), (3, "b")], "user_id long, title string")
    small = spark.createDataFrame([(1, "q1"), (1, "q2"), (3, "q3")], "user_id long, query_key string")
    a = sorted(map(tuple, salted_join(big, small, ["user_id"], "title", 4).select("user_id", "title", "query_key").collect()))
    b = sorted(map(tuple, big.join(small, "user_id").select("user_id", "title", "query_key").collect()))
    assert a == b and len(a) == 101


def test_stage_rebuilds_when_input_changes(spark):
    import time

    from castwise.session import stage
    f = tempfile.NamedTemporaryFile(delete=False)
    f.write(b"x")
    f.close()
    calls = []
    build = lambda: calls.append(1) or len(calls)
    assert stage(spark, ("t",), [f.name], build) == 1
    assert stage(spark, ("t",), [f.name], build) == 1      # reused
    time.sleep(0.01)
    os.utime(f.name, (time.time() + 5, time.time() + 5))   # input changed
    assert stage(spark, ("t",), [f.name], build) == 2


def test_sparse_neighbours_equal_numpy(spark, monkeypatch):
    """Common, rare, negative and missing features, copies, zero vectors; heavy cells over a grid; fewer pairs scored than there are."""
    monkeypatch.setattr(NB, "CELL_ROWS", 40)
    rnd = np.random.default_rng(7)
    n, d = 400, 60
    m = np.where(rnd.random((n, d)) < np.where(np.arange(d) < 6, 0.9, 0.04), rnd.normal(size=(n, d)), 0)
    m[:, 0] += 8 * rnd.random(n)
    m[100:230] = m[100]          # a third are copies
    m[300:310] = 0
    names = spark.createDataFrame([(i, None if i == 5 else f"n{i % 90:02}") for i in range(n)], "item_id long, item_name string")
    v = spark.createDataFrame([(i, f"f{j}", float(m[i, j])) for i in range(n) for j in range(d) if m[i, j]], "item_id long, feature string, value double")
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    u = m / np.where(norm > 0, norm, 1)
    asked = [0, 5, 100, 101, 229, 305, 399]
    q = spark.createDataFrame([(i,) for i in [*asked, 999]], "qid long")
    got = {}
    for r in SIM.cosine_long(v, q, names, 8).collect():
        got.setdefault(r.qid, {})[r["rank"]] = (r.id, round(r.score, 9) + 0.0)
    name = {i: (i == 5, "" if i == 5 else f"n{i % 90:02}") for i in range(n)}
    for i in asked:
        s = np.round(u @ u[i], 9) + 0.0
        want = sorted((k for k in range(n) if k != i), key=lambda k: (-s[k], name[k], k))[:8]
        assert [got[i][k + 1] for k in range(8)] == [(k, s[k]) for k in want]
    assert set(got) == set(asked)
    packed = NB.pack_features(v.withColumnRenamed("item_id", "id"), names.select(F.col("item_id").alias("id"), F.col("item_name").alias("name")))
    scored = {r.qid: r.scored for r in NB.nearest(packed, q, 8)[1].collect()}
    assert sum(scored.values()) < 0.75 * n * len(asked) and 305 not in scored


def test_inner_products_of_mixed_lengths_equal_numpy(spark):
    rnd = np.random.default_rng(8)
    m = rnd.normal(size=(300, 6)) * np.exp(rnd.normal(size=(300, 1)) * 2)
    m[7] = 0
    v = spark.createDataFrame([(i, m[i].tolist()) for i in range(300)] + [(301, None)], "id long, vec array<double>")
    got = {}
    for r in SIM.dot_dense(v, v.where("id % 10 = 7 or id = 301").selectExpr("id as qid"), 5).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.id
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    for q in range(7, 300, 10):
        want = np.lexsort((np.arange(300), -np.round(s[q], 9)))[:5].tolist()
        assert [got[q][k] for k in range(1, 6)] == want
    assert SIM.dot_dense(v.limit(0), v.selectExpr("id as qid"), 5).count() == 0


def test_grid_join_equals_plain_join(spark):
    """One key holds a third of both sides: its product is dealt over a grid, nothing is lost or doubled."""
    from castwise.operators.joins import grid_join, gridded, lookup_join
    left = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 7}", i) for i in range(900)] + [(None, 1), ("hot", 0), ("hot", 0)], "title string, a long")
    right = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 11}", i) for i in range(600)] + [(None, 2)], "title string, b long")
    want = left.join(right, "title")
    got = grid_join(left, right, ["title"], cell_rows=40)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    a, b = gridded(left, right, ["title"], cell_rows=40)
    cells = a.join(b, ["title", "_row", "_col"]).groupBy("title", "_row", "_col").count().where("title = 'hot'").collect()
    counts = sorted(r["count"] for r in cells)
    assert len(counts) >= 30 and counts[-1] <= 2 * counts[len(counts) // 2]
    table = right.groupBy("title").agg(F.sum("b").alias("s"))
    got = lookup_join(left, table, ["title"], cell_rows=40)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, left.join(table, "title", "left").collect()), key=repr)
