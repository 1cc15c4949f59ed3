"""CSV by byte ranges, token dictionary, bucket tables, binned density, sketches, tall-skinny matrices."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from castwise.operators import lsh, profile, tallskinny, tokens
from castwise.operators import neighbors as NB
from castwise.sources import files as FI


def test_csv_ranges_equal_the_plain_reader(spark):
    """One file, fields over several lines, borders of the ranges inside quotes; blank lines, CRLF, doubled quotes, nulls."""
    root = tempfile.mkdtemp(prefix="castwise-ranges-")
    rows = [(i, [None, 'say "hi",\nand\n\nleave', "plain", "a,b", '"', "x\n" * 9][i % 6], f"n{i}", None if i % 7 else "c", "role") for i in range(700)]
    with open(os.path.join(root, "credits.csv"), "w", newline="") as f:
        f.write("actor_id,actor_name,item_name,character_name,role\n")
        for i, name, *rest in rows:
            quoted = "" if name is None else '"' + name.replace('"', '""') + '"'
            f.write(f"{i},{quoted},{rest[0]},{rest[1] or ''},{rest[2]}" + ("\r\n" if i % 5 == 0 else "\n") + ("\n" if i % 50 == 0 else ""))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = FI.csv_records(spark, os.path.join(root, "credits.csv"))
        assert spark.read.text(os.path.join(root, "credits.csv")).select(F.spark_partition_id().alias("p")).distinct().count() > 5
        got = sorted(map(tuple, FI.load_raw(spark, "credits", root, ranges=True).collect()))
        assert got == sorted(rows)
        # the plain reader takes one kind of line end for the whole file and leaves the others' carriage returns in the last field
        assert got == sorted((*r[:4], r.role.rstrip("\r")) for r in FI.load_raw(spark, "credits", root).collect())
        assert records.where("record = 1").first().text.startswith("actor_id,")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])


def test_load_all_raw(spark):
    root = tempfile.mkdtemp(prefix="castwise-all-")
    for name, schema in FI.RAW_SCHEMAS.items():
        FI.write_csv(spark.createDataFrame([tuple(None for _ in schema)] * 2, schema).fillna("x"), os.path.join(root, FI.RAW_FILES[name]))
    assert {n: d.count() for n, d in FI.load_all_raw(spark, root).items()} == {"items": 2, "reviews": 2, "credits": 2}


def test_token_table(spark):
    df = spark.createDataFrame([(1, ["running", "runs", "the", "running"]), (2, []), (3, ["the"] * 60)], "k long, t array<string>")
    t = tokens.encode(df, F.col("t"), ("k",))
    words = {r.token: r for r in t.words.collect()}
    assert sorted(r.tid for r in words.values()) == list(range(len(words))) and words["the"].n == 61 and words["running"].stem == "run"
    rows = {r.k: r for r in t.texts.join(t.encoded, "rid", "left").collect()}
    assert [r for r in rows[1].ids] == [words[w].tid for w in ("running", "runs", "the", "running")] and rows[2].ids is None
    assert {r.k: r.clean_text for r in tokens.stemmed(t).collect()} == {1: "run run the run", 2: "", 3: " ".join(["the"] * 60)}


def test_token_table_exchanges_rare_words_only(spark, monkeypatch):
    """With fewer words sent than there are, the rest is joined to the same arrays; sent words never are."""
    rows = [(1, ["running", "runs", "the", "running"]), (2, []), (3, ["the"] * 60), (4, None), (5, ["runs", None, "hopes", "the", "ties"]), (5, ["the", "the"])]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    joined, join = [], tokens.lookup_join

    def seen(big, *rest):
        joined.append(sorted(r.token for r in big.collect()))
        return join(big, *rest)

    monkeypatch.setattr(tokens, "lookup_join", seen)
    plain = tokens.encode(df, F.col("t"), ("k",))
    monkeypatch.setattr(tokens, "SENT_WORDS", 2)  # the, running (runs is as frequent, but later by name)
    few = tokens.encode(df, F.col("t"), ("k",))
    assert joined == [["hopes", "runs", "runs", "ties"]]
    as_rows = lambda df: sorted(map(str, df.drop("rid").collect()))
    assert as_rows(few.full) == as_rows(plain.full) and few.encoded.count() == plain.encoded.count() == 4
    assert as_rows(tokens.stemmed(few)) == as_rows(tokens.stemmed(plain)) and "clean_text='run hope the ti'" in as_rows(tokens.stemmed(few))[-2]


def test_bucket_tables_find_near_vectors(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(40, 16))
    m = centres[rnd.integers(0, 40, 1500)] + 0.2 * rnd.normal(size=(1500, 16))
    v = NB.pack_dense(spark.createDataFrame([(i, m[i].tolist()) for i in range(1500)], "id long, vec array<double>"), unit=True)
    q = v.table.where("id % 100 = 0").selectExpr("id as qid")
    index = lsh.BucketTables(v, tables=8, bits=6)
    found = index.nearest(q, 5, probes=3)
    r = lsh.recall(found, NB.nearest(v, q, 5)[0]).first()
    assert r.queries == 15 and r.pairs == 75 and r.recall >= 0.9
    assert found.where("qid = id").isEmpty() and index.index.count() == 1500 * 8


def test_binned_density_is_within_its_error(spark):
    v = np.random.default_rng(6).lognormal(size=3000)
    got = profile.binned_density(spark.createDataFrame([(float(x),) for x in v], "x double"), ["x"], points=20, error=1e-6).orderBy("point").collect()
    h = v.std(ddof=1) * len(v) ** -0.2
    want = np.exp(-((np.linspace(v.min(), v.max(), 20)[:, None] - v) / h) ** 2 / 2).mean(axis=1)
    assert np.abs(np.array([r.kernel_mean for r in got]) - want).max() <= 1.1e-6
    assert profile.binned_density(spark.createDataFrame([(1.0,)] * 3, "x double"), ["x"]).count() == 0


def test_sketches_merge_to_coarser_groups(spark):
    d = spark.range(60_000).selectExpr("id % 5 as a", "id % 10 as b", "id % 20000 as u")
    s = profile.distinct_sketches(d, ["a", "b"], "u")
    for keys in ([], ["a"], ["a", "b"]):
        exact = {tuple(r)[:-1]: r.n for r in d.groupBy(*keys).agg(F.count_distinct("u").alias("n")).collect()}
        got = {tuple(r)[:-1]: r.estimate for r in profile.merged_distinct(s, keys).collect()}
        assert got.keys() == exact.keys() and all(abs(got[k] - n) <= profile.SKETCH_BOUND * n for k, n in exact.items())


def test_svd_of_a_wide_matrix_with_a_hot_column(spark, monkeypatch):
    """Several blocks and cells, a column with a third of the entries, low rank, fewer vectors than asked."""
    monkeypatch.setattr(tallskinny, "BLOCK", 16)
    monkeypatch.setattr(tallskinny, "CELL", 30)
    rnd = np.random.default_rng(9)
    x = np.where(rnd.random((60, 50)) < 0.1, rnd.normal(size=(60, 50)), 0)
    x[:, 7] = rnd.normal(size=60)
    e = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "u long, t long, v double")
    rows, cols, sigma, worst = tallskinny.truncated_svd(e, "u", "t", "v", 60, 50, 4, block=8, steps=3, tol=1e-6)
    u, s, vt = np.linalg.svd(x)
    assert worst <= 1e-6 and np.allclose(sigma, s[:4], rtol=1e-8)
    v = np.zeros((50, 4))
    for r in cols.collect():
        v[r.id] = r.vec
    us = np.zeros((60, 4))
    for r in rows.collect():
        us[r.id] = r.vec
    assert np.allclose(us @ v.T, (u[:, :4] * s[:4]) @ vt[:4], atol=1e-4) and np.allclose(v.T @ v, np.eye(4), atol=1e-9)
    one = spark.createDataFrame([(0, 0, 2.0), (1, 0, 1.0)], "u long, t long, v double")
    assert np.allclose(tallskinny.truncated_svd(one, "u", "t", "v", 2, 3, 2)[2], [5 ** 0.5])
