"""Tests of the third round's findings: memory of the exact neighbours, factors of narrow matrices."""

import numpy as np
from pyspark.sql import functions as F

from castwise.operators import neighbors, tallskinny


def test_rare_products_expand_few_matches_at_a_time(monkeypatch):
    """One feature that all askers want and all items hold: the matches come in blocks, the sums stay the same."""
    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(40, 6)), rng.normal(size=(50, 6))
    lists = lambda m: [np.arange(6)] * len(m)
    monkeypatch.setattr(neighbors, "BLOCK_VALUES", 100)
    sizes, repeat = [], np.repeat

    def spy(a, n):
        out = repeat(a, n)
        sizes.append(len(out))
        return out

    monkeypatch.setattr(neighbors.np, "repeat", spy)
    got = neighbors._rare_products(lists(q), list(q), lists(x), list(x))
    assert np.allclose(got, q @ x.T)
    assert max(sizes) <= 300  # the items' own 300 weights; all matches are 12,000


def test_queries_go_to_their_cells_in_small_batches(spark, monkeypatch):
    """The rows sent to the cells are bounded by their bytes, not by queries times cells."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<double>")
    monkeypatch.setattr(neighbors, "BLOCK_VALUES", 64)
    got = neighbors.nearest(neighbors.pack_dense(rows, False), rows.where("id % 3 = 0").select(F.col("id").alias("qid")), 5)[0].collect()
    score = m @ m.T
    np.fill_diagonal(score, -np.inf)
    want = {(q, r + 1, int(i)) for q in range(0, 300, 3) for r, i in enumerate(np.argsort(-score[q])[:5])}
    assert {(r.qid, r.rank, r.id) for r in got} == want


def test_narrow_matrix_is_factored_in_one_pass(spark, monkeypatch):
    """All singular values of a matrix of few columns, without an iteration, with empty columns and an empty row."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 3, (70, 9)).astype(float)
    x[:, 4], x[11] = 0, 0
    e = spark.createDataFrame([(int(u), int(t), float(x[u, t])) for u, t in zip(*np.nonzero(x), strict=True)], "u long, t long, v double")
    monkeypatch.setattr(tallskinny, "orthonormal", None)  # the iteration's step
    rows, cols, sigma, worst = tallskinny.truncated_svd(e, "u", "t", "v", 70, 9, 9)
    assert np.allclose(sigma, np.linalg.svd(x)[1][:8]) and worst < 1e-9
    u, v = ({r.id: np.array(r.vec) for r in d.collect()} for d in (rows, cols))
    back = np.array([[u[i] @ v[j] if i in u and j in v else 0.0 for j in range(9)] for i in range(70)])
    assert np.allclose(back, x)


def test_factor_iteration_exchanges_few_partial_sums_and_writes_few_tables(spark, monkeypatch):
    """A flat spectrum: one block of columns, so that no row has two partial sums, and no wide basis."""
    rng = np.random.default_rng(11)
    x = np.where(rng.random((150, 1500)) < 0.05, rng.integers(1, 10, (150, 1500)), 0).astype(float)
    e = spark.createDataFrame([(int(u), int(t), float(x[u, t])) for u, t in zip(*np.nonzero(x), strict=True)], "u long, t long, v double").cache()
    names, summed = [], []
    write, add = tallskinny.materialize, tallskinny.summed
    monkeypatch.setattr(tallskinny, "materialize", lambda df, name=None: names.append(name) or write(df, name))
    monkeypatch.setattr(tallskinny, "summed", lambda partial, width, n: summed.append(n) or add(partial, width, n))
    rows, cols, sigma, worst = tallskinny.truncated_svd(e, "u", "t", "v", 150, 1500, 5, block=24)
    assert worst <= 1e-4 and np.allclose(sigma, np.linalg.svd(x)[1][:5], rtol=1e-6)
    assert rows.count() == 150 and cols.count() == np.count_nonzero(x.any(axis=0))
    assert set(summed) <= {1500}  # only where terms of the recurrence are added
    assert len(names) < 60, len(names)
