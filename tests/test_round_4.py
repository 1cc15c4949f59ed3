"""Tests of the fourth round's findings on the library queries."""

import os

import numpy as np
import pytest

from castwise.operators import tallskinny
from castwise.plans import recs
from castwise.plans.catalog import Ctx
from castwise.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ctx(spark):
    return Ctx(spark, SF)


def test_reports_wait_for_the_sample_alone(spark, ctx, monkeypatch):
    """The pools of the evaluation hold the sample's queries only; both query sets ask one index."""
    from castwise.operators import neighbors, similarity

    made, make = [], neighbors.Index
    monkeypatch.setattr(similarity.NB, "Index", lambda *a, **k: made.append(1) or make(*a, **k))
    monkeypatch.setattr(recs, "content_index", lambda c, f=recs.content_index, kept=[]: kept[0] if kept else kept.append(f(c)) or kept[0])
    sample, asked = ({r.query_key for r in keys(ctx).collect()} for keys in (recs.shared_sample, recs.asked_keys))
    assert asked - sample
    for pool, of in ((recs.content_pool, sample), (recs.corev_pool, sample), (recs.asked_content, asked), (recs.asked_corev, asked)):
        name = pool(ctx).inputFiles()
        written = {r.query_key for r in spark.read.parquet(*name).collect()}
        assert written and written <= of
    assert len(made) <= 1


def flat(spark, rows=150, cols=1500, seed=11):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((rows, cols)) < 0.05, rng.integers(1, 10, (rows, cols)), 0).astype(float)
    return x, spark.createDataFrame([(int(u), int(t), float(x[u, t])) for u, t in zip(*np.nonzero(x), strict=True)], "u long, t long, v double").cache()


def test_factor_iteration_keeps_two_blocks(spark, monkeypatch):
    """Blocks, images and dealt entries that no later step reads are removed as the iteration goes on."""
    x, e = flat(spark)
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    there = lambda *names: [f for f in os.listdir(base) if f.startswith(names)]
    had, most, write = set(there("svd", "by-")), [], tallskinny.materialize

    def watched(df, name):
        out = write(df, name)
        most.append(len(set(there("svd-block", "svd-start")) - had))
        return out

    monkeypatch.setattr(tallskinny, "materialize", watched)
    rows, cols, sigma, worst = tallskinny.truncated_svd(e, "u", "t", "v", 150, 1500, 5, block=24)
    assert worst <= 1e-4 and np.allclose(sigma, np.linalg.svd(x)[1][:5], rtol=1e-6)
    assert len(most) > 12 and max(most) <= 4  # the round's first block, two of the recurrence and the new one
    assert {f.rsplit("-", 5)[0] for f in set(there("svd", "by-")) - had if not f.startswith(("by-col-blocks", "by-row-blocks"))} <= {f.rsplit("-", 5)[0] for f in there("svd-v", "svd-us")}
    assert rows.count() == 150 and cols.count() == np.count_nonzero(x.any(axis=0))


def test_a_block_goes_to_no_more_cells_than_tasks(spark, monkeypatch):
    """Many entries of few rows: a block of the factor is not sent to a cell for every CELL entries."""
    x, e = flat(spark, 40, 400)
    monkeypatch.setattr(tallskinny, "CELL", 10)
    dealt = tallskinny.deal(e, "u", "t", "v", "cells", 8, 400, 40)
    at_a_time = spark.sparkContext.defaultParallelism
    assert dealt.blocks == 1 and dealt.cells.count() <= at_a_time < np.count_nonzero(x) // 10
    tall = spark.createDataFrame([(t, [float(t == k) for k in range(8)]) for t in range(400)], "id long, vec array<double>")
    got = {r.id: np.frombuffer(r.vec) for r in tallskinny.times(dealt, tall, 8, 40).collect()}
    assert all(np.allclose(got[u], x[u, :8]) for u in got) and len(got) == 40
    monkeypatch.setattr(tallskinny, "CELL_VALUES", 32)  # four rows of the result
    assert tallskinny.deal(e, "u", "t", "v", "cells", 8, 400, 40).cells.count() == max(10, at_a_time)
