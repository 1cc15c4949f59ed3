"""Quality classification with hierarchical empirical Bayes.

A logistic classifier over shape features of the whole text gives each
document's own evidence p. Sites get posteriors in two levels by grouped
aggregation: a host's good rate has a Beta prior around the global rate, a
path's good rate one around its host's posterior mean. The prior strengths
are estimated from all groups by the method of moments, so sparse hosts and
paths shrink towards their parent. A document's posterior odds are its
classifier odds times the ratio of its path's odds to the global odds.

Labelled rows outside the held-out fold count with their label, all other
rows with their classifier probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..operators.joins import salted_join
from ..session import materialize
from .common import held_out, learnable

FEATURES = ("upper", "digit", "symbol", "bar", "words", "distinct_words", "repeated_lines", "word_length", "log_bytes")
SAMPLE_ROWS = 20_000      # labelled rows the classifier is fitted on at most
THRESHOLD = 0.5
MIN_RATE = 1e-6

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 upper, 2 digit, 3 symbol, 4 bar, 5 white space
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-|?"]] = 3
_CLASS[ord("|")] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 5


def shape(text: str | None) -> list[float]:
    """The features of one whole text (zeros for a null or empty one)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(FEATURES)
    n, c = len(data), np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=6)
    ws, lines = data.split(), [x for x in data.split(b"\n") if x]
    return [c[1] / n, c[2] / n, c[3] / n, c[4] / n, len(ws) / n, len(set(ws)) / max(1, len(ws)), 1 - len(set(lines)) / max(1, len(lines)),
            min(40.0, (n - c[5]) / max(1, len(ws))) / 10, float(np.log1p(n)) / 10]


@F.pandas_udf(ArrayType(DoubleType()))
def shape_features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([shape(t if isinstance(t, str) else None) for t in texts])


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 25, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton's method on standardised features; weights and bias for the raw ones."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], l2), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        w -= np.linalg.solve(h, z.T @ (p - y) + ridge * w)
    raw = w[:-1] / sd
    return raw, float(w[-1] - raw @ mean)


def _evidence(x: Column, w: np.ndarray, bias: float) -> Column:
    s = F.lit(bias)
    for i, v in enumerate(w):
        s = s + x[i] * float(v)
    return 1 / (1 + F.exp(-s))


def _concentration(groups: DataFrame, n: str, s: str, parent: Column) -> float:
    """Strength of the Beta prior around ``parent``, by moments over all groups."""
    v = parent * (1 - parent)
    m = groups.agg(F.sum((F.col(s) - F.col(n) * parent) ** 2 - F.col(n) * v).alias("over"), F.sum(F.col(n) * (F.col(n) - 1) * v).alias("due")).first()
    rho = min(0.99, max(MIN_RATE, (m.over or 0.0) / m.due if m.due else MIN_RATE))
    return 1 / rho - 1


def _odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(MIN_RATE)), F.lit(1 - MIN_RATE))
    return q / (1 - q)


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text",
             label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: (doc_id, held_out, evidence, host_rate, path_rate, score, predicted).

    ``host`` and ``path`` are columns of ``docs``; nulls are a host or path of
    their own. Null or contradicting labels are not used; without both classes
    the evidence is the base rate (0.5 without any label). Repeated rows stay
    repeated, null texts are scored like empty ones, an empty table gives an
    empty table.
    """
    marked = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(learnable() & F.col("y").isin(0, 1))
              .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("doc_id", "y"))
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))  # noqa: E731  (null apart from any text)
    x = materialize(docs.select(F.col(doc_id).alias("doc_id"), key(host).alias("host"), key(path).alias("path"), shape_features(F.col(text)).alias("x"))
                    .withColumn("salt", F.xxhash64("x")), "quality-shapes")
    sample = x.join(F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)), "doc_id")
    rows = sample.select("x", "y").orderBy("x", "y").limit(sample_rows).collect()
    y = np.array([r.y for r in rows], float)
    if len(set(y)) == 2:
        evidence = _evidence(F.col("x"), *fit_logistic(np.array([r.x for r in rows]), y))
    else:
        evidence = F.lit(float(y[0]) if len(y) else 0.5)
    p = x.select("doc_id", "host", "path", "salt", evidence.alias("evidence")).join(marked, "doc_id", "left")
    p = materialize(p.withColumn("good", F.coalesce(F.col("y").cast("double"), F.col("evidence"))), "quality-evidence")

    paths = p.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("s"))
    paths = materialize(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    rate = min(1 - MIN_RATE, max(MIN_RATE, total.s / total.n)) if total.n else 0.5
    k = _concentration(hosts, "host_n", "host_s", F.lit(rate))
    hosts = hosts.select("host", ((F.col("host_s") + k * rate) / (F.col("host_n") + k)).alias("host_rate"))
    both = salted_join(paths, hosts, ["host"], spread_by="path")
    k = _concentration(both, "n", "s", F.col("host_rate"))
    rates = materialize(both.select("host", "path", "host_rate", ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate")), "quality-rates")
    r = salted_join(p, rates, ["host", "path"], spread_by="salt")
    odds = _odds(F.col("evidence")) * _odds(F.col("path_rate")) / (rate / (1 - rate))
    return (r.select("doc_id", held_out().alias("held_out"), "evidence", "host_rate", "path_rate", (odds / (1 + odds)).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
