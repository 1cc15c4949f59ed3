"""Toxicity through noisy-channel deobfuscation.

A token is seen as a noisy copy of an intended word. Its characters span a
lattice: a letter stands for itself, a look-alike (``LOOK_ALIKES``) for one of
its letters or a word break, a separator for nothing or a word break, and a
repeated character may be dropped. Viterbi decoding picks the path with the
best channel cost plus character-trigram probability; the trigrams are counted
over all documents. Single characters spelled out with spaces
("x y z", three or more, one or two blanks between) are decoded as one lattice.

The restored words are scored by a logistic model over hashed word and
word-prefix features, fitted on all labelled rows: features are counted over
all of them, and weights are fitted in blocks of about ``BLOCK_ROWS`` rows and
averaged by the blocks' rows. Every feature that toxic
rows hold more often than their share is due takes part; its weight is shrunk
by the counts it rests on (``evidence``), so few labels weaken the model but
do not turn it off. No label, language, source or id enters a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import held_out, learnable, uncollected

#: Characters written in place of letters (fixed values).
LOOK_ALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
               "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Natural logs of the channel's probabilities.
LOOK_ALIKE_COST, BREAK_COST, SKIP_COST, REPEAT_COST, LONG_RUN_COST = -2.0, -1.5, -1.5, -4.0, -0.5

SYMBOLS = 60           # 0 no letter, a-z, the 32 characters from U+00E0 on, 59 any other letter
SMOOTH = 5.0
BUCKETS = 1 << 20      # hashed features
PREFIXES = (4, 5)
SENT_LABELS = 8 << 20  # labels (an id and a bit) sent to the texts at most; more are joined by exchange
BLOCK_ROWS = 30_000    # labelled rows whose weights are fitted in one task, about
HALF_Z = 4.0           # a feature of this z keeps half of its log odds
PRIOR, RIDGE = 1.0, 0.1
USUAL = 100            # distinct features of a text at which a weight counts once
THRESHOLD = 0.3
MEMO = 120_000         # decoded tokens kept per Python worker, in two generations
LONG = 64              # characters above which a token is not kept


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """Symbol of every UTF-16 unit (lower-cased text)."""
    t = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        if chr(i).isalpha():
            t[i] = i - 96 if 97 <= i <= 122 else i - 0xE0 + 27 if 0xE0 <= i <= 0xFF else SYMBOLS - 1
    return t


def symbols(text: str) -> np.ndarray:
    return symbol_table()[np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), np.uint16)]


def trigrams(texts: list[str]) -> np.ndarray:
    """Counts of (two letters before, one before, symbol), flat; a word starts after (0, 0)."""
    s = np.concatenate([[0], symbols("\n".join(texts)), [0]]).astype(np.int32)
    one = s[:-1]
    two = np.concatenate([[0], s[:-2]]) * (one > 0)
    keep = (one > 0) | (s[1:] > 0)
    return np.bincount(((two * SYMBOLS + one) * SYMBOLS + s[1:])[keep], minlength=SYMBOLS ** 3)


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) over all whole texts: at most SYMBOLS ** 3 rows."""

    def count(batches):
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            for s in range(0, len(texts), 256):
                total += trigrams(texts[s:s + 256])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    return docs.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | two before), interpolated with the shorter contexts (SYMBOLS^3 floats)."""
    n3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    n2 = n3.sum(axis=0)
    n1 = n2.sum(axis=0)
    p1 = (n1 + 1) / (n1.sum() + SYMBOLS)
    p2 = (n2 + SMOOTH * p1) / (n2.sum(axis=1, keepdims=True) + SMOOTH)
    p3 = (n3 + SMOOTH * p2) / (n3.sum(axis=2, keepdims=True) + SMOOTH)
    return np.log(p3).astype(np.float32).ravel()


class Decoder:
    """Viterbi decoding of one token's lattice under the character model."""

    def __init__(self, log_p: np.ndarray):
        self.log_p = log_p.tolist()

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """Per character its readings: (letter, "" for nothing or " " for a break; log cost)."""
        out = []
        for i, c in enumerate(token):
            run = i and token[i - 1] == c
            if c.isalpha():
                ways = [(c, 0.0)]
                if run:
                    long = (i > 1 and token[i - 2] == c) or token[i + 1:i + 2] == c
                    ways = [(c, LONG_RUN_COST * 8 if long else 0.0), ("", LONG_RUN_COST if long else REPEAT_COST)]
            elif c in LOOK_ALIKES:
                ways = [(x, LOOK_ALIKE_COST) for x in LOOK_ALIKES[c]] + [(" ", BREAK_COST)]
                if run:
                    ways.append(("", SKIP_COST))
            else:
                ways = [("", SKIP_COST), (" ", BREAK_COST)]
            out.append(ways)
        return out

    def decode(self, token: str) -> str:
        """The likeliest intended words of a lower-cased token, separated by spaces."""
        log_p, table = self.log_p, symbol_table()
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for ways in [*self.lattice(token), [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (two, one), (score, path) in states.items():
                for c, cost in ways:
                    if c == "" or (c == " " and one == 0):
                        s, key, way = score + cost, (two, one), path
                    else:
                        x = 0 if c == " " else int(table[min(ord(c), 65535)])
                        s = score + cost + log_p[(two * SYMBOLS + one) * SYMBOLS + x]
                        key, way = ((0, 0) if x == 0 else (one, x)), (path, c)
                    if key not in after or s > after[key][0]:
                        after[key] = (s, way)
            states = after
        path, out = max(states.values(), key=lambda v: v[0])[1], []
        while path:
            path, c = path
            out.append(c)
        return "".join(reversed(out)).strip()

    def restore(self, token: str) -> str:
        """A lower-cased token without its outer punctuation, decoded where it is not plain."""
        core = token.strip(OUTER)
        if core.isalpha():
            if not _DOUBLE(core):
                return core
            if not _TRIPLE(core):
                return self._undouble(core)
        return self.decode(core) if _LETTER(core) else ""

    def _undouble(self, core: str) -> str:
        """``decode`` of letters whose only choices are doubled ones: each weighs just the trigrams around it."""
        log_p, table = self.log_p, symbol_table()
        x = [0, *(int(table[min(ord(c), 65535)]) for c in core), 0]
        out = [core[0]]
        for i in range(1, len(core)):
            if core[i] == core[i - 1]:
                before, letter, after = x[i - 1], x[i], x[i + 2]
                kept = log_p[(before * SYMBOLS + letter) * SYMBOLS + letter] + log_p[(letter * SYMBOLS + letter) * SYMBOLS + after]
                if REPEAT_COST + log_p[(before * SYMBOLS + letter) * SYMBOLS + after] > kept:
                    continue
            out.append(core[i])
        return "".join(out)


OUTER = "\"'.,;:?!()[]{}<>«»„“”’‘…-–—_*/\\#&%~`^="
_LETTER = re.compile(r"[^\W\d_]").search
_DOUBLE = re.compile(r"(.)\1").search
_TRIPLE = re.compile(r"(.)\1\1").search
_SPELLED = re.compile(r"(?<!\S)\S(?:\s{1,2}\S){2,}(?!\S)")


def tokens(text: str) -> set[str]:
    """Distinct lower-cased tokens; three or more single characters spelled out with white space are one token."""
    low = text.lower()
    if not _SPELLED.search(low):
        return set(low.split())
    found = set(_SPELLED.findall(low))
    return found | set(_SPELLED.sub(" ", low).split()) | {p for f in found for p in f.split()}


def features(words: str) -> bytes:
    """Hash buckets (32-bit numbers) of the restored words and their prefixes."""
    out = []
    for w in words.split():
        raw = w.encode("utf-8", "surrogatepass")
        out.append(zlib.crc32(raw) % BUCKETS)
        for k in PREFIXES:
            if len(w) > k:
                out.append(zlib.crc32(raw[:k] if len(raw) == len(w) else w[:k].encode("utf-8", "surrogatepass"), _MARK) % BUCKETS)
    return np.array(out, np.int32).tobytes()


_MARK = zlib.crc32(b"^")


class Reader:
    """Tokens to feature buckets, with a memo in two generations of bounded size."""

    def __init__(self, log_p: np.ndarray):
        self.decoder, self.memo, self.old = Decoder(log_p), {}, {}

    def buckets(self, text: str) -> np.ndarray:
        """Distinct buckets of a text, ascending."""
        if len(self.memo) > MEMO // 2:
            self.old, self.memo = self.memo, {}
        memo, old, out = self.memo, self.old, []
        for core in {t.strip(OUTER) for t in tokens(text)}:
            got = memo.get(core)
            if got is None:
                got = old.get(core)
                if got is None:
                    got = features(self.decoder.restore(core))
                if len(core) <= LONG:
                    memo[core] = got
            out.append(got)
        return np.unique(np.frombuffer(b"".join(out), np.int32))


def dilution(n: int | np.ndarray) -> float | np.ndarray:
    """What a weight counts in a text of ``n`` distinct buckets: chance hits add up with its square root."""
    return np.sqrt(USUAL / np.maximum(n, 1))


class Model:
    """A weight for every bucket; score = sigmoid(bias + dilution * sum of the distinct buckets' weights)."""

    def __init__(self, log_p: np.ndarray, weights: np.ndarray, bias: float):
        self.log_p, self.weights, self.bias = log_p, weights, bias

    def score(self, buckets: np.ndarray) -> float:
        s = self.bias + dilution(len(buckets)) * self.weights[buckets].sum()
        return float(1 / (1 + np.exp(-np.clip(s, -40, 40))))


def evidence(clean: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Smoothed log odds of features over the base rate, shrunk by z^2 / (z^2 + HALF_Z^2); 0 where toxic rows are not above their share."""
    odds = np.log((toxic + PRIOR * share) / (clean + PRIOR * (1 - share))) - np.log(share / (1 - share))
    due = (clean + toxic) * share
    z = np.maximum(toxic - due, 0) / np.sqrt(due + 1)
    return np.maximum(odds, 0) * z ** 2 / (z ** 2 + HALF_Z ** 2)


def fit_logistic(rows: list[np.ndarray], by: np.ndarray, y: np.ndarray, scale: np.ndarray, steps: int = 150, rate: float = 0.1,
                 l2: float = RIDGE, block: int = 1 << 20):
    """Sparse logistic regression by full-batch Adam: (weights, bias).

    ``rows`` holds the feature places of each row, ``by`` what a weight counts
    there. The ridge is on weight / ``scale``, so a small scale holds a weight
    near 0. Entries are taken in blocks of rows, to bound the memory.
    """
    n, sizes = len(scale), np.array([len(r) for r in rows], np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // block, prepend=-1))
    blocks = [(s, e, np.concatenate(rows[s:e]).astype(np.int32)) for s, e in zip(cuts, [*cuts[1:], len(rows)], strict=True)]
    rate0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w = np.zeros(n + 1)
    w[n] = np.log(rate0 / (1 - rate0))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        g, weight = np.zeros(n + 1), w[:n] * scale
        for s, e, col in blocks:
            at = np.repeat(np.arange(e - s), sizes[s:e])
            x = np.bincount(at, weights=weight[col], minlength=e - s) * by[s:e] + w[n]
            d = 1 / (1 + np.exp(-np.clip(x, -40, 40))) - y[s:e]
            g[:n] += np.bincount(col, weights=(d * by[s:e])[at], minlength=n)
            g[n] += d.sum()
        g[:n] = g[:n] * scale + l2 * w[:n]
        g /= len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return w[:n] * scale, float(w[n])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        block_rows: int = BLOCK_ROWS) -> Model:
    """Character model over all documents, word weights from all labelled rows.

    Labels that are null, or that contradict each other for one id, are not
    used. Without both classes the model has no weights and scores the base
    rate (0 without any label).
    """
    counts = np.zeros(SYMBOLS ** 3)
    for r in trigram_counts(docs, text).collect():  # bounded by the alphabet
        counts[r.gram] = r.n
    log_p = language_model(counts)
    marked = (labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where(learnable("id") & F.col("y").isin(0, 1))
              .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("id", "y"))
    marked = materialize(marked, "toxicity-marked")
    sent = F.broadcast(marked) if marked.count() <= SENT_LABELS else marked  # the texts stay where they are, or are exchanged once
    labelled = materialize(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(sent, "id")
                           .select("y", "text", F.xxhash64("id", "text").alias("place")), "toxicity-labelled")
    totals = {r.y: r.n for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return Model(log_p, np.zeros(BUCKETS), -40.0 if not totals.get(1) else 40.0)
    lm = docs.sparkSession.sparkContext.broadcast(log_p)

    def read(batches):
        reader = Reader(lm.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                sub = b.slice(at, 512)
                with uncollected():
                    found = [reader.buckets(t or "") for t in sub.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([sub.column("y"), pa.array([f.tobytes() for f in found], pa.binary()), sub.column("place")], names=["y", "found", "place"])

    held = materialize(labelled.mapInArrow(read, "y int, found binary, place long"), "toxicity-buckets")  # each text is decoded once

    def count(batches):
        n = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for y, f in zip(b.column("y").to_pylist(), b.column("found").to_pylist(), strict=True):
                n[y, np.frombuffer(f, np.int32)] += 1
        at = np.flatnonzero(n[0] + n[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], names=["bucket", "clean", "toxic"])

    total = totals[0] + totals[1]
    share = totals[1] / total
    seen = (held.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket")
            .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") > (F.col("clean") + F.col("toxic")) * share)
            .orderBy("bucket").toArrow())  # at most BUCKETS
    chosen, clean, toxic = (seen.column(c).to_numpy() for c in ("bucket", "clean", "toxic"))
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    used = docs.sparkSession.sparkContext.broadcast((place, evidence(clean, toxic, share)))

    def hits(batches):
        at = used.value[0]
        for b in batches:
            found = [np.frombuffer(f, np.int32) for f in b.column("found").to_pylist()]
            chosen = [at[f][at[f] >= 0].tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("y"), pa.array([len(f) for f in found], pa.int32()), pa.array(chosen, pa.binary())],
                                             names=["block", "y", "n", "hits"])

    def learn(rows):
        rows = rows.sort_by([("y", "ascending"), ("n", "ascending"), ("hits", "ascending")])
        w, bias = fit_logistic([np.frombuffer(x.as_buffer(), np.int32) for x in rows.column("hits")], dilution(rows.column("n").to_numpy()),
                               rows.column("y").to_numpy().astype(float), used.value[1])
        at = np.flatnonzero(w)
        return pa.table({"at": np.append(at, len(w)), "weight": np.append(w[at], bias) * (rows.num_rows / total)})

    # ids are dealt to blocks of about block_rows rows; a block's weights count by its share of the rows
    block = F.pmod(F.col("place"), F.lit(-(-total // block_rows))).cast("int")
    fitted = (held.select(block.alias("block"), "y", "found").mapInArrow(hits, "block int, y int, n int, hits binary")
              .groupBy("block").applyInArrow(learn, "at long, weight double").groupBy("at").agg(F.sum("weight").alias("weight")).toArrow())  # at most BUCKETS + 1
    w = np.zeros(len(chosen) + 1)
    w[fitted.column("at").to_numpy()] = fitted.column("weight").to_numpy()
    w, bias = w[:-1], float(w[-1])
    weights = np.zeros(BUCKETS)
    weights[chosen] = w
    return Model(log_p, weights, bias)


def score_column(model: Model, text: Column, spark) -> Column:
    """Score (0 to 1) of each whole text; a null or empty text has the model's base score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        reader = Reader(m.log_p)
        for texts in batches:
            with uncollected():
                found = [m.score(reader.buckets(t if isinstance(t, str) else "")) for t in texts]
            yield pd.Series(found, dtype="float64")

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
                   threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: (doc_id, held_out, score, predicted).

    Repeated rows stay repeated, null texts and ids are scored like empty
    texts, an empty table gives an empty table.
    """
    model = fit(docs, labels, doc_id, text, label)
    r = docs.select(F.col(doc_id).alias("doc_id"), score_column(model, F.col(text), docs.sparkSession).alias("score"))
    return r.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
