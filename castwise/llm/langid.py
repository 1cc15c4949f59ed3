"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in segments of ``SEGMENT`` bytes,
once forward and once backward. Each direction is a gated unit

    z = clip(Ez[b] + Uz h), r = clip(Er[b] + Ur h), n = tanh(En[b] + r * (Un h)),
    h = n + z * (h - n)

with gates clipped to 0..1. Every byte position gets a softmax over the
languages from both states; the probabilities of all letter positions of the
whole text are averaged to the document's distribution. Weights are trained
in numpy by backpropagation through time (Adam) on a bounded sample: at most
``SAMPLE_DOCS`` documents a language (smallest hash of the id) and at most
``SAMPLE_SEGMENTS`` segments of each, spread over the whole text.

A network may learn one class more, *no learned language*, from segments made
of the sample: letters replaced by random ones, letters exchanged for each
other, letters of other alphabets, signs of program text (``strange_segments``). ``accepted``
decides with it whether a text is in a learned language at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh, held_out, learnable

SEGMENT = 128
HIDDEN = 8
BATCH = 2048           # segments run side by side when predicting
SAMPLE_DOCS = 96
SAMPLE_SEGMENTS = 12
MAX_LANGUAGES = 512    # more learned languages than this is an error, not a cut
STEPS, TRAIN_BATCH, RATE = 160, 160, 0.02
UNKNOWN = "und"
CODE_SIGNS = ["_", ".", "(", ")\n", "[", "] ", " = ", "):\n    ", "\n        ", "(self.", ", ", " ", "::", "->", " += ", "{\n", "};\n", "/", "\n\n"]
PRIOR = 64             # letters in a learned language that a text's score is taken to rest on besides its own
QUANTILE = 0.99        # of the learnable texts of a language, see ``bounds``
LEAST = 0.001          # the same for their score
LONGEST = 8            # texts of 2 ** LONGEST letters and more are judged alike
PIECES = 4             # of each of those lengths that one text gives
DIGITS = 4             # of the scores whose quantile is taken: so many values at most are kept for one

#: Bytes that belong to letters: A-Z, a-z and every non-ASCII byte.
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


@dataclass
class Network:
    """Weights, states as columns: e (2, 3H, 256), u (2, 3H, H), w (2, C, H), c (C, 1).

    With ``strange`` the last class is *no learned language*; it is not among ``languages``.
    """

    languages: list[str]
    e: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    strange: bool = False


def _direction(e: np.ndarray, u: np.ndarray, x: np.ndarray) -> np.ndarray:
    """States (T, H, B) of one direction over byte columns x (T, B)."""
    size = u.shape[1]
    h = np.zeros((size, x.shape[1]), np.float32)
    out = np.empty((len(x), size, x.shape[1]), np.float32)
    a, g, n = np.empty((3 * size, x.shape[1]), np.float32), np.empty((3 * size, x.shape[1]), np.float32), np.empty_like(h)
    for t in range(len(x)):
        np.take(e, x[t], axis=1, out=a, mode="clip")
        np.matmul(u, h, out=g)
        gates = g[:2 * size]
        gates += a[:2 * size]
        np.clip(gates, 0, 1, out=gates)
        np.multiply(gates[size:], g[2 * size:], out=n)
        n += a[2 * size:]
        np.tanh(n, out=n)
        h -= n
        h *= gates[:size]
        h += n
        out[t] = h
    return out


def position_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """Language distribution (T, C, B) at every byte of the segments x (T, B)."""
    forward = _direction(net.e[0], net.u[0], x)
    backward = _direction(net.e[1], net.u[1], x[::-1])[::-1]
    p = np.matmul(net.w[0], forward)
    p += np.matmul(net.w[1], backward)
    p += net.c
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def as_bytes(text: str | None) -> bytes:
    """What the network reads: the lower-cased text in UTF-8."""
    return (text or "").lower().encode("utf-8", "surrogatepass")


def segments(data: bytes, size: int = SEGMENT) -> np.ndarray:
    """The bytes as rows of ``size``, the last one padded with zero bytes."""
    return np.frombuffer(data + b"\0" * (-len(data) % size), np.uint8).reshape(-1, size)


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean position probabilities (all classes) over letter bytes, one row per text; NaN without a letter."""
    sums = np.zeros((len(texts), net.c.shape[0]))
    letters = np.zeros(len(texts))
    rows, owner, waiting = [], [], 0

    def flush() -> None:
        x = np.concatenate(rows)
        who = np.concatenate(owner)
        for s in range(0, len(x), BATCH):
            part = np.ascontiguousarray(x[s:s + BATCH].T).astype(np.intp)
            mask = LETTER[part]
            p = position_probabilities(net, part)
            p *= mask[:, None, :]
            np.add.at(sums, who[s:s + BATCH], p.sum(axis=0).T)
            np.add.at(letters, who[s:s + BATCH], mask.sum(axis=0))

    for i, data in enumerate(texts):
        for s in range(0, len(data), SEGMENT * BATCH):
            seg = segments(data[s:s + SEGMENT * BATCH])
            rows.append(seg)
            owner.append(np.full(len(seg), i))
            waiting += len(seg)
            if waiting >= BATCH:
                flush()
                rows, owner, waiting = [], [], 0
    if rows:
        flush()
    with np.errstate(invalid="ignore", divide="ignore"):
        return sums / letters[:, None]


def _backward(e, u, x, states, grad_h, ge, gu) -> None:
    """Adds the gradients of one direction; grad_h (T, H, B) is what the output layer sends back."""
    size, zero, carry = u.shape[1], np.zeros_like(states[0]), 0
    sent = np.empty((3 * size, *x.shape), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h0 = states[t - 1] if t else zero
        a, g = e[:, x[t]], u @ h0
        pre = a[:2 * size] + g[:2 * size]
        gates = np.clip(pre, 0, 1)
        open_ = (pre > 0) & (pre < 1)
        z, r = gates[:size], gates[size:]
        n = np.tanh(a[2 * size:] + r * g[2 * size:])
        dh = grad_h[t] + carry
        dn = dh * (1 - z) * (1 - n * n)
        dz, dr = dh * (h0 - n) * open_[:size], dn * g[2 * size:] * open_[size:]
        dg = np.concatenate([dz, dr, dn * r])
        sent[:size, t], sent[size:2 * size, t], sent[2 * size:, t] = dz, dr, dn
        gu += dg @ h0.T
        carry = dh * z + u.T @ dg
    for row, a in zip(ge, sent, strict=True):
        row += np.bincount(x.ravel(), weights=a.ravel(), minlength=256)


def train(languages: list[str], x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS,
          batch: int = TRAIN_BATCH, rate: float = RATE, seed: int = 7, strange: bool = False) -> Network:
    """Backpropagation through time over segments x (n, SEGMENT) with language indices y.

    With ``strange`` the index after the last language is the class of no learned language.
    """
    rng = np.random.default_rng(seed)
    k = len(languages) + strange
    p = {"e": rng.normal(0, 0.3, (2, 3 * hidden, 256)), "u": rng.normal(0, 0.3, (2, 3 * hidden, hidden)),
         "w": rng.normal(0, 0.3, (2, k, hidden)), "c": np.zeros((k, 1))}
    p["e"][:, :2 * hidden] += 0.5  # gates start half open
    p = {n: v.astype(np.float32) for n, v in p.items()}
    m = {n: np.zeros_like(v) for n, v in p.items()}
    v2 = {n: np.zeros_like(v) for n, v in p.items()}
    for step in range(1, steps + 1) if k > 1 else ():
        pick = rng.integers(0, len(x), min(batch, len(x)))
        xb, target = x[pick].T.astype(np.intp), y[pick]
        hf = _direction(p["e"][0], p["u"][0], xb)
        hb = _direction(p["e"][1], p["u"][1], xb[::-1])
        q = p["w"][0] @ hf + p["w"][1] @ hb[::-1] + p["c"]
        q = np.exp(q - q.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[:, target, np.arange(len(target))] -= 1
        q *= (LETTER[xb] / max(1, LETTER[xb].sum()))[:, None, :].astype(np.float32)
        g = {n: np.zeros_like(a) for n, a in p.items()}
        g["c"][:, 0] = q.sum(axis=(0, 2))
        g["w"][0] = np.einsum("tcb,thb->ch", q, hf)
        g["w"][1] = np.einsum("tcb,thb->ch", q, hb[::-1])
        _backward(p["e"][0], p["u"][0], xb, hf, p["w"][0].T @ q, g["e"][0], g["u"][0])
        _backward(p["e"][1], p["u"][1], xb[::-1], hb, (p["w"][1].T @ q)[::-1], g["e"][1], g["u"][1])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        for n, a in g.items():
            a *= min(1.0, 1.0 / max(norm, 1e-9))
            m[n] = 0.9 * m[n] + 0.1 * a
            v2[n] = 0.999 * v2[n] + 0.001 * a * a
            p[n] -= (rate * (m[n] / (1 - 0.9 ** step)) / (np.sqrt(v2[n] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return Network(languages, p["e"], p["u"], p["w"], p["c"], strange)


def training_segments(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int = SAMPLE_DOCS,
                      per_doc: int = SAMPLE_SEGMENTS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, segments and labels of the bounded sample (rows outside the held-out fold)."""
    h = F.xxhash64(F.col(text))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), h.alias("h")).where(learnable("id") & F.col("lang").isNotNull())
    n = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if n > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    order = F.struct(F.xxhash64("id"), "id")
    # one row of an id, so that an id with very many rows neither fills the sample nor swells it
    picked = (rows.groupBy("lang", "id").agg(F.min("h").alias("pick")).withColumn("o", order)
              .withColumn("k", F.expr("row_number() over (partition by lang order by o)"))
              .where(F.col("k") <= per_language).select("id", F.col("lang").alias("label"), "pick"))
    # at most MAX_LANGUAGES * per_language ids: bounded, so broadcast
    texts = (docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
             .join(F.broadcast(picked), "id").where((F.col("lang") == F.col("label")) & (F.xxhash64("text") == F.col("pick")))
             .dropDuplicates(["lang", "id"]).select("lang", "text"))

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            langs, segs = [], []
            for name, t in zip(b.column("lang"), b.column("text"), strict=True):
                x = segments(as_bytes(t.as_py()))
                for s in x[np.unique(np.linspace(0, len(x) - 1, min(per_doc, len(x))).astype(int))] if len(x) else ():
                    langs.append(name.as_py())
                    segs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(segs, pa.binary())], names=["lang", "seg"])

    got = texts.mapInArrow(cut, "lang string, seg binary").orderBy(F.xxhash64("seg"), "lang").collect()
    languages = sorted({r.lang for r in got})
    at = {name: i for i, name in enumerate(languages)}
    x = np.frombuffer(b"".join(bytes(r.seg) for r in got), np.uint8).reshape(-1, SEGMENT)
    y = np.array([at[r.lang] for r in got], np.int64)
    # as many segments of each language: repeat the rarer ones in turn
    if len(languages) > 1:
        most = np.bincount(y).max()
        pick = np.concatenate([np.resize(np.flatnonzero(y == k), most) for k in range(len(languages))])
        x, y = x[pick], y[pick]
    return languages, x, y


def strange_segments(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """As many segments in no language, in four kinds by turns.

    Random letters for letters; the alphabet's letters exchanged for each other;
    letters of an alphabet that starts at a random character; words with signs of
    program text for blanks. Segments of the last two are cut to their length again.
    """
    rng = np.random.default_rng(seed)
    out = np.array(x)
    for i, row in enumerate(out):
        small = (row >= ord("a")) & (row <= ord("z"))
        if i % 4 == 0:
            row[small] = rng.integers(ord("a"), ord("z") + 1, int(small.sum()))
        elif i % 4 == 1:
            row[small] = (ord("a") + rng.permutation(26))[row[small] - ord("a")]
        elif i % 4 == 2:
            words = bytes(row).decode("utf-8", "ignore").split()
            signs = rng.choice(CODE_SIGNS, len(words))
            data = "".join(f"{w}{sign}" for w, sign in zip(words, signs, strict=True)).encode()
            row[:] = segments(data)[0] if data else 0
        else:
            start = int(rng.choice([rng.integers(0x250, 0x800), rng.integers(0x800, 0xD700)]))  # two bytes a letter, or three
            letters = start + rng.permutation(48)
            words = bytes(row).decode("utf-8", "ignore")
            data = "".join(chr(letters[ord(ch) % 48]) if ch.isalpha() else ch for ch in words).encode()
            row[:] = segments(data)[0] if data else 0
    return out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", strange: bool = False) -> Network:
    """Trains the network; without any learnable row it knows no language.

    ``strange`` adds the class of no learned language, with as many segments as one language has.
    """
    languages, x, y = training_segments(docs, doc_id, text, lang)
    if not strange or not len(x):
        return train(languages, x, y)
    pick = np.random.default_rng(5).permutation(len(x))[:max(4, len(x) // len(languages))]
    x = np.concatenate([x, strange_segments(x[pick])])
    y = np.concatenate([y, np.full(len(x) - len(y), len(languages))])
    return train(languages, x, y, steps=2 * STEPS, strange=True)


def predict(net: Network, text: Column) -> Column:
    """struct<lang: string, score: double, strange: double, letters: long> of each whole text.

    ``strange`` is the probability of no learned language (0 unless the network
    has learned that class); lang is the likeliest of the languages and score
    its probability; letters counts the bytes judged. ``und`` with score 0 for null, empty and letter-less texts, and when the
    network knows no language. Ties go to the alphabetically first language.
    """
    @F.pandas_udf("lang string, score double, strange double, letters long")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores, odd, letters = [], [], [], []
            for s in range(0, len(texts), 512):
                part = [t if isinstance(t, str) else "" for t in texts.iloc[s:s + 512]]
                known = [any(map(str.isalpha, t)) for t in part]
                data = [as_bytes(t) if k else b"" for t, k in zip(part, known, strict=True)]
                letters += [int(LETTER[np.frombuffer(d, np.uint8)].sum()) for d in data]
                if net.languages:
                    p = pooled(net, data)
                for i, k in enumerate(known):
                    if k and net.languages and not np.isnan(p[i, 0]):
                        best = int(p[i, :len(net.languages)].argmax())
                        names.append(net.languages[best])
                        scores.append(float(min(1.0, p[i, best])))
                        odd.append(float(min(1.0, p[i, -1])) if net.strange else 0.0)
                    else:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        odd.append(0.0)
            yield pd.DataFrame({"lang": names, "score": scores, "strange": odd, "letters": letters})

    return label(text)


def _weighed(r: str) -> Column:
    """Score of a prediction after ``PRIOR`` letters that speak for a learned language: a few letters do not tell them apart."""
    letters = F.col(r)["letters"]
    return (F.col(r)["score"] * letters + F.lit(PRIOR)) / (letters + F.lit(PRIOR))


def _band(r: str) -> Column:
    """Texts of 1, 2-3, 4-7, ... letters: how sure the network can be depends on the length."""
    return F.least(F.floor(F.log2(F.col(r)["letters"])), F.lit(LONGEST)).cast("int")


def pieces(text: str | None) -> list[str]:
    """Pieces of 1, 2, 4, ... letters (bytes) from word beginnings all over the text; none longer than the rest from there."""
    data = as_bytes(text)
    letter = LETTER[np.frombuffer(data, np.uint8)]
    starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    seen, out = np.cumsum(letter), []
    for k in range(PIECES * LONGEST) if len(starts) else ():
        at, band = int(starts[k * len(starts) // (PIECES * LONGEST)]), k % LONGEST
        last = int(np.searchsorted(seen, seen[at] - 1 + (1 << band)))
        while last + 1 < len(data) and data[last + 1] & 0xC0 == 0x80:  # a character is not cut
            last += 1
        if last < len(data):
            out.append(data[at:last + 1].decode("utf-8", "ignore"))
    return out


def bounds(net: Network, judged: DataFrame, r: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
           per_language: int = 2 * SAMPLE_DOCS) -> list[tuple[float, float]]:
    """(least score, most ``strange``) of a text that is in a learned language, by ``_band``; the score ``_weighed``.

    ``judged`` holds the prediction of every text as ``r``; all learnable texts
    count. The least score lies half-way from chance to what all but one in a
    thousand reach (``LEAST``, the lowest of the languages). The most
    ``strange`` lies half-way from what all but one in a hundred of its length
    stay below (``QUANTILE``, the highest of the languages) to 1, at least at
    one half: a few rows that are no text themselves do not move them. Few
    texts are short, so pieces of a bounded number of them (``per_language``
    rows a language, smallest hash of the id) count as texts of their own
    there; a length without any has the bound of the next shorter one. (0, 1)
    when the network tells fewer than two classes apart.
    """
    if len(net.c) < 2:
        return [(0.0, 1.0)] * (LONGEST + 1)
    rows = judged.where(learnable(doc_id) & F.col(lang).isNotNull()).select(
        F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(r).alias("r"))
    few = (rows.select("id", "lang", "text").withColumn("o", F.xxhash64("id")).withColumn("k", F.expr("row_number() over (partition by lang order by o, id)"))
           .where(F.col("k") <= per_language).select("lang", "text"))

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            got = [(name.as_py(), p) for name, t in zip(b.column("lang"), b.column("text"), strict=True) for p in pieces(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.string()) for k in (0, 1)], names=["lang", "text"])

    short = few.mapInArrow(cut, "lang string, text string").repartition(F.xxhash64("text")).select("lang", predict(net, F.col("text")).alias("r"))
    whole = rows.select("lang", "r").unionByName(short)
    by = whole.where(F.col("r")["lang"] != UNKNOWN).groupBy("lang", _band("r").alias("band"))
    odd = F.percentile(F.round(F.col("r")["strange"], DIGITS), F.lit(QUANTILE)).alias("odd")
    found = {x.band: x.odd for x in by.agg(odd).groupBy("band").agg(F.max("odd").alias("odd")).collect()}  # LONGEST + 1 rows
    if not found:
        return [(0.0, 1.0)] * (LONGEST + 1)
    score = F.percentile(F.round(_weighed("r"), DIGITS), F.lit(LEAST)).alias("least")
    least = rows.where(F.col("r")["lang"] != UNKNOWN).groupBy("lang").agg(score).agg(F.min("least")).first()[0]
    chance = 1 / max(2, len(net.languages))
    at = [max((k for k in found if k <= band), default=min(found)) for band in range(LONGEST + 1)]
    return [(chance + max(least - chance, 0) / 2, max(0.5, (1 + found[k]) / 2)) for k in at]


def accepted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text is in a learned language.

    Rows go that have no text, no letter, a score below the bound or a
    probability of no learned language above that of texts as long as theirs
    (``bounds``). Every text is judged once, however short, and the bounds rest
    on all learnable ones. Without any learned language every text with letters
    stays. Rows without an id or a language are judged like any other, repeated
    rows alike; an empty table gives an empty table.
    """
    net = fit(docs, doc_id, text, lang, strange=True)
    if not net.languages:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    r = fresh(docs, "language")
    judged = materialize(docs.withColumn(r, predict(net, F.col(text))), "language")  # read twice, predicted once
    least, most = (F.element_at(F.array(*(F.lit(float(x)) for x in side)), _band(r) + 1) for side in zip(*bounds(net, judged, r, doc_id, text, lang), strict=True))
    known = (F.col(r)["lang"] != UNKNOWN) & (_weighed(r) >= least) & (F.col(r)["strange"] <= most)
    return judged.where(known).drop(r)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: (doc_id, held_out, lang_pred, score).

    Learns from ``text`` and non-null ``lang`` of rows outside the held-out
    fold (rows without an id are never learned from), then labels every whole
    text. Repeated rows stay repeated; an empty table gives an empty table.
    """
    net = fit(docs, doc_id, text, lang)
    r = docs.select(F.col(doc_id).alias("doc_id"), predict(net, F.col(text)).alias("r"))
    return r.select("doc_id", held_out("doc_id").alias("held_out"), F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"))
