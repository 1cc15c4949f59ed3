"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token ids (a public tokenizer) plus one separator; longer
ones are cut into pieces of ``capacity`` tokens. Pieces of equal length are
interchangeable, so the packing is planned on the histogram of lengths (at
most ``capacity`` numbers, whatever the corpus holds):

1. Dominance reduction. For the longest open length w, let v be the longest
   open length that fits beside it. If no set of open pieces that fits beside
   w is longer than v alone, the bin {w, v} dominates every other bin of w:
   in any packing the pieces beside w can change places with v. Such bins are
   fixed for as many pieces as there are, until the test fails.
2. The remaining counts are packed best-fit decreasing, whole runs of equal
   bins at a time.

The plan is a list of bin patterns with multiplicities. A piece finds its bin
from its rank among the pieces of its length; ranks come from per-partition
counts and running sums over partitions, so no length, however common, meets
in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

CAPACITY = 2048
SEPARATOR = 0
VOCABULARY = "word_bpe_49k.json"
MEMO_BYTES = 120 << 20  # bytes of words and their ids kept per Python worker, in two generations
ENTRY = 200            # bytes that an entry takes besides

#: Characters whose lower-casing and normal form are their own business only:
#: ASCII without the apostrophe, Latin letters up to U+017F without U+0130.
_OTHER = re.compile("[^\t\n\r -&(-~À-ÖØ-öø-įı-ſ]").search
_PARTS = re.compile("[a-zß-öø-įı-ſ]+|[!-&(-@\\[-`{-~]+").findall
_WORD = re.compile("[a-zß-öø-įı-ſ]+$").match


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts, each distinct word encoded once per worker.

    The tokenizer lower-cases, drops white space and never joins a letter run
    with what stands beside it, so a text's ids are those of its parts in
    order. Texts with an apostrophe, a ``<|`` (the vocabulary's special tokens
    are read as such) or characters outside ``_OTHER`` are only split at
    blanks and line feeds.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}  # words of late
        self.old: dict[str, bytes] = {}   # and of the generation before
        self.held = 0                     # bytes of the memo
        ends = [i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        self.ends[ends] = True

    def _learn(self, parts: Iterable[str]) -> None:
        parts = list(parts)
        if self.held > MEMO_BYTES // 2:
            self.old, self.memo, self.held = self.memo, {}, 0
        new = []
        for p in parts:
            if p not in self.memo:
                if p in self.old:
                    self._keep(p, self.old[p])
                else:
                    new.append(p)
        words = [p for p in new if _WORD(p)]
        for s in range(0, len(words), 512):
            some = words[s:s + 512]  # one string: a letter run ends with a word-end token
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                at = [0, *(4 * cuts).tolist()]
                raw = ids.tobytes()
                for w, a, b in zip(some, at, at[1:], strict=False):
                    self._keep(w, raw[a:b])
        for p in new:
            if p not in self.memo:
                self._keep(p, np.array(self.tok.encode_batch_fast([p], add_special_tokens=False)[0].ids, np.uint32).tobytes())

    def _keep(self, part: str, ids: bytes) -> None:
        self.memo[part] = ids
        self.held += len(part) + len(ids) + ENTRY

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        parts = [p for p in re.split("[ \n]+", text) if p] if _OTHER(text) or "<|" in text else _PARTS(text.lower())
        memo = self.memo
        try:
            joined = b"".join([memo[p] for p in parts])
        except KeyError:
            self._learn(dict.fromkeys(parts))
            joined = b"".join([self.memo[p] for p in parts])
        return np.frombuffer(joined, np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this vocabulary file (its memo outlives a task)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           separator: int = SEPARATOR, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, part, nth): the token pieces of every document.

    ``ids`` is there ``with_ids`` only. A null or empty text gives the separator alone. ``ids_crc32`` is the
    unsigned CRC-32 of the piece's ids as little-endian 32-bit numbers, ``part``
    the input partition and ``nth`` the piece's rank among those of its length there.
    """
    from pyspark.sql import types as T

    path = path or tokenizer_path()
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
                           T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())])

    def cut(batches):
        enc, seen, part = encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            for s in range(0, b.num_rows, 256):
                sub = b.slice(s, 256)
                row, out, where, start, length, crc, nth = [], [], [], [], [], [], []
                for i, t in enumerate(sub.column(1).to_pylist()):
                    ids = np.append(enc.encode(t), np.uint32(separator))
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        one = ids[at:at + capacity]
                        row.append(i)
                        where.append(k)
                        start.append(at)
                        length.append(len(one))
                        crc.append(zlib.crc32(one.astype("<u4").tobytes()))
                        nth.append(seen[len(one)])
                        seen[len(one)] += 1
                        if with_ids:
                            out.append(one)
                n, lists = len(row), []
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out).view(np.int32)))]
                yield pa.RecordBatch.from_arrays(
                    [sub.column(0).take(pa.array(row, pa.int64())), pa.array(where, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     *lists, pa.array(crc, pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(nth, pa.int64())], names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


@dataclass
class Pattern:
    """``bins`` equal bins, each holding ``pieces`` = [(length, how many), ...]."""

    bins: int
    pieces: list[tuple[int, int]]


def _longest_beside(counts: np.ndarray, room: int) -> int:
    """The largest total of open pieces that fits in ``room`` (each length as often as it is open)."""
    reach = 1  # bit i: total i can be made
    mask = (1 << (room + 1)) - 1
    for size in np.flatnonzero(counts[:room + 1]):
        left, k = min(int(counts[size]), room // int(size)), 1
        while left > 0:  # binary splitting of the count
            take = min(k, left)
            reach |= (reach << (take * int(size))) & mask
            left, k = left - take, k * 2
        if reach >> room & 1:
            break
    return reach.bit_length() - 1


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fixes dominating bins in place of ``counts`` (number of pieces by length)."""
    fixed: list[Pattern] = []
    w = capacity
    while w > 0:
        if not counts[w]:
            w -= 1
            continue
        room = capacity - w
        counts[w] -= 1
        beside = np.flatnonzero(counts[:room + 1])
        v = int(beside[-1]) if len(beside) else 0
        longest = v if v == room else _longest_beside(counts, room)
        counts[w] += 1
        if v == 0:  # nothing fits beside it
            n = int(counts[w])
            fixed.append(Pattern(n, [(w, 1)]))
            counts[w] = 0
        else:
            if longest > v:
                w -= 1
                continue  # no single piece dominates beside w: left to best fit
            # as long as both lengths last the test stays true: less can be made of fewer pieces
            n = int(counts[w] // 2 if v == w else min(counts[w], counts[v]))
            fixed.append(Pattern(n, [(w, 2)] if v == w else [(w, 1), (v, 1)]))
            counts[w] -= n * (2 if v == w else 1)
            counts[v] -= 0 if v == w else n
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over whole runs of equal bins."""
    open_: dict[int, list[Pattern]] = {}  # by room left
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                each = capacity // size
                bins, rest = divmod(left, each)
                if bins:
                    open_.setdefault(capacity - each * size, []).append(Pattern(bins, [(size, each)]))
                if rest:
                    open_.setdefault(capacity - rest * size, []).append(Pattern(1, [(size, rest)]))
                break
            p = open_[room].pop()
            if not open_[room]:
                del open_[room]
            each = room // size
            bins = min(p.bins, left // each)
            if bins:
                open_.setdefault(room - each * size, []).append(Pattern(bins, [*p.pieces, (size, each)]))
                left -= bins * each
            if bins < p.bins and left and left < each:
                open_.setdefault(room - left * size, []).append(Pattern(1, [*p.pieces, (size, left)]))
                left, bins = 0, bins + 1
            if bins < p.bins:
                open_.setdefault(room, []).append(Pattern(p.bins - bins, p.pieces))
        counts[size] = 0
    return [p for ps in open_.values() for p in ps]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold ``counts[n]`` pieces of every length n."""
    left = counts.astype(np.int64).copy()
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def _runs(patterns: list[Pattern]):
    """(length, lo, hi, first bin, pieces a bin, offset): where the pieces of rank lo..hi-1 go."""
    seen: dict[int, int] = {}
    first = 0
    for p in patterns:
        offset = 0
        for size, each in p.pieces:
            lo = seen.get(size, 0)
            seen[size] = lo + p.bins * each
            yield size, lo, seen[size], first, each, offset
            offset += size * each
        first += p.bins


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (as from ``pieces``, written) with sequence_id and offset.

    The driver holds the histogram (at most ``capacity`` rows) and the plan,
    whose runs are bounded by the lengths too. An empty table stays empty.
    """
    spark = cut.sparkSession
    per_part = materialize(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    runs = spark.createDataFrame(list(_runs(plan(counts, capacity))), "length long, lo long, hi long, first long, each long, place long")
    before = per_part.withColumn("before", F.expr("sum(n) over (partition by length order by part rows between unbounded preceding and current row) - n")).drop("n")
    ranked = cut.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    slot = F.col("rank") - F.col("lo")
    return (ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
            .select(*(ranked[c] for c in cut.columns if c not in ("part", "nth")), (F.col("first") + F.floor(slot / F.col("each"))).alias("sequence_id"),
                    (F.col("place") + (slot % F.col("each")) * ranked["length"]).alias("offset")))


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   path: str | None = None, with_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """(placed, cut): the packed pieces, and the written pieces, which hold their ids ``with_ids`` only.

    placed: (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one
    row per piece. Repeated rows are packed as often as they
    come; null texts and ids are kept; other columns are not read. Sequences
    with their ids: ``sequences``.
    """
    cut = materialize(pieces(docs, doc_id, text, capacity, path=path, with_ids=with_ids), "token-pieces")
    return pack(cut.drop("ids"), capacity), cut


def sequences(placed: DataFrame, cut: DataFrame) -> DataFrame:
    """(sequence_id, ids): every packed sequence of pieces cut ``with_ids``, its pieces in order of their offsets (at most ``capacity`` ids a row)."""
    key = ["doc_id", "piece"]
    both = placed.join(cut.select(*key, "ids"), key)
    return (both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("s"))
            .select("sequence_id", F.flatten(F.col("s.ids")).alias("ids")))
