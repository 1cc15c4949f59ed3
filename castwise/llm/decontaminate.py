"""Benchmark decontamination as a prefix-filtered set join.

Records are the windows of the benchmark items: ``window`` consecutive words
(an item with fewer words is one window). A record's tokens are its word
shingles of ``shingle`` words with their place in the window. Containment is
to be exact (threshold 1), so by the prefix principle a document part can only
hold a record if it holds the record's rarest token: tokens are ordered by the
number of documents that have them, and one prefix token a record is joined.
A match of that token at word p fixes where the record would lie; the length
bound (the document has as many words) and the positional bound (the record
lies inside it) drop candidates, and the whole window is then compared.

The document side is never shuffled. Records are dealt to blocks of about
``BLOCK_RECORDS`` by hash; each block is broadcast in turn and every document
passes all blocks, so the memory is bounded and no record is left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh

WINDOW = 10
SHINGLE = 2
SLICE = 256               # texts copied into Python at once
BLOCK_RECORDS = 200_000   # (window, item) rows held by a task at once, on average

#: Words over the lower-cased UTF-8 bytes: runs of digits, a-z and non-ASCII bytes.
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased; none for null."""
    return _WORDS(text.encode("utf-8", "surrogatepass").lower()) if text else []


def windows(ws: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    """The windows of an item: runs of ``size`` words, or all of its fewer words."""
    return [ws[i:i + size] for i in range(len(ws) - size + 1)] if len(ws) >= size else [ws] if ws else []


def tokens(ws: list[bytes], shingle: int = SHINGLE) -> list[tuple[bytes, ...]]:
    """The shingles of a record in order of their place (a shorter record is one shingle)."""
    k = min(shingle, len(ws))
    return list(zip(*(ws[i:] for i in range(k)), strict=False))


def records(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(window, item): the distinct windows (words joined by a blank) of every item."""

    def cut(batches):
        for b in batches:
            out, ids = [], []
            for item, t in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                for w in windows(words(t), window):
                    out.append(b" ".join(w))
                    ids.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ids, pa.string())], names=["window", "item"])

    return (benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
            .mapInArrow(cut, "window binary, item string").distinct())


def document_frequencies(docs: DataFrame, text: str, wanted: set, spark) -> Counter:
    """In how many documents each wanted token occurs (a bounded set, counted over all documents)."""
    order = sorted(wanted)
    shared = spark.sparkContext.broadcast({t: i for i, t in enumerate(order)})

    def count(batches):
        at, n = shared.value, Counter()
        sizes = {len(t) for t in at}
        keys = at.keys()
        for b in batches:
            for at_row in range(0, b.num_rows, SLICE):
                for t in b.column(0).slice(at_row, SLICE).to_pylist():
                    ws = words(t)
                    for k in sizes:
                        n.update(keys & set(zip(*(ws[i:] for i in range(k)), strict=False)))
        yield pa.RecordBatch.from_arrays([pa.array([at[t] for t in n], pa.int64()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    rows = docs.select(text).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return Counter({order[r.token]: r.n for r in rows})


class Block:
    """Records of one block by their prefix token: token -> [(place, window words, items)]."""

    def __init__(self, found: dict[bytes, list[str]], frequency: Counter, shingle: int):
        self.index: dict[tuple[bytes, ...], list] = {}
        self.shingle = shingle
        for w, items in found.items():
            ws = w.split(b" ")
            ts = tokens(ws, shingle)
            place = min(range(len(ts)), key=lambda i: (frequency[ts[i]], ts[i], i))
            self.index.setdefault(ts[place], []).append((place, ws, items))
        self.sizes = sorted({len(t) for t in self.index})

    def match(self, ws: list[bytes]) -> tuple[list[int], set[str]]:
        """(start, end, start, end, ...) of the words inside occurrences, and the items."""
        spans, items, index = [], set(), self.index
        for k in self.sizes:
            grams = list(zip(*(ws[i:] for i in range(k)), strict=False))
            if index.keys().isdisjoint(grams):
                continue
            for p, g in enumerate(grams):
                for place, window, ids in index.get(g, ()):
                    start = p - place
                    if start < 0 or start + len(window) > len(ws):  # positional and length bounds
                        continue
                    if ws[start:start + len(window)] == window:
                        spans.append((start, start + len(window)))
                        items.update(ids)
        merged: list[int] = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1]:
                merged[-1] = max(merged[-1], e)
            else:
                merged += [s, e]
        return merged, items


def _union(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "match", item_id: str = "item_id",
            item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with column ``out``: struct<n_words, spans, items>.

    spans: [start, end, start, end, ...] in words, disjoint and ascending:
    the words inside any occurrence of a window. items: the ids (as strings,
    sorted) of the items with occurring windows; items without an id mark
    words but are not listed. Null and word-less texts have no words; an item
    without words has no window; without any window every document is clean.
    """
    spark = docs.sparkSession
    found = materialize(records(benchmark, item_id, item_text, window), "benchmark-records")
    blocks = max(1, -(-found.count() // BLOCK_RECORDS))
    for i in range(blocks):
        mine = found.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == i).collect()  # a bounded block
        held: dict[bytes, list[str]] = {}
        for r in mine:
            held.setdefault(bytes(r.window), []).extend([r.item] if r.item is not None else [])
        wanted = {t for w in held for t in tokens(w.split(b" "), shingle)}
        frequency = document_frequencies(docs, text, wanted, spark) if wanted else Counter()
        shared = spark.sparkContext.broadcast(Block(held, frequency, shingle))
        docs = _pass_block(docs, text, out, shared, first=not i)
    return docs


def _pass_block(docs: DataFrame, text: str, out: str, shared, first: bool) -> DataFrame:
    kind = "n_words long, spans array<long>, items array<string>"

    def found(t: str | None, spans: list[int], items: list[str]) -> tuple:
        ws = words(t if isinstance(t, str) else None)
        s, i = shared.value.match(ws)
        return len(ws), _union(spans, s) if spans else s, sorted({*items, *i})

    if first:
        @F.pandas_udf(kind)
        def start(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for ts in batches:
                yield pd.DataFrame([found(t, [], []) for t in ts], columns=["n_words", "spans", "items"])

        return docs.withColumn(out, start(F.col(text)))

    @F.pandas_udf(kind)
    def go_on(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ts, spans, items in batches:
            yield pd.DataFrame([found(t, list(s), list(i)) for t, s, i in zip(ts, spans, items, strict=True)], columns=["n_words", "spans", "items"])

    return docs.withColumn(out, go_on(F.col(text), F.col(out)["spans"], F.col(out)["items"]))


def hit_words(spans: Column) -> Column:
    """Number of words inside the spans."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_words, n_hit, n_items, items, spans, contaminated).

    Repeated rows stay repeated, a null id is kept, an empty table gives an
    empty table; other columns are not read.
    """
    r = matches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark)
    return (r.select("doc_id", "match.*").withColumn("n_hit", hit_words(F.col("spans"))).withColumn("n_items", F.size("items").cast("long"))
            .select("doc_id", "n_words", "n_hit", "n_items", "items", "spans", (F.col("n_hit") > 0).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of a benchmark item; all columns as they were."""
    m = fresh(docs, "match")
    return matches(docs, benchmark, text, m).where(F.size(F.col(m)["spans"]) == 0).drop(m)
