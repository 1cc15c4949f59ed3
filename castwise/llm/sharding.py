"""Byte-balanced sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id, hash of the row, place in the
table), so equal texts stand together and equal rows can be cut apart; the
keys are written with the rows once. Splitters are found by counting: every round takes candidate
keys (probes) inside the interval that still holds each splitter, counts the
exact bytes and rows below every probe over all partitions, and narrows the
intervals, until each splitter's byte count meets the tolerance or its
interval holds a single row. Then the rows are exchanged once, to their
splitter interval.

Every shard is cut into ``parts`` intervals of equal bytes, so that no task
sorts a whole shard; the exact counts below the splitters give each interval's
first slot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh

Key = tuple[int, int, int, int]

SHARDS = 40
ROW_BYTES = 16             # counted for a row besides its text
FIRST_PROBES = 8           # candidates a target in the first round
PROBES = 24                # and in every later round, within the target's interval
PART_BYTES = 64 << 20      # aim for the bytes of one interval
MAX_SPLITTERS = 1 << 16
TOLERANCE = 0.0002         # of a shard's bytes


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; none for null."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def with_keys(docs: DataFrame, doc_id: str, text: str, a: str, b: str, c: str, d: str) -> DataFrame:
    """Four long columns that order the rows: text, id, whole row, place in the table."""
    whole = F.xxhash64(*(F.col(x) for x in docs.columns if not _has_map(docs.schema[x].dataType)))
    number = F.col(doc_id).cast("long") if dict(docs.dtypes)[doc_id] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(doc_id)
    return docs.withColumns({a: F.xxhash64(text), b: F.coalesce(number, F.lit(-(1 << 63))), c: whole, d: F.monotonically_increasing_id()})


def _has_map(kind) -> bool:
    return "map<" in kind.simpleString()


def _below(cols: list[np.ndarray], probes: list[np.ndarray]) -> np.ndarray:
    """Number of probes <= key for every row; keys and sorted probes as columns."""
    end = np.searchsorted(probes[0], cols[0], "right")
    if len(cols) == 1:
        return end
    left = np.searchsorted(probes[0], cols[0], "left")
    at = left.copy()
    tie = np.flatnonzero(end > left)  # a probe has the same first column: the next ones decide
    for lo in np.unique(left[tie]):
        rows = tie[left[tie] == lo]
        at[rows] = lo + _below([c[rows] for c in cols[1:]], [p[lo:end[rows[0]]] for p in probes[1:]])
    return at


def _columns(probes: list[Key]) -> list[np.ndarray]:
    return [np.array(x, np.int64) for x in zip(*probes, strict=True)]


def histogram(keys: DataFrame, probes: list[Key]) -> list:
    """(bin, size, rows, first key, last key) of every bin between sorted probes that has rows."""
    shared = keys.sparkSession.sparkContext.broadcast(probes)

    def count(batches):
        p = _columns(shared.value)
        for batch in batches:
            k = [batch.column(x).to_numpy() for x in "abcd"]
            bins = _below(k, p)
            order = np.lexsort(k[::-1])  # bins ascend with the keys
            b = bins[order]
            first = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(b)) - 1 if len(b) else first
            size = np.add.reduceat(batch.column("size").to_numpy()[order], first) if len(b) else first
            ends = [pa.array(x[order][at]) for at in (first, last) for x in k]
            yield pa.RecordBatch.from_arrays([pa.array(b[first]), pa.array(size), pa.array(last - first + 1), *ends],
                                             names=["bin", "size", "rows", *firsts, *lasts])

    firsts, lasts = [f"{x}0" for x in "abcd"], [f"{x}1" for x in "abcd"]
    found = keys.mapInArrow(count, "bin long, size long, rows long, " + ", ".join(f"{x} long" for x in firsts + lasts))
    return (found.groupBy("bin").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.min(F.struct(*firsts)).alias("first"),
                                     F.max(F.struct(*lasts)).alias("last")).orderBy("bin").collect())  # a row a bin at most


_SPAN = 1 << 64


def _number(key: Key) -> int:
    """The key as one integer in the same order."""
    n = 0
    for x in key:
        n = n * _SPAN + x + (1 << 63)
    return n


def _key(number: int) -> Key:
    out = []
    for _ in range(4):
        number, x = divmod(number, _SPAN)
        out.append(x - (1 << 63))
    return tuple(out[::-1])


def splitters(keys: DataFrame, total: int, n_rows: int, targets: list[int], tolerance: int) -> list[tuple[Key, int]]:
    """(key, rows below it) for each target number of bytes, ascending.

    The bytes below a splitter differ from its target by ``tolerance`` at
    most, or by less than one row. A round counts below evenly
    spread probes of every open interval; the interval then shrinks to the
    first and last key of the bin that holds the target.
    """
    top = _SPAN ** 4
    done: dict[int, tuple[int, int]] = {}
    open_ = {i: (0, top) for i in range(len(targets))}  # interval of keys that may hold the splitter
    every = {top * k // (FIRST_PROBES * (len(targets) + 1)) for k in range(1, FIRST_PROBES * (len(targets) + 1))}
    while open_:
        probes = sorted(every or {lo + (hi - lo) * k // (PROBES + 1) for lo, hi in open_.values() for k in range(PROBES + 2)} - {0, top})
        every = set()
        below, rows_below = 0, 0
        waiting = sorted(open_)
        for r in histogram(keys, [_key(x) for x in probes]):
            first, last = _number(tuple(r["first"])), _number(tuple(r["last"]))
            while waiting and targets[waiting[0]] <= below + r["size"]:
                i = waiting.pop(0)
                before, after = targets[i] - below, below + r["size"] - targets[i]
                if min(before, after) <= tolerance or first == last:
                    done[i] = (first, rows_below) if before < after else (last + 1, rows_below + r["rows"])
                    del open_[i]
                else:
                    open_[i] = (first, last + 1)
            below, rows_below = below + r["size"], rows_below + r["rows"]
        for i in waiting:  # only if the table changed under the count
            raise RuntimeError(f"target {targets[i]} lies beyond the {total} bytes counted")
    return [(_key(min(done[i][0], top - 1)), done[i][1]) for i in sorted(done)]


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS,
                    tolerance: float = TOLERANCE, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1, near equal bytes) and ``slot`` (gapless from 0).

    A row counts its text's UTF-8 bytes plus 16. Shards follow the key order;
    equal texts share a shard unless their bytes cross its border. Null texts
    count 16 bytes and stand together; null ids come first; repeated rows are
    placed as often as they come, and cut apart where the bytes demand it. An
    empty table stays empty; all columns are returned, so one named ``shard``
    or ``slot`` already is an error (name the new ones otherwise).
    """
    spark = docs.sparkSession
    if {shard.lower(), slot.lower()} & {x.lower() for x in docs.columns}:
        raise ValueError(f"columns {shard} and {slot} must be new")
    a, b, c, d, n = (fresh(docs, x) for x in ("key_a", "key_b", "key_c", "key_d", "interval"))
    keyed = materialize(with_keys(docs, doc_id, text, a, b, c, d), "shard-rows")  # the place in the table must stay as it is
    keys = keyed.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"), F.col(d).alias("d"), (text_bytes(F.col(text)) + ROW_BYTES).alias("size"))
    keys = materialize(keys, "shard-keys")
    sums = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("rows")).first()
    parts = max(1, min(MAX_SPLITTERS // shards, -(-sums["size"] // (shards * PART_BYTES))))
    targets = [sums["size"] * k // (shards * parts) for k in range(1, shards * parts)] if sums["rows"] else []
    found = splitters(keys, sums["size"], sums["rows"], targets, int(sums["size"] / shards * tolerance))
    cuts, first = [k for k, _ in found], [0, *(rows for _, rows in found)]
    shared = spark.sparkContext.broadcast(cuts)

    @F.arrow_udf("int")
    def interval(w: pa.Array, x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        cols = [v.to_numpy() for v in (w, x, y, z)]
        return pa.array((_below(cols, _columns(shared.value)) if shared.value else np.zeros(len(w))).astype(np.int32))

    starts = [first[k] - first[k // parts * parts] for k in range(len(first))]
    placed = keyed.withColumn(n, interval(a, b, c, d))
    rank = F.expr(f"row_number() over (partition by `{n}` order by `{a}`, `{b}`, `{c}`, `{d}`)")
    start = F.element_at(F.lit(np.array(starts, np.int64)), F.col(n) + 1)
    return (placed.withColumn(slot, (start + rank - 1).cast("long"))
            .withColumn(shard, F.floor(F.col(n) / parts).cast("int")).drop(a, b, c, d, n))
