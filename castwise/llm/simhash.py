"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22 + 21 + 21 bits), each
read as a 23-bit vector. The binary Golay code is perfect: every vector lies
within 3 bits of exactly one codeword and within 4 bits of 1 or 6. The
indices (12 bits) of those codewords are the segment's keys:

* vectors at distance <= 1: the nearest codeword of one is a key of the other;
* vectors at distance <= 2: they share a key.

Pigeonhole over 4 errors in 3 segments gives two cases:

* some segment is equal. Of the other two, one has at most 2 errors: the
  equal segment with any key of the other one is a common composite key;
* no segment is equal. Then two segments have exactly 1 error and the third
  at most 2, so one of its three parts is equal. Composite key: nearest index
  of the one segment, any key of the other (crosswise on the two sides), the
  equal part, and the parities of the two segments, which differ.

Every link within 4 bits so shares a composite key of 33 bits or more (about
130 keys a fingerprint); joined candidates are verified on all 64 bits.

A bucket of many near copies must not be expanded into pairs. Each bucket is
first linked to its smallest member (verified), those stars are contracted to
components, and only buckets that still hold several components stay. While
their members would make many pairs, every such bucket is linked to one more
member and contracted again. What is left is joined, between different
components only. No link between components is lost.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import grid_join, lookup_join
from ..session import materialize
from .common import fresh
from .components import components

#: Generator polynomial of the binary Golay code (fixed value).
GOLAY_POLY, GOLAY_BITS, PARITY_BITS = 0xC75, 23, 11
#: Bits of the three segments, lowest first.
SEGMENTS = (22, 21, 21)
#: First bits of the parts of a segment, and its end.
PARTS, PART_SHIFT = 3, (0, 7, 14, 22)
MAX_BITS = 4
SEED = 42
KEY_TASK = 1 << 14  # fingerprints whose keys one task makes
BLOCK = 1 << 15  # shingles expanded to bits at a time
PAIRS = 16       # candidate pairs a row of the open buckets may make; contracted further while there are more
CELL = 1 << 12   # rows of one hot key that one task joins


def _remainder(x: int) -> int:
    for i in range(GOLAY_BITS - 1, PARITY_BITS - 1, -1):
        if x >> i & 1:
            x ^= GOLAY_POLY << (i - PARITY_BITS)
    return x


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes by byte (3 x 256) and, per syndrome, the error patterns of
    weight <= 4, nearest first (2048 x 6, -1 where there is none)."""
    bit = [_remainder(1 << i) for i in range(GOLAY_BITS)]
    byte = np.zeros((3, 256), np.int64)
    for k in range(3):
        for x in range(256):
            for i in range(8):
                if x >> i & 1 and 8 * k + i < GOLAY_BITS:
                    byte[k, x] ^= bit[8 * k + i]
    errors = np.full((1 << PARITY_BITS, 6), -1, np.int64)
    used = np.zeros(1 << PARITY_BITS, np.int64)
    for weight in range(5):
        for at in combinations(range(GOLAY_BITS), weight):
            s = 0
            for i in at:
                s ^= bit[i]
            errors[s, used[s]] = sum(1 << i for i in at)
            used[s] += 1
    return byte, errors


def segment_keys(v: np.ndarray) -> np.ndarray:
    """Codeword indices within 4 bits of each 23-bit vector, nearest first; -1 pads (n x 6)."""
    byte, errors = _golay()
    s = byte[0][v & 255] ^ byte[1][v >> 8 & 255] ^ byte[2][v >> 16]
    e = errors[s]
    return np.where(e < 0, -1, (v[:, None] ^ np.maximum(e, 0)) >> PARITY_BITS)


def composite_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) of all composite keys; side 0 joins side 1, side 2 joins itself."""
    segs, shift = [], 0
    for bits in SEGMENTS:
        segs.append(((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64))
        shift += bits
    keys = [segment_keys(s) for s in segs]
    odd = [(np.bitwise_count(s) & 1).astype(np.int64)[:, None] for s in segs]
    rows, out, sides = [], [], []
    n = np.arange(len(fp))

    def add(tag: int, code: np.ndarray, ok: np.ndarray, side: int) -> None:
        r = np.broadcast_to(n[:, None], code.shape)
        rows.append(r[ok])
        out.append((code | np.int64(tag) << 56)[ok])
        sides.append(np.full(int(ok.sum()), side, np.int8))

    for tag, (i, j) in enumerate(permutations(range(3), 2)):
        add(tag, segs[i][:, None] << 12 | keys[j], keys[j] >= 0, 2)
    tag = 6
    for i, j in combinations(range(3), 2):
        k = 3 - i - j
        for p in range(PARTS):
            part = (segs[k] >> PART_SHIFT[p] & ((1 << PART_SHIFT[p + 1] - PART_SHIFT[p]) - 1))[:, None] << 26
            add(tag, part | keys[i][:, :1] << 14 | keys[j] << 2 | odd[i] << 1 | odd[j], keys[j] >= 0, 0)
            add(tag, part | keys[i] << 14 | keys[j][:, :1] << 2 | (1 - odd[i]) << 1 | (1 - odd[j]), keys[i] >= 0, 1)
            tag += 1
    return np.concatenate(rows), np.concatenate(out), np.concatenate(sides)


def fingerprint(text: str | None, shingle: int = 4, seed: int = SEED) -> int:
    """SimHash of one text: majority bits of XXH64 over word shingles (unsigned)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h64, n, ones = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    for s in range(0, n, BLOCK):
        part = words[s:s + BLOCK + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter((h64(g, seed) for g in grams), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, out: str = "fp") -> DataFrame:
    """``docs`` without ``text`` but with the 64-bit fingerprint (signed long) as ``out``."""
    from pyspark.sql import types as T

    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(out, T.LongType())])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(fp)], names=[*rest, out])

    return docs.mapInArrow(run, schema)


def golay_keys(fps: DataFrame) -> DataFrame:
    """(key, fp, side): every composite key of every fingerprint in column ``fp``."""

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy()
            for s in range(0, len(fp), 4096):
                row, key, side = composite_keys(fp[s:s + 4096].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[s:s + 4096][row]), pa.array(side)], names=["key", "fp", "side"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, side byte")


def _near(a: str, b: str, max_bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def _relabel(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``comp`` replaced by the root that ``found`` (node, root) names for it, if any."""
    named = lookup_join(rows, found.select(F.col("node").alias("comp"), "root"), ["comp"], cell_rows=CELL)
    return named.withColumn("comp", F.coalesce("root", "comp")).select(*rows.columns)


def _labelled(shared: DataFrame, star: DataFrame) -> DataFrame:
    """(key, fp, side, comp): each key of a fingerprint with the root that ``star`` names for the fingerprint, or itself.

    A fingerprint has some 130 keys at most: one row carries them all to its label.
    """
    held = shared.groupBy("fp").agg(F.collect_list(F.struct("key", "side")).alias("held"))
    named = held.join(star, F.col("fp") == F.col("node"), "left")
    return named.select("fp", F.coalesce("root", "fp").alias("comp"), F.inline("held")).select("key", "fp", "side", "comp")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components."""
    keys = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return rows.join(keys, "key", "left_semi")


def _pairs_a_row(rows: DataFrame) -> float:
    """Ordered pairs of rows in one bucket but different components, by row."""
    n = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    n = n.groupBy("key").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("own"))
    r = n.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n") - F.col("own")).alias("pairs")).first()
    return r.pairs / r.rows if r.rows else 0.0


def fingerprint_components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) for the distinct fingerprints ``fps`` under links of <= max_bits bits.

    ``max_bits`` may be 0 to 4 (the pigeonhole argument covers 4 errors).
    Fingerprints without a link are their own root.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the Golay keys cover distances 0 to 4")
    # a fingerprint becomes some 130 rows: the few files of the small table must not make them all in two tasks
    tasks = max(1, -(-fps.count() // KEY_TASK))
    keys = golay_keys(fps.select("fp").repartition(tasks, "fp"))  # cheaper to make twice than to keep: about 130 rows a fingerprint
    heads = keys.groupBy("key").agg(F.min("fp").alias("head"), F.max("fp").alias("last")).where("head <> last").drop("last")
    # sized as the fingerprints that they are made of, of which they are some 130 times as many: never sent to the driver
    shared = materialize(keys.hint("merge").join(heads, "key"), "golay-shared")
    star = components(shared.where("fp <> head").where(_near("fp", "head", max_bits)), "fp", "head")
    rows = materialize(_mixed(_labelled(shared, star)), "golay-open")
    labels = _relabel(fps.select("fp", F.col("fp").alias("comp")), star)
    turn = 0
    while _pairs_a_row(rows) > PAIRS:
        turn += 1
        pick = F.min(F.struct(F.xxhash64("fp", F.lit(turn)).alias("o"), "fp", "comp")).alias("m")
        head = rows.groupBy("key").agg(pick).select("key", F.col("m.fp").alias("head"), F.col("m.comp").alias("to"))
        links = rows.join(head, "key").where((F.col("comp") != F.col("to")) & _near("fp", "head", max_bits)).select("comp", "to")
        more = components(links, "comp", "to")
        if more.isEmpty():  # the buckets hold strangers: only comparing them all can tell
            break
        labels = materialize(_relabel(labels, more), "golay-labels")
        rows = materialize(_mixed(_relabel(rows, more)), "golay-open")
    left = rows.where("side <> 1").select("key", F.col("fp").alias("fa"), F.col("comp").alias("ca"))
    right = rows.where("side <> 0").select("key", F.col("fp").alias("fb"), F.col("comp").alias("cb"))
    cross = grid_join(left, right, ["key"], CELL).where((F.col("fa") < F.col("fb")) & (F.col("ca") != F.col("cb")) & _near("fa", "fb", max_bits))
    top = components(cross.select("ca", "cb"), "ca", "cb")
    return _relabel(labels, top).select("fp", F.col("comp").alias("root"))


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
                   max_bits: int = MAX_BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: (doc_id, *keep, fp, root, component_id).

    component_id is the smallest doc_id reachable over links of ``max_bits``
    or fewer differing bits, the row's own included; root is the smallest
    fingerprint reachable. Null and word-less texts have fingerprint zero and
    link like any other; repeated rows stay repeated; a null doc_id never names
    a component (null only if all its ids are null). An empty table gives an
    empty table; other columns are not read.
    """
    cols = [doc_id, *keep]
    f = materialize(fingerprints(docs.select(*cols, text), text, shingle), "fingerprints")
    uniq = materialize(f.groupBy("fp").agg(F.min(doc_id).alias("first_id")), "fingerprints-distinct")
    roots = materialize(fingerprint_components(uniq, max_bits), "fingerprint-roots")
    tagged = uniq.join(roots, "fp")
    smallest = tagged.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # one group, or the copies of one text, may be a large share of the rows
    ids = lookup_join(tagged, smallest, ["root"], "inner", CELL).select("fp", "root", "component_id")
    return lookup_join(f, ids, ["fp"], "inner", CELL).select(*cols, "fp", "root", "component_id")


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
                       max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest doc_id.

    Rows that repeat that id are told apart by a hash of their text, and of
    rows equal in both exactly one stays. A group without any id keeps the row
    with the smallest hash. All columns are returned unchanged.
    """
    h, kept_id, kept_h = (fresh(docs, c) for c in ("text_hash", "kept_id", "kept_hash"))
    hashed = docs.withColumn(h, F.xxhash64(text))
    groups = materialize(simhash_groups(hashed, doc_id, text, shingle, max_bits, keep=(h,)), "near-groups")
    # the struct orders rows with an id before rows without one
    order = F.struct(F.col(doc_id).isNull().alias("no"), F.col(doc_id).alias("id"), F.col(h).alias("h"))
    best = groups.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.id").alias(kept_id), F.col("m.h").alias(kept_h))
    same = F.col(doc_id).eqNullSafe(F.col(kept_id)) & (F.col(h) == F.col(kept_h))
    kept = hashed.join(best, same, "left_semi")
    if not groups.groupBy(doc_id, h).count().where("count > 1").join(best, same, "left_semi").isEmpty():
        kept = kept.dropDuplicates([doc_id, h])
    return kept.drop(h)
