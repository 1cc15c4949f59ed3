"""Alignment of two tokenizers' tokens over the same bytes.

Byte offsets where a token of both ends cut a text into groups; tokens whose
byte ranges overlap are linked, and links never leave a group. What a byte
range of a text contributes is a fragment: an open prefix (the tokens that end
before the first common end in the range), closed groups, and an open suffix
(the tokens after the last common end). Two adjacent fragments compose to the
fragment of the joined range: the suffix of the one and the prefix of the
other close one group. Composition is associative, so a very long document is
cut into byte ranges, the ranges are tokenised in tasks of their own, and
their fragments are composed in a tree, ``FAN`` neighbours a step, across
tasks. A range may cut a token; it belongs to the range where it ends.

A range is tokenised within a window that reaches to the next safe place on
both sides: a blank between a character that is no blank and one that is no
white space, over which neither tokenizer joins. Stretches between safe places
(parts) are closed fragments by themselves and are remembered per worker.

How many documents hold a pair of ids linked is counted over the whole table
from every document's distinct pairs, summed within tasks before the shuffle.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import salted_join
from ..session import materialize
from . import bpe
from .common import uncollected

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
RANGE = 1 << 16            # bytes of a range; longer documents are cut
FAN = 16                   # neighbouring fragments composed in a step
MEMO_BYTES = 160 << 20     # bytes of parts and their fragments remembered, in two generations
ENTRY = 350                # bytes that an entry of the memo takes besides its strings
LONG = 256                 # characters above which a part is not remembered
STRETCH = 1 << 22          # characters of text whose new parts are tokenised together
COUNTED = 1 << 22          # pairs that a task counts before it hands them on
SENT_PAIRS = 1 << 22       # pairs whose counts are sent to the tasks; more are joined

#: A part ends before a blank between a character that is no blank and one that is no white space.
PARTS = re.compile(r"(?<=[^ ]) (?=\S)").split
#: The same in UTF-8, without the first bytes that white space may begin with.
SAFE = re.compile(rb"(?<=[^ ]) (?=[!-~\xc3-\xe0\xe4-\xf4])")


@dataclass
class Fragment:
    """What a byte range contributes; without a common end all its tokens are ``head_*``."""

    cut: bool = False
    ok: bool = True                                     # the tokens' bytes are the text's
    head_a: list[int] = field(default_factory=list)     # open prefix
    head_b: list[int] = field(default_factory=list)
    tail_a: list[int] = field(default_factory=list)     # open suffix
    tail_b: list[int] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)     # closed groups
    n_groups: int = 0
    n_a: int = 0                                        # all tokens that end in the range
    n_b: int = 0
    pairs: list[bytes] = field(default_factory=list)    # linked pairs of closed groups, one entry an occurrence


class Aligner:
    """Both tokenizers, and the closed fragments of parts."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a = bpe.Encoder(path_a, special=False)
        self.b = SentencePieceProcessor(model_file=path_b)
        size = self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(size)))]
        if any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(size)):
            raise ValueError("a piece reaches over the start of a word")
        self.len_a, self.len_b, self.base = self.a.vocab.length, list(map(len, self.bytes_b)), size
        self.kind = np.dtype("<i4" if len(self.a.vocab.bytes) * size < 1 << 31 else "<i8")
        self.memo: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.held = 0

    def close(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]]:
        """(groups, links) of tokens that begin and end together; a link is a * base + b."""
        groups, links, base, len_a, len_b = [], [], self.base, self.len_a, self.len_b
        i = j = first_a = first_b = ahead = 0  # ahead: bytes by which the present a ends after the present b
        n = len(a)
        while i < n:
            x, y = a[i], b[j]
            ahead += len_a[x] - len_b[y]
            links.append(x * base + y)
            while ahead:
                if ahead < 0:
                    i += 1
                    x = a[i]
                    ahead += len_a[x]
                else:
                    j += 1
                    y = b[j]
                    ahead -= len_b[y]
                links.append(x * base + y)
            i, j = i + 1, j + 1
            if i - first_a == j - first_b == 1:
                groups.append(f"{x}|{y}")
            else:
                groups.append(",".join(map(str, a[first_a:i])) + "|" + ",".join(map(str, b[first_b:j])))
            first_a, first_b = i, j
        return groups, links

    def parts(self, parts: Iterable[str]) -> dict[str, tuple]:
        """part -> (groups as text or None if its bytes differ, number of groups, of a tokens, of b tokens, links)."""
        if self.held > MEMO_BYTES // 2:
            self.old, self.memo, self.held = self.memo, {}, 0
        memo, old = self.memo, self.old
        new = {p for p in parts if p not in memo}
        made = {p: old[p] for p in new if p in old}
        todo = list(new - made.keys())
        ids_a, pack, code = self.a.learn(todo), struct.pack, self.kind.char
        table_b = self.bytes_b
        for p, b in zip(todo, self.b.encode(todo, num_threads=1) if todo else [], strict=True):
            raw = ids_a[p]
            a = struct.unpack(f"<{len(raw) // 4}I", raw)  # byte-level: its bytes are the text's
            if b"".join([table_b[x] for x in b]) != (" " + p).encode():
                made[p] = (None, 0, 0, 0, b"")
            else:
                groups, links = self.close(a, b)
                made[p] = (";".join(groups), len(groups), len(a), len(b), pack(f"<{len(links)}{code}", *links))
        short = {p: v for p, v in made.items() if len(p) <= LONG}
        self.held += sum(2 * len(p) + len(v[0] or "") + len(v[4]) + ENTRY for p, v in short.items())
        memo |= short
        return memo if len(short) == len(made) else memo | made

    def whole(self, texts: list[str]) -> list[Fragment]:
        """Fragments of whole, not empty texts: products of their parts' closed fragments."""
        out, cut, size = [], [], 0
        for k, t in enumerate(texts):
            cut.append(PARTS(t))
            size += len(t)
            if size > STRETCH or k == len(texts) - 1:
                known = self.parts({p for ps in cut for p in ps})
                for ps in cut:
                    groups, n, n_a, n_b, links = zip(*[known[p] for p in ps], strict=True)
                    if None in groups:
                        out.append(Fragment(True, False))
                    else:
                        out.append(Fragment(True, groups=list(groups), n_groups=sum(n), n_a=sum(n_a), n_b=sum(n_b), pairs=list(links)))
                cut, size = [], 0
        return out

    def fragment(self, window: str, offset: int, start: int, stop: int) -> Fragment:
        """Fragment of the bytes (start, stop]; ``window`` is the text after the blank at ``offset``."""
        parts = PARTS(window)
        known = self.parts(set(parts))
        if any(known[p][0] is None for p in parts):
            return Fragment(start == 0, False)
        sides = [g.split("|") for p in parts for g in known[p][0].split(";")]
        a, b = (np.array([int(x) for s in sides for x in s[k].split(",")], np.int64) for k in (0, 1))
        ends_a, ends_b = (offset + np.cumsum(np.array(n)[x]) for n, x in ((self.len_a, a), (self.len_b, b)))
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        common = common[(common > start) & (common <= stop)]
        in_a, in_b = (ends_a > start) & (ends_a <= stop), (ends_b > start) & (ends_b <= stop)
        f = Fragment(n_a=int(in_a.sum()), n_b=int(in_b.sum()), cut=start == 0 or len(common) > 0)

        def between(lo: int, hi: int) -> tuple[list[int], list[int]]:
            return a[(ends_a > lo) & (ends_a <= hi)].tolist(), b[(ends_b > lo) & (ends_b <= hi)].tolist()

        if not f.cut:
            f.head_a, f.head_b = between(start, stop)
            return f
        first, last = (0 if start == 0 else int(common[0])), (int(common[-1]) if len(common) else 0)
        f.head_a, f.head_b = between(start, first)
        f.tail_a, f.tail_b = between(last, stop)
        f.groups, links = self.close(*between(first, last))
        f.n_groups, f.pairs = len(f.groups), [np.array(links, self.kind).tobytes()]
        return f

    def compose(self, left: Fragment, right: Fragment) -> Fragment:
        """Fragment of the joined range (``left`` is used up)."""
        out = left
        out.ok, out.n_a, out.n_b = left.ok and right.ok, left.n_a + right.n_a, left.n_b + right.n_b
        if not out.ok:
            return Fragment(left.cut or right.cut, False)
        if not right.cut:
            to_a, to_b = (out.tail_a, out.tail_b) if out.cut else (out.head_a, out.head_b)
            to_a += right.head_a
            to_b += right.head_b
            return out
        if out.cut:
            groups, links = self.close(out.tail_a + right.head_a, out.tail_b + right.head_b)
            out.groups += groups
            out.n_groups += len(groups)
            out.pairs.append(np.array(links, self.kind).tobytes())
        else:
            out.head_a, out.head_b, out.cut = out.head_a + right.head_a, out.head_b + right.head_b, True
        out.groups += right.groups
        out.pairs += right.pairs
        out.n_groups += right.n_groups
        out.tail_a, out.tail_b = right.tail_a, right.tail_b
        return out


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """The worker's aligner (its memo outlives a task)."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def ranges(text: str, size: int) -> list[tuple[int, int, int, str]]:
    """(start, stop, offset, window) of the byte ranges of blank + text.

    A border stands at a multiple of ``size`` with safe places near on both
    sides; where there is none (one endless word) the ranges stay one.
    """
    raw = b" " + text.encode("utf-8", "surrogatepass")
    borders = [(0, 0, 0)]  # (border, safe place before or at it, safe place at or after it)
    for at in range(size, len(raw), size):
        before = [m.start() for m in SAFE.finditer(raw, at - size // 2, at + 2)]
        after = SAFE.search(raw, at - 1, at + size // 2)
        before = [x for x in before if x <= at]
        while after and after.start() < at:
            after = SAFE.search(raw, after.end(), at + size // 2)
        if before and after:
            borders.append((at, before[-1], after.start()))
    borders.append((len(raw), len(raw), len(raw)))
    return [(lo, hi, w, raw[w + 1:end].decode("utf-8", "surrogatepass")) for (lo, w, _), (hi, _, end) in zip(borders, borders[1:], strict=False)]


def _row(i: int, tag: int) -> int:
    return (TaskContext.get().partitionId() << 33 | i) * 2 + tag


class _Rows:
    """Arrow rows of fragments; ``doc_id`` has the documents' type."""

    def __init__(self, doc_type: T.DataType, keys: str):
        open_ = "row long, chunk int, ok boolean, cut boolean, head_a binary, head_b binary, tail_a binary, tail_b binary, groups string"
        done = "row long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string"
        counts = f", keys array<{keys}>, times array<int>"
        self.open = T.StructType([T.StructField("doc_id", doc_type), *_struct(open_ + ", n_a long, n_b long, n_groups long" + counts)])
        self.done = T.StructType([T.StructField("doc_id", doc_type), *_struct(done + counts)])


def _struct(ddl: str) -> list[T.StructField]:
    return list(T.StructType.fromDDL(ddl).fields)


def _tally(pairs: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.frombuffer(b"".join(pairs), kind), return_counts=True)


def _lists(values: list[np.ndarray], kind: np.dtype) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, kind)]).astype(kind)))


def _done(ids: pa.Array, rows: list[int], fragments: list[Fragment | None], tallies: list, kind: np.dtype, schema: T.StructType, texts: bool) -> pa.RecordBatch:
    """Finished documents; None or a fragment that is not ok has no tokens."""
    none = Fragment()
    fs = [f if f is not None and f.ok else none for f in fragments]
    tallies = [t if f.n_groups else (np.zeros(0, kind), np.zeros(0, np.int32)) for f, t in zip(fs, tallies, strict=True)]
    groups = [";".join(f.groups) for f in fs]
    cols = {"doc_id": ids, "row": pa.array(rows, pa.int64()), "n_a": pa.array([f.n_a for f in fs], pa.int64()), "n_b": pa.array([f.n_b for f in fs], pa.int64()),
            "n_groups": pa.array([f.n_groups for f in fs], pa.int64()), "n_links": pa.array([int(t[1].sum()) for t in tallies], pa.int64()),
            "groups": pa.array(groups if texts else [None] * len(fs), pa.string()),
            "groups_sha256": pa.array([sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
            "keys": _lists([t[0] for t in tallies], kind), "times": _lists([t[1] for t in tallies], np.dtype("<i4"))}
    return pa.RecordBatch.from_arrays([cols[f.name] for f in schema], names=schema.names)


def _open(ids: pa.Array, rows, chunks, fragments: list[Fragment], tallies: list, kind: np.dtype, schema: T.StructType) -> pa.RecordBatch:
    def packed(name: str) -> pa.Array:
        return pa.array([np.array(getattr(f, name), "<u4").tobytes() for f in fragments], pa.binary())

    cols = {"doc_id": ids, "row": pa.array(rows, pa.int64()), "chunk": pa.array(chunks, pa.int32()), "groups": pa.array([";".join(f.groups) for f in fragments], pa.string()),
            **{c: pa.array([getattr(f, c) for f in fragments], pa.bool_()) for c in ("ok", "cut")}, **{c: packed(c) for c in ("head_a", "head_b", "tail_a", "tail_b")},
            **{c: pa.array([getattr(f, c) for f in fragments], pa.int64()) for c in ("n_a", "n_b", "n_groups")},
            "keys": _lists([t[0] for t in tallies], kind), "times": _lists([t[1] for t in tallies], np.dtype("<i4"))}
    return pa.RecordBatch.from_arrays([cols[f.name] for f in schema], names=schema.names)


def _short(docs: DataFrame, paths: tuple[str, str], rows: _Rows, texts: bool) -> DataFrame:
    """Documents of one range: finished at once."""

    def run(batches):
        al, n = aligner(paths), 0
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                sub = b.slice(s, 1024)
                values = sub.column("text").to_pylist()
                with uncollected():
                    made = iter(al.whole([t for t in values if t]))
                fs = [next(made) if t else None for t in values]
                tallies = [_tally(f.pairs if f else [], al.kind) for f in fs]
                yield _done(sub.column("doc_id"), [_row(n + i, 0) for i in range(len(fs))], fs, tallies, al.kind, rows.done, texts)
                n += len(fs)

    return docs.mapInArrow(run, rows.done)


def _cut(docs: DataFrame, size: int, doc_type: T.DataType) -> DataFrame:
    """(doc_id, row, chunk, start, stop, offset, window): the ranges of long documents."""
    schema = T.StructType([T.StructField("doc_id", doc_type), *_struct("row long, chunk int, start long, stop long, offset long, window string")])

    def run(batches):
        n = 0
        for b in batches:
            for i, t in enumerate(b.column("text").to_pylist()):
                for k, (start, stop, offset, window) in enumerate(ranges(t, size)):
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), *(pa.array([v], y) for v, y in (
                        (_row(n + i, 1), pa.int64()), (k, pa.int32()), (start, pa.int64()), (stop, pa.int64()), (offset, pa.int64()), (window, pa.string())))], names=schema.names)
            n += b.num_rows

    return docs.mapInArrow(run, schema)


def _fragments(cut: DataFrame, paths: tuple[str, str], rows: _Rows) -> DataFrame:
    def run(batches):
        al = aligner(paths)
        for b in batches:
            c = {name: b.column(name) for name in b.schema.names}
            for i in range(b.num_rows):
                f = al.fragment(*(c[name][i].as_py() for name in ("window", "offset", "start", "stop")))
                yield _open(c["doc_id"].slice(i, 1), [c["row"][i].as_py()], [c["chunk"][i].as_py()], [f], [_tally(f.pairs, al.kind)], al.kind, rows.open)

    return cut.mapInArrow(run, rows.open)


def _composed(table: pa.Table, al: Aligner) -> tuple[Fragment, tuple[np.ndarray, np.ndarray]]:
    """Product of adjacent fragments and the sum of their tallies."""
    table = table.sort_by("chunk")
    out, keys, times = None, [], []
    for r in table.drop_columns(["keys", "times", "doc_id"]).to_pylist():
        f = Fragment(r["cut"], r["ok"], *(np.frombuffer(r[c], "<u4").tolist() for c in ("head_a", "head_b", "tail_a", "tail_b")),
                     [r["groups"]] if r["groups"] else [], r["n_groups"], r["n_a"], r["n_b"])
        out = f if out is None else al.compose(out, f)
    for c, held in (("keys", keys), ("times", times)):
        held.append(table.column(c).combine_chunks().flatten().to_numpy())
    closed, n = _tally(out.pairs, al.kind)  # groups that the borders closed
    key, at = np.unique(np.concatenate([*keys, closed]), return_inverse=True)
    return out, (key, np.bincount(at, weights=np.concatenate([*times, n]), minlength=len(key)).astype(np.int32))


def _reduced(fragments: DataFrame, paths: tuple[str, str], rows: _Rows, texts: bool) -> DataFrame:
    """Finished long documents: neighbours are composed, ``FAN`` at a time, until one fragment is left."""

    def step(key, table):
        al = aligner(paths)
        f, tally = _composed(table, al)
        return pa.Table.from_batches([_open(table.column("doc_id").combine_chunks().slice(0, 1), [key[0].as_py()], [key[1].as_py()], [f], [tally], al.kind, rows.open)])

    def last(key, table):
        al = aligner(paths)
        f, tally = _composed(table, al)
        return pa.Table.from_batches([_done(table.column("doc_id").combine_chunks().slice(0, 1), [key[0].as_py()], [f], [tally], al.kind, rows.done, texts)])

    most = fragments.agg(F.max("chunk")).first()[0] + 1
    while most > FAN:
        fragments = materialize(fragments.withColumn("chunk_", F.floor(F.col("chunk") / FAN).cast("int")).groupBy("row", "chunk_").applyInArrow(step, rows.open), "align-composed")
        most = -(-most // FAN)
    return fragments.groupBy("row").applyInArrow(last, rows.done)


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None,
          texts: bool = True, size: int = RANGE) -> DataFrame:
    """One row per input row, written: (doc_id, row, n_a, n_b, n_groups, n_links, groups, groups_sha256, keys, times).

    ``row`` tells rows apart, ``groups`` is ``a1,a2|b1;a3|b2`` (null unless
    ``texts``), ``groups_sha256`` its lowercase hex digest, ``keys`` the
    distinct linked pairs as ``a * pieces of B + b`` and ``times`` how often
    each is linked. Null and empty texts, and texts whose tokens' bytes differ
    from blank + text, have no tokens (zeros, '' and empty arrays). Null ids
    are kept, repeated rows stay repeated, other columns are not read, texts of
    any length are taken whole. An empty table gives an empty table.
    """
    paths = (path_a or bpe.tokenizer_path(VOCABULARY_A), path_b or bpe.tokenizer_path(VOCABULARY_B))
    doc_type = docs.schema[doc_id].dataType
    rows = _Rows(doc_type, "int" if aligner(paths).kind.itemsize == 4 else "bigint")
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > size, F.lit(False))
    short = materialize(_short(chosen.where(~is_long), paths, rows, texts), "align-short")
    cut = _cut(chosen.where(is_long), size, doc_type).repartition("row", "chunk")
    fragments = materialize(_fragments(cut, paths, rows), "align-fragments")
    if fragments.isEmpty():
        return short
    return short.unionByName(materialize(_reduced(fragments, paths, rows, texts), "align-long"))


def pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """(key, n, best), written: how many rows of ``aligned`` hold each linked pair, and whether no pair of its A id has more."""

    def count(batches):
        held, size = [], 0

        def hand_on():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

        for b in batches:
            held.append(b.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size > COUNTED:
                yield hand_on()
                held, size = [], 0
        if size:
            yield hand_on()

    sums = aligned.select("keys").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("key") / base))  # at most ``base`` pairs
    return materialize(sums.withColumn("best", F.col("n") == F.max("n").over(of_a)), "align-pairs")


def weigh(aligned: DataFrame, pairs: DataFrame, sent: int = SENT_PAIRS) -> DataFrame:
    """``aligned`` with n_best and count_sum, from the pairs' counts over all documents.

    Up to ``sent`` pairs go to every task as arrays; more are joined, in buckets by row, so that a pair
    that every document holds is spread.
    """
    spark = aligned.sparkSession
    rest = [f for f in aligned.schema.fields if f.name not in ("keys", "times")]
    schema = T.StructType([*rest, *_struct("n_best long, count_sum long")])
    if pairs.count() > sent:
        held = aligned.select("row", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("row", F.col("p.keys").cast("long").alias("key"), "p.times")
        sums = (salted_join(held, pairs, ["key"], "row").groupBy("row")
                .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")))
        return (aligned.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
                .select(*schema.names))
    table = pairs.toArrow().sort_by("key")
    kind = np.int32 if aligned.schema["keys"].dataType.elementType == T.IntegerType() else np.int64
    shared = spark.sparkContext.broadcast((table["key"].to_numpy().astype(kind), table["n"].to_numpy(), table["best"].to_numpy(zero_copy_only=False)))

    def run(batches):
        keys, n, best = shared.value
        for b in batches:
            lists, times = b.column("keys"), b.column("times").flatten().to_numpy()
            at = np.searchsorted(keys, lists.flatten().to_numpy())
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(w)])[ends] for w in (times * best[at], times * n[at])]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), *(pa.array(np.diff(s).astype(np.int64)) for s in sums)], names=schema.names)

    return aligned.mapInArrow(run, schema)


def alignment(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None,
              texts: bool = True, size: int = RANGE) -> DataFrame:
    """``align`` with the corpus-wide weights of its links in place of the pairs."""
    aligned = align(docs, doc_id, text, path_a, path_b, texts, size)
    base = aligner((path_a or bpe.tokenizer_path(VOCABULARY_A), path_b or bpe.tokenizer_path(VOCABULARY_B))).base
    return weigh(aligned, pair_counts(aligned, base))
