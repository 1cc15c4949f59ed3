"""Byte-pair encoding through a trie of words that share their prefixes.

A prefix of a byte-pair encoding is the encoding of the bytes it covers, so a
byte string's encoding is known by one number for each of its prefixes: the
last token of the prefix's encoding. For a prefix of n bytes that is the one
token t that ends there and is compatible with the last token of the prefix of
n - |t| bytes.

Distinct words are put into a trie in sorted order, which is a depth-first
walk: every node keeps its prefix's last token, computed once for all words
below it, and a word's ids are read off by stepping back from its end.

Two tokens are compatible if the merges never join across their border. The
symbols beside the border are the right spine of one token's merge tree and
the left spine of the other's; the border is crossed if a merge of two facing
symbols comes before the merges that use up either of them.

Texts are cut at single blanks between other characters (no word reaches over
them), parts into words by the vocabulary's pattern; parts are remembered per
Python worker within a bound of bytes.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import uncollected

VOCABULARY = "byte_bpe_50k.json"
NODES = 250_000            # nodes of a trie before a new one is begun
PAIRS = 250_000            # pairs of tokens whose fit is remembered
DEEP = 64                  # bytes below which a word's prefixes get no node of their own
MEMO_BYTES = 128 << 20     # bytes of parts and ids remembered, in two generations
ENTRY = 200                # bytes that an entry of the memo takes besides
LONG = 256                 # tokens above which a part is not remembered
STRETCH = 4 << 20          # characters of text whose new words go through the trie together
ROWS = 1024                # texts handed back together

#: Characters up to here have the same class in every Unicode version since 4; parts beyond are cut by the library.
UNSETTLED = re.compile("[^\x00-\u0557]").search
#: A blank before a character that is no white space: no word of the pattern reaches over its left side.
BLANK = re.compile(r" (?=\S)").search
PARTS = re.compile(r" (?=\S)").split


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def byte_alphabet() -> dict[str, int]:
    """Byte of each character that stands for it in a byte-level vocabulary."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _read(path: str) -> dict:
    """A byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or spec["normalizer"]:
        raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is needed")
    return spec


def token_bytes(spec: dict) -> tuple[list[bytes], dict[str, int]]:
    """Bytes of every id, and the special tokens."""
    alphabet, special = byte_alphabet(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    entries = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
    entries |= {i: t.encode() for t, i in special.items()}
    return [entries.get(i, b"") for i in range(max(entries) + 1)], special


class Vocabulary:
    """Tokens, merge ranks and merge trees of a byte-level BPE file."""

    def __init__(self, path: str):
        spec, alphabet = _read(path), byte_alphabet()
        model = spec["model"]
        self.bytes, self.special = token_bytes(spec)
        held = set(self.special.values())
        self.id = {t: i for i, t in enumerate(self.bytes) if t and i not in held}
        self.length = [len(t) for t in self.bytes]
        self.rank: dict[int, int] = {}                      # of a merge, by left << 32 | right
        self.made: dict[int, tuple[int, int, int]] = {}     # token -> (rank, left, right)
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b = bytes(alphabet[c] for c in a), bytes(alphabet[c] for c in b)
            left, right, whole = self.id[a], self.id[b], self.id[a + b]
            if whole in self.made or any(self.made[p][0] >= r for p in (left, right) if p in self.made):
                raise ValueError("merges must make each token once, from tokens made before")
            self.rank[left << 32 | right] = r
            self.made[whole] = r, left, right
        self._automaton()
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._fits: dict[int, bool] = {}

    def _automaton(self) -> None:
        """States are prefixes of tokens; each knows the tokens that end there, the longest first."""
        self.step: dict[int, int] = {}          # by state << 8 | byte
        whole, parent, depth = [-1], [(0, 0)], [0]
        for t, i in self.id.items():
            state = 0
            for b in t:
                key = state << 8 | b
                state = self.step.setdefault(key, len(whole))
                if state == len(whole):
                    whole.append(-1)
                    parent.append((key >> 8, b))
                    depth.append(depth[key >> 8] + 1)
            whole[state] = i
        self.back = [0] * len(whole)             # the longest shorter suffix that is a state
        self.ends: list[tuple[int, ...]] = [()] * len(whole)
        for s in sorted(range(1, len(whole)), key=depth.__getitem__):
            up, b = parent[s]
            if up:
                self.back[s] = self.go(self.back[up], b)
            self.ends[s] = ((whole[s],) if whole[s] >= 0 else ()) + self.ends[self.back[s]]

    def go(self, state: int, byte: int) -> int:
        """State after one more byte: the longest suffix that begins a token."""
        step, back = self.step, self.back
        to = step.get(state << 8 | byte)
        while to is None and state:
            state = back[state]
            to = step.get(state << 8 | byte)
        return to or 0

    def _spine(self, token: int, side: int, known: dict[int, list]) -> list[tuple[int, float]]:
        """(symbol, rank of the merge that uses it up) along one side of a token's tree, lowest first."""
        if token not in known:
            out, t, gone = [], token, float("inf")
            while True:
                out.append((t, gone))
                if t not in self.made:
                    break
                gone, t = self.made[t][0], self.made[t][side]
            known[token] = out[::-1]
        return known[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens ``a`` and ``b`` together are encoded as just these two."""
        key = a << 32 | b
        ok = self._fits.get(key)
        if ok is None:
            if len(self._fits) > PAIRS:
                self._fits.clear()
            ok = self._fits[key] = self._uncrossed(self._spine(a, 2, self._right), self._spine(b, 1, self._left))
        return ok

    def _uncrossed(self, left: list, right: list) -> bool:
        i = j = 0
        while True:
            (x, x_gone), (y, y_gone) = left[i], right[j]
            r = self.rank.get(x << 32 | y)
            if r is not None and r < x_gone and r <= y_gone:  # of equal merges the leftmost comes first
                return False
            if x_gone == y_gone == float("inf"):
                return True
            if x_gone <= y_gone:
                i += 1
            else:
                j += 1


class Trie:
    """Last tokens of all prefixes of the words put in so far."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.child = vocab, {}
        self.last, self.state = [-1], [0]  # of every node: last token, state of the automaton
        self.word, self.nodes = b"", [0]   # where the walk stands: its nodes by depth

    def _shared(self, word: bytes) -> int:
        """Depth of the deepest node of the walk that ``word`` goes through."""
        lo, hi, here = 0, min(len(word), len(self.word), DEEP), self.word
        if not word.startswith(here[:hi]):
            while lo < hi:  # halving: the words' common start
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if word.startswith(here[:mid]) else (lo, mid - 1)
        return hi

    def ids(self, word: bytes) -> list[int]:
        """Encoding of ``word``; prefixes seen before are not computed again."""
        child, last, state, nodes, length, kept = self.child, self.last, self.state, self.nodes, self.vocab.length, 0
        depth = self._shared(word)
        del nodes[depth + 1:]
        node = nodes[depth]
        for b in word[depth:]:
            key = node << 8 | b
            to = child.get(key)
            if to is None:
                to = len(last)
                state.append(self.vocab.go(state[node], b))
                last.append(self._last(depth, state[to]))
                if depth < DEEP:
                    child[key] = to
                else:
                    kept = kept or to
            nodes.append(to)
            node = to
            depth += 1
        self.word = word
        out = []
        while depth:
            t = last[nodes[depth]]
            out.append(t)
            depth -= length[t]
        if kept:  # nodes too deep to stay
            del last[kept:], state[kept:]
        return out[::-1]

    def _last(self, end: int, state: int) -> int:
        """Last token of the walk's bytes and one more at place ``end``."""
        vocab, last, nodes = self.vocab, self.last, self.nodes
        for t in vocab.ends[state]:
            at = end + 1 - vocab.length[t]
            if not at or vocab.fits(last[nodes[at]], t):
                return t
        raise ValueError("a byte is missing from the vocabulary")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    ``special``: whether the strings of special tokens inside a text stand for those tokens.
    """

    def __init__(self, path: str, special: bool = True):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.vocab = Vocabulary(path)
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.library = Tokenizer.from_file(path).pre_tokenizer
        names = sorted(self.vocab.special, key=len, reverse=True) if special else []
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.trie = Trie(self.vocab)
        self.memo: dict[str | tuple, bytes] = {}  # parts of late: the text after a blank, or (text,) without one
        self.old: dict[str | tuple, bytes] = {}   # and of the generation before
        self.held = 0

    def cut(self, part: str) -> list[str]:
        """Words of a part; where Unicode versions may differ on a character the library cuts."""
        if UNSETTLED(part):
            return [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]
        if part[1:].isalpha() and (part[0] == " " or part[0].isalpha()):
            return [part]
        return self.words(part)

    def learn(self, parts: Iterable[str | tuple]) -> dict[str | tuple, bytes]:
        """Ids of parts; their distinct words go through the trie in sorted order."""
        cut = [(p, [w.encode() for w in self.cut(" " + p if isinstance(p, str) else p[0])]) for p in parts]
        ids: dict[bytes, bytes] = {}
        for w in sorted({w for _, ws in cut for w in ws}):
            if len(self.trie.last) > NODES:
                self.trie = Trie(self.vocab)
            t = self.trie.ids(w)
            ids[w] = struct.pack(f"<{len(t)}I", *t)
        return {p: b"".join([ids[w] for w in ws]) for p, ws in cut}

    def known(self, parts: Iterable[str | tuple]) -> dict[str | tuple, bytes]:
        """A lookup for these parts: the memo with what was new, or a table of their own where parts are long."""
        if self.held > MEMO_BYTES // 2:
            self.old, self.memo, self.held = self.memo, {}, 0
        memo, old = self.memo, self.old
        new = {p for p in parts if p not in memo}
        back = {p: old[p] for p in new if p in old}
        back |= self.learn(new - back.keys())
        short = {p: i for p, i in back.items() if len(i) <= 4 * LONG}
        self.held += sum(len(p) + len(i) + ENTRY for p, i in short.items())
        memo |= short
        return memo if len(short) == len(back) else memo | back

    def _runs(self, text: str) -> Iterator[list[str | tuple] | bytes]:
        """Lists of parts, and the ids of special tokens between them, in the text's order."""
        for n, run in enumerate(self.special.split(text) if self.special else [text]):
            if n % 2:
                yield self.vocab.special[run].to_bytes(4, "little")
                continue
            at = 0
            while at < len(run):  # a very long text is taken in stretches
                blank = BLANK(run, at + STRETCH)
                parts = PARTS(run[at:blank.start() if blank else len(run)])
                if at == 0:
                    parts[0] = (parts[0],)
                yield parts
                at = blank.end() if blank else len(run)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text; new words of all of them share the trie."""
        out, runs, size = [[] for _ in texts], [], 0
        for k, t in enumerate(texts):
            for r in self._runs(t):
                runs.append((k, r))
                size += sum(map(len, r)) if isinstance(r, list) else 0
                if size > STRETCH:
                    self._flush(runs, out)
                    runs, size = [], 0
        self._flush(runs, out)
        return [b"".join(o) for o in out]

    def _flush(self, runs: list, out: list[list[bytes]]) -> None:
        known = self.known({p for _, r in runs if isinstance(r, list) for p in r})
        for k, r in runs:
            out[k].append(b"".join([known[p] for p in r]) if isinstance(r, list) else r)


class Decoder:
    """Text of ids; nothing but the bytes of every token."""

    def __init__(self, path: str):
        self.table = token_bytes(_read(path))[0]

    def decode(self, ids: bytes) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_ENCODERS: dict[tuple, Encoder] = {}
_DECODERS: dict[str, Decoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    """The worker's encoder of a vocabulary file (its trie and memo outlive a task)."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(path, special)
    return _ENCODERS[path, special]


def decoder(path: str) -> Decoder:
    """The worker's decoder of a vocabulary file."""
    if path not in _DECODERS:
        _DECODERS[path] = Decoder(path)
    return _DECODERS[path]


def encode(docs: DataFrame, text: str = "text", path: str | None = None, out: str = "ids", special: bool = True, back: str | None = None) -> DataFrame:
    """``docs`` without ``text`` but with the ids of the whole text (binary, little-endian unsigned 32-bit) as ``out``.

    ``back`` names a further column for the text that the ids decode to.
    Null and empty texts have no ids (an empty value, not null). Texts of any
    length are encoded whole; repeated rows stay repeated; all other columns
    are kept, so one named ``out`` or ``back`` is an error. An empty table
    stays empty.
    """
    path = path or tokenizer_path()
    rest, new = [c for c in docs.columns if c != text], [out] if back is None else [out, back]
    if {n.lower() for n in new} & {c.lower() for c in rest}:
        raise ValueError(f"one of the columns {', '.join(new)} is there already")
    made = [T.StructField(n, t) for n, t in zip(new, (T.BinaryType(), T.StringType()), strict=False)]
    schema = T.StructType([*(docs.schema[c] for c in rest), *made])

    def run(batches):
        enc, decode = encoder(path, special), decoder(path).decode
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                sub = b.slice(s, ROWS)
                with uncollected():
                    ids = enc.encode([t or "" for t in sub.column(len(rest)).to_pylist()])
                cols = [pa.array(ids, pa.binary()), *([] if back is None else [pa.array([decode(i) for i in ids], pa.string())])]
                yield pa.RecordBatch.from_arrays([*(sub.column(k) for k in range(len(rest))), *cols], names=schema.names)

    return docs.select(*rest, text).mapInArrow(run, schema)


def decode_column(ids: Column, path: str | None = None) -> Column:
    """Text of a column of ids as ``encode`` gives them; null stays null."""
    path = path or tokenizer_path()

    @F.arrow_udf("string")
    def decode(values: pa.Array) -> pa.Array:
        text = decoder(path).decode
        return pa.array([None if v is None else text(v) for v in values.to_pylist()], pa.string())

    return decode(ids)
