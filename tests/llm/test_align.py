"""Alignment against the two libraries and plain loops; fragments against whole texts."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

import __spark_entry__ as E
from castwise.llm import align, bpe
from castwise.llm.bpe import byte_alphabet

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "x▁y", "▁", "<s>hi</s> <|endoftext|>", "a\n b\n\n c\t d ", "日本語 テキスト ꟎ 𐻁 a", "ab\x1c c \x1c d\x85 e​ f\x00",
       "🎉🎉 naïve ÃÂÃÂÃÂ", "don't  I'll", "<0x0A>", "a　b", "the the the"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(bpe.tokenizer_path(align.VOCABULARY_A))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=bpe.tokenizer_path(align.VOCABULARY_B))
    entry, alphabet = {i: t for t, i in a.get_vocab().items()}, byte_alphabet()

    def bytes_a(i):
        return bytes(alphabet[c] for c in entry[i])

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    return a, b, bytes_a, bytes_b


def spans(ids, of):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(of(i))))
        at = out[-1][2]
    return out


def plain(text, libraries):
    """(n_a, n_b, groups text, links) by definition."""
    a, b, bytes_a, bytes_b = libraries
    if not text:
        return 0, 0, "", Counter()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    whole = (" " + text).encode()
    if b"".join(map(bytes_a, x)) != whole or b"".join(map(bytes_b, y)) != whole:
        return 0, 0, "", Counter()
    x, y = spans(x, bytes_a), spans(y, bytes_b)
    cuts = sorted({e for _, _, e in x} & {e for _, _, e in y})
    groups, lo = [], 0
    for hi in cuts:
        groups.append("|".join(",".join(str(i) for i, s, e in z if s >= lo and e <= hi) for z in (x, y)))
        lo = hi
    links = Counter((i, j) for i, s, e in x for j, t, u in y if s < u and t < e)
    return len(x), len(y), ";".join(groups), links


def expected(texts, libraries):
    rows = [plain(t, libraries) for t in texts]
    held = Counter(p for r in rows for p in r[3])
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    return [(n_a, n_b, g.count(";") + 1 if g else 0, sum(links.values()), sum(k for p, k in links.items() if held[p] == top[p[0]]),
             sum(k * held[p] for p, k in links.items()), g, sha256(g.encode()).hexdigest() if g else "") for n_a, n_b, g, links in rows]


def got(df):
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"]
    return sorted((tuple(r) for r in df.select("doc_id", *cols).collect()), key=repr)


def noise(n, longest, seed=1):
    rnd = random.Random(seed)
    narrow = "abcdeinorst     \n'.,AB<é日▁0123" if seed % 2 else "abcdeinorst     \n'.,ABé日0123"
    return ["".join(rnd.choice(narrow) for _ in range(rnd.randint(1, longest))) for _ in range(n)]


def test_query_equals_plain_python(spark, duck_llm, libraries):
    rows = duck_llm.execute("SELECT doc_id, text FROM documents").fetchall()
    short = [(d, (t or "")[:1500]) for d, t in rows if t is None or len(t) < 4000]
    docs = spark.createDataFrame(short, "doc_id long, text string")
    want = sorted(((d, *w) for (d, _), w in zip(short, expected([t for _, t in short], libraries), strict=True)), key=repr)
    assert got(align.alignment(docs)) == want
    query = E.queries()["op12_alignment"](spark, SF)
    whole = {d: t for d, t in rows}
    digests = {d: (plain(t, libraries)[:2], sha256(g.encode()).hexdigest() if (g := plain(t, libraries)[2]) else "") for d, t in whole.items() if not t or len(t) < 4000}
    found = {r.doc_id: ((r.n_a, r.n_b), r.groups_sha256) for r in query.collect()}
    assert len(found) == len(rows) and {d: found[d] for d in digests} == digests


@pytest.mark.parametrize("size", [40, 100])
def test_long_documents_in_ranges(spark, libraries, monkeypatch, size):
    monkeypatch.setattr(align, "FAN", 3)
    texts = ODD + noise(20, 900) + noise(15, 900, 2) + ["x" * 700, "word " * 300, "naïve日 " * 200, "end less" + "y" * 500 + " tail of it all " * 9, " " * 300 + "a b c d"]
    rows = [(i // 2, t) for i, t in enumerate(texts)]  # ids repeat
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as row", "2 as groups", "3 as n_a").repartition(3)
    want = sorted(((d, *w) for (d, _), w in zip(rows, expected(texts, libraries), strict=True)), key=repr)
    aligned = align.align(docs, size=size)
    base = libraries[1].get_piece_size()
    pairs = align.pair_counts(aligned, base)
    assert got(align.weigh(aligned, pairs)) == want
    assert got(align.weigh(aligned, pairs, sent=0)) == want  # the joined way


def test_composition_is_associative():
    al = align.aligner((bpe.tokenizer_path(align.VOCABULARY_A), bpe.tokenizer_path(align.VOCABULARY_B)))
    rnd = random.Random(5)
    for text in [t for t in noise(60, 600, 2) if t.strip()]:
        whole = al.whole([text])[0]
        cut = align.ranges(text, 30)
        assert cut[0][0] == 0 and cut[-1][1] == len((" " + text).encode()) and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))
        parts = [al.fragment(w, o, s, e) for s, e, o, w in cut]
        while len(parts) > 1:  # any order of joining neighbours
            k = rnd.randrange(len(parts) - 1)
            parts[k:k + 2] = [al.compose(parts[k], parts[k + 1])]
        f = parts[0]
        assert f.cut and not (f.head_a or f.head_b or f.tail_a or f.tail_b)
        assert ";".join(f.groups) == ";".join(whole.groups) and (f.n_a, f.n_b, f.n_groups) == (whole.n_a, whole.n_b, whole.n_groups)
        assert sorted(np.frombuffer(b"".join(f.pairs), al.kind)) == sorted(np.frombuffer(b"".join(whole.pairs), al.kind))


def test_ranges_cut_tokens():
    """Borders do fall inside tokens: fragments with open ends are met."""
    al = align.aligner((bpe.tokenizer_path(align.VOCABULARY_A), bpe.tokenizer_path(align.VOCABULARY_B)))
    fragments = [al.fragment(w, o, s, e) for s, e, o, w in align.ranges("antidisestablishmentarianism naïveté 日本語 xqzzyk " * 60, 41)]
    assert len(fragments) > 10 and sum(bool(f.head_a or f.head_b) for f in fragments) > 5 and sum(bool(f.tail_a or f.tail_b) for f in fragments) > 5


def test_empty_table(spark):
    assert align.alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_small_memo_changes_nothing(monkeypatch, libraries):
    for name, value in (("MEMO_BYTES", 2000), ("LONG", 3), ("STRETCH", 30)):
        monkeypatch.setattr(align, name, value)
    al = align.Aligner(bpe.tokenizer_path(align.VOCABULARY_A), bpe.tokenizer_path(align.VOCABULARY_B))
    texts = [t for t in ODD + noise(60, 300) if t]
    for t, f in zip(texts, al.whole(texts), strict=True):
        n_a, n_b, groups, _ = plain(t, libraries)
        assert ((f.n_a, f.n_b, ";".join(f.groups)) if f.ok else (0, 0, "")) == (n_a, n_b, groups)
