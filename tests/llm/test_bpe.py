"""Trie encoder against the tokenizers library and against plain merging; edge rows."""

import random
from hashlib import sha256

import numpy as np
import pytest

import __spark_entry__ as E
from castwise.llm import bpe

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a", " a", "a  b", "a \n b\n\n c ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "don't  I'll we'VE 'S 't",
       "x" * 5000, "=" * 1000 + " " * 500, "日本語 テキスト ꟎ 𐻁 a", "ab\x1c c \x1c d\x85 e​ f", "🎉🎉 naïve ÃÂÃÂÃÂ", "١٢٣ ½²³ 9", "՘x ՙ", "\x00\x01 \x7f"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.tokenizer_path())


def of_library(tok, text):
    return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def noise(n):
    rnd = random.Random(1)
    narrow = "abcdefghijklmnopqrstuvwxyz    \n\t'.,!ABCDEé日<|endoftext|>0123456789"
    wide = [chr(rnd.choice([rnd.randrange(0x20, 0x3000), rnd.randrange(0x3000, 0xD7FF), rnd.randrange(0x10000, 0x1FFFF), 32, 32, 97])) for _ in range(2000)]
    return ["".join(rnd.choice(k) for _ in range(rnd.randint(1, 200))) for k in (narrow, wide) for _ in range(n)]


def test_encoder_equals_library(own, library):
    texts = ODD + noise(400)
    got = own.encode(texts)
    assert [i for i, t in enumerate(texts) if got[i] != of_library(library, t)] == []
    back = bpe.Decoder(bpe.tokenizer_path()).decode
    assert all(back(g) == t for g, t in zip(got, texts, strict=True))


def test_decoding_of_any_ids_equals_library(library):
    rnd, own = random.Random(2), bpe.Decoder(bpe.tokenizer_path())
    for _ in range(300):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 12))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_special_strings_as_plain_text(library):
    enc = bpe.Encoder(bpe.tokenizer_path(), special=False)
    library.encode_special_tokens = True
    try:
        for t in ("a<|endoftext|> b", "<|endoftext|>"):
            assert enc.encode([t]) == [of_library(library, t)]
    finally:
        library.encode_special_tokens = False


def merged(vocab, word):
    """Plain byte-pair encoding: the best-ranked pair, leftmost first, until none is left."""
    ids = [vocab.id[bytes([b])] for b in word]
    while True:
        ranks = [vocab.rank.get(a << 32 | b, 1 << 40) for a, b in zip(ids, ids[1:], strict=False)]
        if not ranks or min(ranks) == 1 << 40:
            return ids
        at = ranks.index(min(ranks))
        ids[at:at + 2] = [vocab.id[vocab.bytes[ids[at]] + vocab.bytes[ids[at + 1]]]]


def test_trie_equals_plain_merging_and_shares_prefixes(own):
    rnd = random.Random(3)
    words = sorted({bytes(rnd.choice(b"abcetinrs \xc3\xa9=") for _ in range(rnd.randint(1, 90))) for _ in range(300)} | {b"a" * n for n in range(1, 130)})
    trie, calls = bpe.Trie(own.vocab), []
    plain = trie._last
    trie._last = lambda *a: calls.append(a) or plain(*a)
    assert [trie.ids(w) for w in words] == [merged(own.vocab, w) for w in words]
    distinct = {w[:n] for w in words for n in range(1, min(len(w), bpe.DEEP) + 1)}
    assert sum(a[0] < bpe.DEEP for a in calls) == len(distinct)  # every prefix that has a node once
    calls.clear()
    shuffled = random.Random(4).sample(words, len(words))
    assert [trie.ids(w) for w in shuffled] == [merged(own.vocab, w) for w in shuffled]
    assert all(a[0] >= bpe.DEEP for a in calls)  # only below the deepest nodes


def test_small_bounds_change_nothing(monkeypatch, library):
    for name, value in (("NODES", 50), ("MEMO_BYTES", 2000), ("LONG", 1), ("STRETCH", 40), ("DEEP", 3)):
        monkeypatch.setattr(bpe, name, value)
    enc, texts = bpe.Encoder(bpe.tokenizer_path()), ODD + noise(60)
    assert [enc.encode([t])[0] for t in texts] == enc.encode(texts) == [of_library(library, t) for t in texts]


def test_query_equals_library(spark, duck_llm, library):
    want = {}
    for d, t in duck_llm.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[d] = (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in E.queries()["op13_bpe"](spark, SF).collect()}
    assert got == want


def test_edge_rows(spark, library):
    rows = [(1, None), (1, ""), (None, "a b"), (2, "a b"), (2, "a b"), (3, "word " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "7 as fp", "'x' as lang")
    out = bpe.encode(docs, out="tokens").collect()
    assert sorted(((r.doc_id or 0, bytes(r.tokens)) for r in out)) == sorted((d or 0, of_library(library, t or "")) for d, t in rows)
    assert all(r.fp == 7 and r.lang == "x" for r in out)
    with pytest.raises(ValueError):
        bpe.encode(docs, out="FP")
    assert bpe.encode(docs.limit(0)).collect() == []
    back = bpe.encode(docs).select("doc_id", bpe.decode_column(bpe.F.col("ids")).alias("text"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)
