"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from castwise.llm import chat, components, decontaminate, langid, licenses, packing, quality, sharding, simhash, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, match string, interval string, shard string, kept_id string, toxicity string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away", "en", "a", 1), (1, "the quick brown fox jumps over the lazy dog and runs far away", "en", "a", 1),
    (2, "", "en", None, 0), (3, None, None, "a", None), (None, "the quick brown fox jumps over the lazy dog and runs far away", "en", "a", 3),
    (None, None, None, None, None), (4, LONG, "en", "b", 9), (5, "?!", "fr", "b", 2), (6, "le chat est sur la table et il dort toute la journée", "fr", "b", 2),
    (7, "le chat est sur la table et il dort toute la journée", "fr", "c", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *("x",) * 6) for r in ROWS], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (4, 1, 0), (4, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "fox jumps over"), (2, "The QUICK brown fox jumps over the lazy dog and runs far"), (2, None), (None, "chat est sur"), (3, ""), (4, "table, et il")],
                                 "item_id long, text string")


def test_simhash(docs, none):
    rows = simhash.simhash_groups(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[2].fp == by[3].fp == 0 and by[2].component_id == by[3].component_id == 2
    assert by[7].component_id == 6 and by[1].component_id == 1 and {r.component_id for r in rows if r.doc_id is None} == {1, 2}
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5, 6]
    assert simhash.simhash_groups(none).count() == 0 and simhash.keep_one_per_group(none).count() == 0


def test_golay_keys_cover_four_bits():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    sides = []
    for x in (a, b):
        row, key, side = simhash.composite_keys(x)
        sides.append(({(r, k) for r, k, s in zip(row.tolist(), key.tolist(), side.tolist(), strict=True) if s != 1},
                      {(r, k) for r, k, s in zip(row.tolist(), key.tolist(), side.tolist(), strict=True) if s != 0}))
    for left, right in ((sides[0][0], sides[1][1]), (sides[1][0], sides[0][1])):
        assert {r for r, _ in left & right} == set(range(len(a)))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_components(spark, pairs):
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in root:
        for x, y in pairs:
            if x != y:
                root[x] = root[y] = min(root[x], root[y])
    assert got == root


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 400)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 400))


def test_near_copies_of_one_text_are_one_component(spark):
    base = 0x0123456789ABCDEF
    fps = {base, *(base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i))}
    signed = [(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps]
    far = (base ^ 0x7FFFFFFF00000000,)
    roots = {r.fp: r.root for r in simhash.fingerprint_components(spark.createDataFrame([*signed, far], "fp long")).collect()}
    assert roots.pop(far[0]) == far[0]
    assert len(roots) == len(fps) and set(roots.values()) == {min(roots)}


def test_simhash_contracts_until_few_pairs(spark, monkeypatch):
    """Families of variants that share buckets: forced further contraction and hot cells give the brute-force components."""
    rng = np.random.default_rng(3)
    fps = set()
    for base in rng.integers(0, 1 << 63, 6):
        for _ in range(60):
            f = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, 8)):
                f ^= 1 << int(bit)
            fps.add(f)
    signed = sorted(f - (1 << 64) if f >= 1 << 63 else f for f in fps)
    root = {f: f for f in signed}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    want = {f: top(f) for f in signed}
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    for pairs, cell in ((0, 8), (simhash.PAIRS, simhash.CELL)):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        monkeypatch.setattr(simhash, "CELL", cell)
        assert {r.fp: r.root for r in simhash.fingerprint_components(table).collect()} == want


def test_language(docs, none):
    rows = langid.identify(docs).collect()
    assert len(rows) == len(ROWS)
    assert all((r.lang_pred == "und") == (r.doc_id in (2, 3, 5) or (r.doc_id is None and r.score == 0)) for r in rows)
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_stage_keeps_letters_without_languages(spark, docs):
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.keep_known_languages(spark, unknown, "").collect()
    want = [r for r in docs.collect() if r.text and any(map(str.isalpha, r.text))]
    assert want and sorted(map(str, (r.text for r in got))) == sorted(r.text for r in want)


def test_language_stage_rejects_by_the_network(spark):
    rows = [(i, ("abba baba caab " if i % 2 else "xyzzy zyxy yxxz ") * 20, "a" if i % 2 else "x") for i in range(80)]
    mixed = ("abba baba caab " * 10 + "xyzzy zyxy yxxz " * 10)
    got = corpus_pipeline.keep_known_languages(spark, spark.createDataFrame([*rows, (99, mixed, None)], "doc_id long, text string, lang string"), "")
    assert {r.doc_id for r in got.collect()} == set(range(80))


def test_language_stage_rejects_other_languages_and_noise(spark):
    """Noise, other scripts, other languages and code go; the held-out rows and very short texts stay."""
    rng = np.random.default_rng(2)
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    strange = [
        "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. " * 4,
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。" * 4,
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. " * 4,
        "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 600)),
        "def forward(self, x):\n    for i in range(len(x)):\n        self.buf[i] = x[i] * 2\n    return self.buf\n" * 4,
    ]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(strange)] + [(-100, "Von.", None), (-101, "123 456", None)], sf.schema)
    got = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, sf.union(more), "").select("doc_id").collect()}
    assert {d for d in got if d < 0} == {-100}
    assert {r.doc_id for r in sf.where(langid.held_out()).collect()} <= got
    assert sf.count() - len(got) <= 1


def test_language_sample_of_repeated_ids(spark):
    """An id with a third of the rows neither fills nor swells the learning sample."""
    rows = [(i, "abba baba caab " * 20 if i % 2 else "xyzzy zyxy yxxz " * 20, "a" if i % 2 else "x") for i in range(60)] + [(1, f"abba {i}", "a") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, x, y = langid.training_segments(docs, "doc_id", "text", "lang")
    learnable = {r.doc_id for r in docs.where(langid.learnable()).collect()}
    assert languages == ["a", "x"] and len(x) <= 3 * 2 * len(learnable) and (np.bincount(y) == np.bincount(y).max()).all()


def test_language_gradients():
    """Backpropagation through time against numeric differences of the loss."""
    rng = np.random.default_rng(0)
    h, k, steps, batch = 3, 2, 7, 4
    x, target = rng.integers(97, 101, (steps, batch)), rng.integers(0, k, batch)
    e, u = rng.normal(0, 0.3, (2, 3 * h, 256)), rng.normal(0, 0.3, (2, 3 * h, h))
    e[:, :2 * h] += 0.5
    w = rng.normal(0, 1, (2, k, h))
    e, u, w = (a.astype(np.float32) for a in (e, u, w))

    def plain(e, u, x):
        """States by the unit's equations, one position after another, in double precision."""
        e, u, out, state = e.astype(float), u.astype(float), [], np.zeros((h, batch))
        for t in range(steps):
            a, g = e[:, x[t]], u @ state
            z, r = np.clip(a[:h] + g[:h], 0, 1), np.clip(a[h:2 * h] + g[h:2 * h], 0, 1)
            n = np.tanh(a[2 * h:] + r * g[2 * h:])
            state = n + z * (state - n)
            out.append(state)
        return np.array(out)

    def loss(e, u):
        q = w[0] @ plain(e[0], u[0], x) + w[1] @ plain(e[1], u[1], x[::-1])[::-1]
        q -= np.log(np.exp(q).sum(axis=1, keepdims=True))
        return -q[:, target, np.arange(batch)].sum()

    forward, backward = langid._direction(e[0], u[0], x), langid._direction(e[1], u[1], x[::-1])
    assert np.allclose(forward, plain(e[0], u[0], x), atol=1e-5) and np.allclose(backward, plain(e[1], u[1], x[::-1]), atol=1e-5)
    q = w[0] @ forward + w[1] @ backward[::-1]
    q = np.exp(q) / np.exp(q).sum(axis=1, keepdims=True)
    q[:, target, np.arange(batch)] -= 1
    ge, gu = np.zeros_like(e), np.zeros_like(u)
    langid._backward(e[0], u[0], x, forward, w[0].T @ q, ge[0], gu[0])
    langid._backward(e[1], u[1], x[::-1], backward, (w[1].T @ q)[::-1], ge[1], gu[1])
    for grad, which in ((ge, 0), (gu, 1)):
        for d in range(2):
            for i in range(3 * h):
                j = int(x[i % steps, 0]) if which == 0 else i % h
                probe = [e.astype(float), u.astype(float)]
                probe[which][d, i, j] += 1e-5
                up = loss(*probe)
                probe[which][d, i, j] -= 2e-5
                assert abs((up - loss(*probe)) / 2e-5 - grad[d, i, j]) < 2e-3


def test_toxicity(docs, none, labels):
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(docs, labels.limit(0)).collect())


def test_quality(docs, none, labels):
    rows = quality.classify(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(none, labels, F.col("source"), F.col("lang")).count() == 0
    assert {r.evidence for r in quality.classify(docs, labels.limit(0), F.col("source"), F.col("lang")).collect()} == {0.5}


def test_quality_shrinks_sparse_sites(spark):
    good, bad = "A plain sentence with some words. Another one follows here.", "XX %%% $$$ ### XX %%% $$$ ###"
    rows = [(i, good if i % 10 else bad, "big") for i in range(400)] + [(1000 + i, bad, "poor") for i in range(60)] + [(2000, bad, "lone")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lab = d.select("doc_id", (F.col("text") == good).cast("int").alias("quality"))
    r = {x.doc_id: x for x in quality.classify(d, lab, F.col("source"), F.lit("/")).collect()}
    assert r[1000].host_rate < r[2000].host_rate < r[1].host_rate


def test_decontamination(docs, none, bench):
    rows = decontaminate.decontaminate(docs, bench).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    # item 1 (3 words) and item 2 (11 words: two windows) overlap in document 1
    assert (by[1].n_words, by[1].n_hit, by[1].n_items, by[1].items) == (13, 12, 2, ["1", "2"])
    assert by[2].n_words == by[3].n_words == 0 and not by[2].contaminated
    assert by[6].n_hit == 6 and by[6].items == ["4"]  # the item without an id marks words only
    assert by[4].n_words == 60_000
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns


def test_decontamination_in_many_blocks(docs, bench, monkeypatch):
    want = sorted(map(repr, decontaminate.decontaminate(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_RECORDS", 2)
    assert sorted(map(repr, decontaminate.decontaminate(docs, bench).collect())) == want


def test_packing(docs, none, spark):
    placed, cut = packing.pack_documents(docs, capacity=64, with_ids=True)
    rows = placed.collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 1 and len([r for r in rows if r.doc_id == 1]) == 2
    assert sum(r.length for r in rows) == sum(len(r.ids) for r in cut.collect())
    whole = [r for r in packing.sequences(placed.where("doc_id = 4"), cut.where("doc_id = 4")).collect()]
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in rows if r.doc_id == 4)
    placed, _ = packing.pack_documents(none)
    assert placed.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_plan_holds_every_piece_once(sizes):
    counts = np.bincount(np.array(sizes, int), minlength=51) if sizes else np.zeros(51, int)
    got = np.zeros(51, int)
    bins = 0
    for p in packing.plan(counts, 50):
        assert p.bins > 0 and sum(a * b for a, b in p.pieces) <= 50
        bins += p.bins
        for size, n in p.pieces:
            got[size] += p.bins * n
    assert (got == counts).all() and bins <= max(1, -(-sum(sizes) * 13 // (50 * 9)) + 1)


def test_dominance_keeps_the_optimum():
    """With the dominating bins fixed, an exhaustive packing needs no more bins than without."""
    from functools import lru_cache

    @lru_cache(None)
    def fewest(sizes):
        if not sizes:
            return 0
        first, rest, best = sizes[-1], sizes[:-1], 99
        for mask in range(1 << len(rest)):
            some = [rest[i] for i in range(len(rest)) if mask >> i & 1]
            if first + sum(some) <= 20:
                best = min(best, 1 + fewest(tuple(rest[i] for i in range(len(rest)) if not mask >> i & 1)))
        return best

    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = tuple(sorted(rng.integers(2, 20, 7).tolist()))
        left = np.bincount(sizes, minlength=21)
        fixed = sum(p.bins for p in packing.reduce_by_dominance(left, 20))
        assert fixed + fewest(tuple(np.repeat(np.arange(21), left).tolist())) == fewest(sizes)


def test_encoder_equals_the_tokenizer():
    enc = packing.Encoder(packing.tokenizer_path())
    for t in ("don't 'tis we're ..'s ½ ² —! x", "İstanbul Σίσυφος ΟΔΟΣ ñ é é", "x_y!!-- 中文 ﬁ \x00\x1c a\tb\r\nc ÀÉ!ß ŉ ſ", "abc,def.ghi 12.5%", "a<|endoftext|>b <|ENDOFTEXT|>", ""):
        assert enc.encode(t).tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_sharding(docs, none):
    out = sharding.shard_documents(docs, shards=3, shard="to_shard")
    rows = out.collect()
    assert set(docs.columns) < set(out.columns) and len(rows) == len(ROWS)
    for k in range(3):
        slots = sorted(r.slot for r in rows if r.to_shard == k)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(none, shards=3, shard="to_shard").count() == 0


def test_sharding_splits_a_hot_text(spark):
    d = spark.createDataFrame([(i, "same text" if i % 3 else f"own text {i}") for i in range(3000)], "doc_id long, text string")
    size = {r.shard: r.b for r in sharding.shard_documents(d, shards=10).groupBy("shard").agg(F.sum(F.octet_length("text") + 16).alias("b")).collect()}
    assert len(size) == 10 and max(size.values()) - min(size.values()) <= 64


def test_licenses(docs, none, spark):
    known = licenses.known_licenses(spark)
    mit = licenses.KNOWN[4][1]
    d = spark.createDataFrame([(1, mit.replace("2000 the authors", "1999-2024 Somebody Else").replace("\n\n", "\n").replace('"', "'").lower()), (2, "x\nReleased under the MIT Licence!\ny"),
                               (2, "released UNDER the mit license"), (3, None), (4, ""), (None, "Licensed under CC BY-NC 4.0."), (5, mit + " and more")], "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.n_whole, r.n_lines) for r in licenses.scan(d, known).collect()}
    assert got[(1, "MIT")][0] == 1 and got[(2, "MIT")] == (1, 2) and got[(None, "CC-BY-NC-4.0")] == (1, 1) and (5, "MIT") not in got
    assert licenses.scan(docs, known).count() == 0 and licenses.scan(none, known).count() == 0


def test_sharding_splits_equal_rows(spark):
    """A third of the rows equal in all columns; every shard within a row of its share."""
    d = spark.createDataFrame([(7, "equal " * 20) for _ in range(300)] + [(i, f"text {i} " * 14) for i in range(600)], "doc_id long, text string").repartition(4)
    rows = sharding.shard_documents(d, shards=10).select("shard", "slot", (F.octet_length("text") + 16).alias("b")).collect()
    size, slots = [0] * 10, [[] for _ in range(10)]
    for r in rows:
        size[r.shard] += r.b
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(abs(x - sum(size) / 10) for x in size) <= max(r.b for r in rows)
    with pytest.raises(ValueError):
        sharding.shard_documents(d.withColumn("Slot", F.lit(1)))


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e6])
def test_topk_of_large_components(spark, scale):
    rnd = np.random.default_rng(3)
    m = np.round(rnd.normal(size=(120, 32)) * scale, 3)
    m[60:90] = m[0] + np.round(rnd.normal(size=(30, 32)), 3)  # near ties
    rows = [(i, m[i].tolist()) for i in range(120)] + [(200 + i % 2, m[0].tolist()) for i in range(4)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).repartition(3))
    whole = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows]
    want = []
    for q, a in {i: a for i, a in whole if i % 50 == 0}.items():
        s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q)[:5]
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    assert sorted(map(tuple, topk.top_k(v, v.where("vec_id % 50 = 0")).collect())) == sorted(want)


def test_topk_beyond_64_bits():
    big = np.full(4, 3 << 31, np.int64)
    with pytest.raises(OverflowError):
        topk.whole_scores(big, big[:, None], float(1 << 70))


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 40).astype("float32").tolist()) for i in range(300)]
    rows += [(300, rows[7][1]), (301, rows[7][1]), (302, None), (303, [1.0, None]), (304, [float("nan")] * 40), (305, [float("inf")] * 40), (306, []), (None, rows[1][1]), (400, [1.0, 2.0]), (450, [2.0, 1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4))
    got = {}
    for r in topk.top_k(v, v.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    whole = {i: np.floor(256 * np.array(x, float)) for i, x in rows if i is not None and i not in (302, 303, 304, 305, 306)}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ c), i) for i, c in whole.items() if i != q and len(c) == len(whole[q]))[:5]
        assert [got[q][k + 1] for k in range(len(best))] == [(i, -s) for s, i in best]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "hello"), (1, 2, "bob", "hello"), (1, 3, None, None), (2, 0, "system", "alone"), (None, 0, "ann", "x"),
             (3, None, "ann", ""), *((4, i, f"s{i % 3}", f"t{i}") for i in range(2000))]
    out = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("range", F.lit("x")))
    rows = out.collect()
    assert {(r.conv_id, r.perspective) for r in rows} == {(1, "ann"), (1, "bob"), (3, "ann"), (4, "s0"), (4, "s1"), (4, "s2")}
    full = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.perspective, r.position)):
        text = full.get((r.conv_id, r.perspective), "")
        assert r.start == len(text) and r.length == len(r.segment)
        full[(r.conv_id, r.perspective)] = text + r.segment
    for r in rows:
        if r.is_target:
            assert full[(r.conv_id, r.perspective)][r.target_start:r.target_end] == r.segment.removeprefix("<|im_start|>assistant\n")
        else:
            assert (r.target_start, r.target_end) == (0, 0)
    assert full[(1, "ann")] == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n"
                                "<|im_start|>user name=bob\nhello<|im_end|>\n<|im_start|>user\n<|im_end|>\n")
    parts = chat.assemble(out).collect()
    assert all(r.n_turns <= 128 and full[(r.conv_id, r.perspective)][r.first_char:r.first_char + len(r.text)] == r.text for r in parts)
    assert sum(r.n_turns for r in parts) == len(rows)


def test_pipeline_on_odd_and_empty_tables(spark, docs, none, labels, bench, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, none):
        d = table
        for name, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, str(tmp_path))
            assert d.columns == docs.columns or name == "packing"
        d.collect()


def test_licences_beyond_the_given_tables(spark):
    bsd = [t for n, t in licenses.KNOWN if n == "BSD-3-Clause"][0]
    mit = [t for n, t in licenses.KNOWN if n == "MIT" and "Permission" in t][0]
    rows = [(1, "Copyright (c) 2011 Someone\n" + bsd.replace("or without ", "or without\n")), (2, mit.replace("Copyright (c) 2000 the authors", "Copyright Joyent, Inc.")),
            (3, mit.replace("Copyright (c) 2000 the authors", "Copyright The Authors")), (4, "x\nSPDX-License-Identifier: MPL-2.0\ny")]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark)).collect()}
    assert got == {(1, "BSD-3-Clause"), (2, "MIT"), (3, "MIT"), (4, "MPL-2.0")}


def test_whole_licences_by_digest(spark):
    from pathlib import Path

    for file, name in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0-only"), ("MPL-2.0", "MPL-2.0")):
        path = Path("/usr/share/common-licenses", file)
        if not path.exists():
            pytest.skip("no licence texts on this machine")
        got = licenses.scan(spark.createDataFrame([(1, path.read_text())], "doc_id long, text string"), licenses.known_licenses(spark)).where("n_whole = 1").collect()
        assert [r.license for r in got] == [name]
