"""Registered queries against their SQL, and against brute force where there is none (sf0.001)."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from castwise.llm import decontaminate, packing, queries, toxicity
from castwise.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck_llm, name):
    df = queries.QUERIES[name](spark, SF)
    cur = duck_llm.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(map(norm, r)) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(map(norm, r)) for r in df.select(cols).collect()), key=repr) == want


def documents(duck):
    return duck.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


def brute_components(fps: dict, max_bits: int = 4) -> dict:
    ids, root = list(fps), {i: i for i in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= max_bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark, duck_llm):
    want = {d: fingerprint(t) for d, t, _ in documents(duck_llm)}
    comp = brute_components(want)
    got = {r.doc_id: r for r in E.queries()["op3_simhash_golay"](spark, SF).collect()}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == want
    assert {d: r.component_id for d, r in got.items()} == comp


def test_language_accuracy_on_held_out(spark, duck_llm):
    lang = {d: x for d, _, x in documents(duck_llm)}
    rows = E.queries()["op2_language_id"](spark, SF).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) >= 0.95


def test_packing_round_trip(spark, duck_llm):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    by, at = defaultdict(list), defaultdict(list)
    for r in E.queries()["op9_packing"](spark, SF).collect():
        by[r.doc_id].append(r)
        at[r.sequence_id].append((r.offset, r.length))
    total = 0
    for d, t, _ in documents(duck_llm):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        rows = sorted(by.pop(d), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in rows] == [(k, s, min(2048, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 2048))]
        assert all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)
    assert not by
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(at) <= -(-total // 2048) * 1.05 + 1


def test_sharding_law(spark, duck_llm):
    text = {d: (t or "").encode() for d, t, _ in documents(duck_llm)}
    rows = E.queries()["op10_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    assert all(r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.grown_shard is None for r in rows)
    slots, size = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) and 0 <= k < 40 for k, s in slots.items())
    mean, largest = sum(size.values()) / 40, max(r.size for r in rows)
    assert all(abs(size[k] - mean) <= largest + 0.0004 * mean for k in range(40))


def test_quality_and_toxicity_on_held_out(spark, duck_llm):
    labels = {d: (q, t) for d, q, t in duck_llm.execute("SELECT doc_id, quality, toxic FROM labels").fetchall()}
    for name, k in (("op8_quality", 0), ("op4_toxicity", 1)):
        rows = E.queries()[name](spark, SF).collect()
        assert all(0 <= r.score <= 1 for r in rows)
        out = [r for r in rows if r.held_out and r.doc_id in labels]
        assert sum(r.predicted == labels[r.doc_id][k] for r in out) / len(out) >= 0.85


def test_toxicity_recall(spark, duck_llm):
    """Few labels weaken the toxicity model but do not turn it off."""
    toxic = dict(duck_llm.execute("SELECT doc_id, toxic FROM labels WHERE toxic IN (0, 1)").fetchall())
    rows = [r for r in E.queries()["op4_toxicity"](spark, SF).collect() if r.doc_id in toxic]
    for part in (rows, [r for r in rows if r.held_out]):
        found = [r for r in part if r.predicted]
        assert all(toxic[r.doc_id] for r in found)
        assert len(found) / sum(toxic[r.doc_id] for r in part) >= 0.5


def test_pipeline_against_plain_python(spark, duck_llm):
    """Each stage's decisions on its own input, recomputed plainly."""
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        rows = out.collect()
        if name == "near_duplicates":
            comp = brute_components({d: fingerprint(t) for d, t in sorted(before.items())})
            assert {r.doc_id for r in rows} == set(comp.values())
        if name == "decontamination":
            grams = {tuple(w) for (t,) in duck_llm.execute("SELECT text FROM benchmark").fetchall() for w in decontaminate.windows(decontaminate.words(t))}
            sizes = {len(g) for g in grams}

            def clean(t):
                ws = decontaminate.words(t)
                return not any(tuple(ws[i:i + n]) in grams for n in sizes for i in range(len(ws) - n + 1))

            assert {r.doc_id for r in rows} == {d for d, t in before.items() if clean(t)}
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
            gone = set(before) - {r.doc_id for r in rows}
            labelled = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert not (gone & labelled) - toxic  # no clean document goes
        if name == "language_id":
            assert all(any(map(str.isalpha, r.text)) for r in rows)
        if name == "packing":
            assert {r.doc_id for r in rows} == set(before)
        else:
            assert out.columns == columns and {r.doc_id: r.text for r in rows}.items() <= before.items()
            kept[name] = len(rows)
            docs = out
    assert 0 < kept["decontamination"] <= kept["near_duplicates"] <= kept["language_id"] <= kept["toxicity"] < 200


def test_toxicity_reads_obfuscated_words():
    words = "the idiot is here and that idiot was there " * 50 + "morning glory stood in the assembly " * 20
    log_p = toxicity.language_model(toxicity.trigrams([words]))
    d = toxicity.Decoder(log_p)
    assert d.restore("1d10t") == "idiot"
    assert d.restore("i.d.i.o.t,") == "idiot"
    assert d.restore("idiiiiot") == "idiot"
    assert d.restore("i d i o t") == "idiot"
    assert d.restore("stood") == "stood" and d.restore("glory!") == "glory" and d.restore("---") == ""
    assert "i d i o t" in toxicity.tokens("an i d i o t here") and toxicity.tokens("") == set()
