"""Tests of the fourth round's findings on the training-data operators."""

import corpus_pipeline
from castwise.llm import langid, simhash


def test_golay_keys_are_not_sent_to_the_driver(spark, monkeypatch):
    """Spark takes the keys for as small as the fingerprints; whatever its bound, they are not broadcast."""
    plans, write = {}, simhash.materialize

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(simhash, "materialize", kept)
    got = simhash.fingerprint_components(spark.createDataFrame([(f,) for f in (0, 1, 3, 1 << 40, -1)], "fp long"))
    assert {r.fp: r.root for r in got.collect()} == {0: 0, 1: 0, 3: 0, 1 << 40: 0, -1: -1}
    assert "SortMergeJoin" in plans["golay-shared"] and "Broadcast" not in plans["golay-shared"]


def test_language_stage_judges_short_texts(spark):
    """Texts of a few letters go like long ones when they are in no learned language; words of the languages stay."""
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    strange = ["Все счастливые семьи", "人人生而自由", "мир", "zqxjv wkpzt qqxzv", "Καλημέρα κόσμε", "for i in range(n): x[i] += 1"]
    known = ["The", "Guten Tag", "de la casa", "est", "1 a"]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(strange)] + [(-100 - i, t, None) for i, t in enumerate(known)], sf.schema)
    got = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, sf.union(more), "").select("doc_id").collect()}
    assert {d for d in got if d < 0} == {-100 - i for i in range(len(known))}


def test_language_bounds_rest_on_every_learnable_text(spark):
    """A text far beyond the bounded sample still counts."""
    rows = [(i, "abba baba caab " * 20 if i % 2 else "xyzzy zyxy yxxz " * 20, "a" if i % 2 else "x") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(docs, strange=True)
    judged = docs.withColumn("r", langid.predict(net, langid.F.col("text")))
    wide = langid.bounds(net, judged, "r", per_language=0)
    last = docs.where(langid.learnable()).agg(langid.F.max("doc_id")).first()[0]
    low = judged.withColumn("r", langid.F.expr(f"if(doc_id = {last}, named_struct('lang', r.lang, 'score', 0.4D, 'strange', r.strange, 'letters', r.letters), r)"))
    assert langid.bounds(net, low, "r", per_language=0)[7][0] < wide[7][0]  # texts of 240 letters
    assert len(wide) == langid.LONGEST + 1 and len(set(wide[:8])) == 1  # none is shorter


def test_pieces_have_so_many_letters():
    got = langid.pieces("Über 12 Käse, und die Straße! " * 200)
    sizes = [int(langid.LETTER[list(langid.as_bytes(p))].sum()) for p in got]
    assert len(got) == langid.PIECES * langid.LONGEST and all(1 << k % langid.LONGEST <= n <= (1 << k % langid.LONGEST) + 1 for k, n in enumerate(sizes))
    assert langid.pieces(None) == langid.pieces("12 !") == [] and set(langid.pieces("a")) == {"a"}
