"""Tests of the third round's findings on the training-data operators."""

from collections import Counter

from castwise.llm import simhash, toxicity


def test_labels_of_shared_keys_join_one_row_a_fingerprint(spark):
    """A group of near copies shares all its keys; the label's join must not make a row for each of them."""
    shared = spark.createDataFrame([(k, fp, k % 3) for fp in (1, 2, 3) for k in range(fp, 120)], "key long, fp long, side byte")
    star = spark.createDataFrame([(2, 1), (1, 1)], "node long, root long")
    got = simhash._labelled(shared, star)
    assert sorted(map(tuple, got.collect())) == sorted((k, fp, k % 3, 1 if fp < 3 else 3) for fp in (1, 2, 3) for k in range(fp, 120))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") < plan.index("Aggregate")  # keys spread after the join, gathered before it


def test_toxicity_learns_from_every_labelled_row(spark):
    """Blocks of four rows: words that only a few toxic rows hold weigh, whichever block holds them."""
    words = ["gorblax", "fimvutz", "quarnek", "zolpidge"]
    docs = [(i, f"a plain note about {words[i % 4]} again") if i % 2 else (i, f"a plain note number {i} about tea") for i in range(160)]
    labels = [(i, i % 2) for i, _ in docs]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, parts = toxicity.fit(d, y), toxicity.fit(d, y, block_rows=4)
    reader = toxicity.Reader(whole.log_p)
    for model in (whole, parts):
        heard = [model.weights[reader.buckets(w)].sum() for w in ("gorblax", "fimvutz", "quarnek", "zolpidge")]
        assert heard[1] > 0 and heard[3] > 0
    assert (parts.weights[whole.weights > 0] > 0).all()  # every block's words, not those of four rows


def test_toxicity_labels_go_to_the_texts(spark, monkeypatch):
    """However small the session's own bound, labels are sent to the texts; more than SENT_LABELS are joined to the same rows."""
    d = spark.createDataFrame([(i % 50, f"text {i} of gorblax") for i in range(100)] + [(None, "no id")], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(0, 50, 3)] * 2 + [(6, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    plans, rows, write = [], [], toxicity.materialize

    def kept(df, name):
        out = write(df, name)
        if name == "toxicity-labelled":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            rows.append(Counter(map(tuple, out.collect())))
        return out

    monkeypatch.setattr(toxicity, "materialize", kept)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        toxicity.fit(d, y)
        monkeypatch.setattr(toxicity, "SENT_LABELS", 0)
        toxicity.fit(d, y)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]
    assert rows[0] == rows[1] and sum(rows[0].values()) > 10


def test_benchmark_tokens_are_counted_in_slices_of_texts(spark, monkeypatch):
    """Document frequencies do not depend on how many texts are copied at once; nulls and repeats count as before."""
    from castwise.llm import decontaminate

    monkeypatch.setattr(decontaminate, "SLICE", 2)
    docs = spark.createDataFrame([("a b c",), (None,), ("A b",), ("",), ("b c b c",), ("a b c",), ("x",)], "text string").coalesce(1)
    got = decontaminate.document_frequencies(docs, "text", {(b"a", b"b"), (b"b", b"c"), (b"x",), (b"q",)}, spark)
    assert dict(got) == {(b"a", b"b"): 3, (b"b", b"c"): 3, (b"x",): 1}
