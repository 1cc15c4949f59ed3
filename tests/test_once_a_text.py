"""Text work is done once a document, not once a row that holds it; odd keys give the same rows as plain joins."""

import datetime

import pytest
from pyspark.sql import functions as F

from castwise.operators import sentiment as SE
from castwise.plans.catalog import Ctx, all_queries


def _write(spark, root, name, ddl, rows):
    spark.createDataFrame(rows, ddl).write.parquet(f"{root}/{name}.parquet")


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """A small catalog: documents that come twice, without text and without a key; parts and lines twice; texts of several reviews."""
    root = str(tmp_path_factory.mktemp("odd"))
    day = datetime.datetime(2020, 1, 1)
    texts = ["not good, not a bad film: great actors", "terrible story and awful music", "great actors and great story", None, "", "x"]
    docs = [(i, texts[i % 6], "en", "web", 10) for i in range(30)] + [(4, "worst great actors", "en", "web", 3), (2, texts[2], "en", "web", 3), (None, "great actors", "en", "web", 2)]
    parts = [(k, f"name {k % 7}", f"Brand#{k % 5}", f"type {k % 3}", k % 9 + 1, 100.0 + k) for k in range(110)] + [(8, "name 1", "Brand#3", "type 2", 9, 108.0)]
    lines = [(o, (o * 7 + n) % 110, n, n, float(o % 12), 1000.0 + o, 0.05, 0.02, day + datetime.timedelta(days=o)) for o in range(60) for n in range(4)]
    _write(spark, root, "documents", "doc_id long, text string, lang string, source string, n_chars long", docs)
    _write(spark, root, "part", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", parts)
    _write(spark, root, "lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
           "l_discount double, l_tax double, l_shipdate timestamp", [*lines, lines[9], lines[9]])
    _write(spark, root, "orders", "o_orderkey long, o_custkey long", [(o, o % 13) for o in range(60)] + [(7, 1)])
    _write(spark, root, "supplier", "s_suppkey long, s_name string", [(i, f"Supplier {i}") for i in range(5)])
    return root


def _rows(df):
    return sorted(map(repr, (tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())))


def test_reviews_meet_what_was_made_of_a_document_once(spark, odd_dir):
    c, seen = Ctx(spark, odd_dir), []

    def of(texts):
        seen.append(texts.count())
        return SE.lexicon_scores(texts, "review_text")

    got = c.by_text(c.reviews_clean_keyed, of)
    assert sorted(seen) == [1, 33]  # the documents and the filled text, not the 255 reviews
    want = SE.lexicon_scores(c.reviews_clean, "review_text")
    assert want.where(F.col("review_text") != "No review provided").count() > 33
    assert _rows(got.select(*want.columns)) == _rows(want)


@pytest.mark.parametrize("name", ["label_agreement_accuracy", "item_sentiment", "item_sentiment_record", "sentiment_files", "prediction_file"])
def test_scores_of_odd_tables_follow_the_sql(spark, odd_dir, name):
    import duckdb

    q = all_queries()[name]
    con = duckdb.connect()
    for t in ("documents", "part", "lineitem", "orders", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd_dir}/{t}.parquet/*.parquet')")
    got = q.build(spark, odd_dir)
    cur = con.sql(q.sql)
    at = [cur.columns.index(x) for x in got.columns]
    want = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in cur.fetchall()]
    assert want and _rows(got) == sorted(map(repr, want))


def _plain_tfidf(rows, n_docs, max_features, min_df):
    """(vocabulary, weights) of (key, text) rows, counted row by row."""
    import math
    import re
    from collections import Counter, defaultdict

    from castwise.functions.text import STOP_WORDS

    df, total, held = Counter(), Counter(), defaultdict(Counter)
    for key, text in rows:
        toks = [t for t in re.findall(r"\w{2,}", text.lower()) if t not in STOP_WORDS]
        n = Counter(toks + [f"{a} {b}" for a, b in zip(toks, toks[1:], strict=False)])
        df.update(n.keys())
        total.update(n)
        held[key].update(n)
    kept = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-total[t], t))[:max_features]
    idf = {t: math.log((n_docs + 1) / (df[t] + 1)) + 1 for t in kept}
    out = []
    for key, n in held.items():
        w = {t: n[t] * idf[t] for t in n if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out += [(key, t, x / norm) for t, x in w.items()]
    return [(t, df[t], total[t], idf[t]) for t in kept], out


def test_item_texts_are_weighed_once_a_document(spark, odd_dir):
    from castwise.plans.featuring import tfidf_stage

    c = Ctx(spark, odd_dir)
    vocab, got = tfidf_stage(c)
    rows = [tuple(r) for r in c.items_clean.select("item_id", "synopsis").collect()]
    terms, want = _plain_tfidf(rows, c.items_core.count(), 300, 2)
    rounded = lambda x: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in x)
    assert _rows(vocab) == rounded(terms) and _rows(got) == rounded(want)
    assert "Generate" in got._jdf.queryExecution().optimizedPlan().toString()  # one row a text and its items until they meet


@pytest.mark.parametrize(("max_features", "min_df"), [(1, 1), (3, 1), (4, 2), (6, 2), (40, 1), (None, 2), (None, 1)])
def test_bigrams_of_rare_words_change_no_vocabulary(spark, max_features, min_df, monkeypatch):
    from castwise.operators import tfidf as TF

    texts = ["red fox red fox red", "red fox jumps", "lazy dog lazy dog", "fox", "", "blue red blue", "dog fox dog lazy", "blue sky"]
    docs = spark.createDataFrame(list(enumerate(texts)), "item_id long, synopsis string")
    terms, want = _plain_tfidf(list(enumerate(texts)), len(texts), max_features, min_df)
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    for most in (TF.LITERAL_TERMS, 2):  # in the tokens' own rows, and in full
        monkeypatch.setattr(TF, "LITERAL_TERMS", most)
        rows = TF.tokens(docs.withColumn("times", F.lit(1)))
        got = [tuple(r) for r in TF.vocabulary(rows, n, max_features, min_df).select("term", "df", "total").collect()]
        assert sorted(got) == sorted(t[:3] for t in terms)
        assert _rows(TF.tfidf_weights(docs, max_features=max_features, min_df=min_df)) == sorted(repr((k, t, round(x, 6))) for k, t, x in want)


@pytest.mark.parametrize("name", ["merge_credits_reviews", "merged_file", "raw_table_rows", "clean_reviews"])
def test_tables_with_texts_follow_the_sql(spark, odd_dir, name):
    test_scores_of_odd_tables_follow_the_sql(spark, odd_dir, name)


def test_only_reviews_with_a_document_are_keyed(spark, odd_dir):
    c = Ctx(spark, odd_dir)
    keys = {r.text_id for r in c.reviews_keyed.select("text_id").collect()}
    assert keys == {*range(30), None}  # orders 30 to 59 have no document: their reviews never meet the texts


def test_raw_tables_are_written_packed(spark, tmp_path):
    from castwise.sources import files as FI

    df = spark.createDataFrame([(1, 'two\nlines, "quoted"')], "item_id long, item_name string")
    assert FI.write_csv(df, str(tmp_path / "x"), "gzip") == 1
    assert all(p.name.endswith(".csv.gz") for p in (tmp_path / "x").glob("part-*"))


def test_packed_vectors_have_length_one_in_both_ways(spark, monkeypatch):
    from castwise.operators import neighbors as NB

    feats = spark.createDataFrame([(i, f, float(i % 5 + 1 + k)) for i in range(40) for k, f in enumerate(["a", "b", f"r{i % 13}"])], "id long, feature string, value double")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(41)], "id long, name string")
    seen = []
    for most in (NB.SENT_FEATURES, 0):  # sent to the rows, and joined
        monkeypatch.setattr(NB, "SENT_FEATURES", most)
        rows = {r.id: r for r in NB.pack_features(feats, names).table.collect()}
        assert len(rows) == 41 and not any(rows[40].vec) and len(rows[3].rare) == 1
        assert all(abs(sum(x * x for x in rows[i].vec) - 1) < 1e-9 for i in range(40))
        seen.append(sorted(map(str, rows.values())))
    assert seen[0] == seen[1]
