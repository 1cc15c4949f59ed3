"""TF-IDF over a text column, DataFrame-native (X-T2, X-T3, X-T5, X-T6).

Semantics: lower-case, tokens of >= 2 word characters, stop words removed
*before* forming 1- and 2-grams; a term is kept when it occurs in at least
``min_df`` documents; of those the ``max_features`` with the largest total
count are kept (ties by term); idf = ln((1 + N) / (1 + df)) + 1 with N the
number of documents; each document's kept weights are L2-normalised.

Plan: (1) the tokens of a text are made once and written, with the number of
documents that hold the text; (2) statistics of words; (3) statistics of
bigrams, but only of those that can be kept: a bigram occurs at most as often,
and in at most as many documents, as either of its words, so with
``max_features`` words at or above a total nothing below it is counted; (4) the
vocabulary by top-k; (5) vocabulary terms are picked and counted in each
text's own row. No text and no (document, term) pair of other terms is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Most terms that are tested as literals in the tokens' own rows; more are counted, or joined, in full.
LITERAL_TERMS = 5_000


def tokens(docs: DataFrame, text: str = "synopsis", stop_words=T.STOP_WORDS) -> DataFrame:
    """``docs`` with ``toks`` in place of its text."""
    return docs.withColumn("toks", T.drop_stop_words(T.term_tokens(text), stop_words)).drop(text)


def _runs(terms: str) -> Column:
    """(term, n) of every distinct element of a sorted array, counted in its own row."""
    n = F.greatest(F.size(terms), F.lit(1))
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(terms, i - 1) != F.get(terms, i)))  # where each term's run ends
    return F.transform(ends, lambda e: F.struct(F.get(terms, e - 1).alias("term"), e.alias("end")))


def _counted(rows: DataFrame, terms: Column, *keep: str) -> DataFrame:
    """(*keep, term, n): the elements of the array ``terms``; a row without any gives the null term."""
    s = rows.select(*keep, F.sort_array(terms).alias("s")).select(*keep, _runs("s").alias("r"))
    at = lambda x, k: F.struct(x["term"].alias("term"), (x["end"] - F.coalesce(F.get("r", k - 1)["end"], F.lit(0))).alias("n"))
    # outer, and no filter before it: one on an array would be pushed below the projections and repeat them
    return s.select(*keep, F.explode_outer(F.transform("r", at)).alias("x")).select(*keep, F.col("x.term").alias("term"), F.col("x.n").alias("n"))


def _stats(rows: DataFrame, terms: Column, times: str) -> DataFrame:
    return (_counted(rows, terms, times).groupBy("term").agg(F.sum(times).alias("df"), F.sum(F.col("n") * F.col(times)).alias("total"))
            .where(F.col("term").isNotNull()))


def vocabulary(rows: DataFrame, n_docs: DataFrame, max_features: int | None = 300, min_df: int = 2, times: str = "times") -> DataFrame:
    """``(term, df, total, idf)`` of the kept terms of ``(toks, times)`` rows (:func:`tokens`).

    ``times``: how many documents hold the row's tokens.
    """
    from ..session import materialize

    rows = rows.where(F.col(times) > 0)
    words = materialize(_stats(rows, F.col("toks"), times).where(F.col("df") >= min_df), "word-counts")
    frequent, among = words, None
    if max_features is not None:  # the total of the last word that can be kept: its ties stay
        frequent = words.where(F.col("total") >= F.coalesce(F.lit(_last_total(words, max_features)), F.lit(0)))
    some = frequent.select("term").limit(LITERAL_TERMS + 1).collect()
    if len(some) <= LITERAL_TERMS:
        among = [r.term for r in some]
    if among != []:
        # a column before the pairs are made: the pairs' lambda reads it once an element; a pair with a null word is null
        kept = rows if among is None else rows.select(times, F.transform("toks", lambda t: F.when(t.isin(among), t)).alias("toks"))
        pairs = _stats(kept, F.array_compact(T.bigrams(F.col("toks"))), times).where(F.col("df") >= min_df)
        words = words.unionByName(pairs)
    if max_features is not None:
        words = words.orderBy(F.col("total").desc(), "term").limit(max_features)
    n = F.col("n_docs").cast("double")
    return (words.crossJoin(F.broadcast(n_docs))  # one row
            .select("term", "df", "total", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf")))


def _last_total(words: DataFrame, n: int) -> int | None:
    """The ``n``-th largest total; None if there are fewer words."""
    last = words.select("total").orderBy(F.col("total").desc()).limit(n).agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("t")).first()
    return last.t if last.n == n else None


def weights(rows: DataFrame, vocab: DataFrame, key: str = "item_id") -> DataFrame:
    """Long ``(key, term, weight)``: tf x idf over ``vocab``, L2-normalised by ``key``, of ``(key, toks)`` rows."""
    some = vocab.select("term").limit(LITERAL_TERMS + 1).collect()
    terms = T.ngrams_1_2(F.col("toks"))
    if len(some) <= LITERAL_TERMS:
        known = [r.term for r in some]
        rows, terms = rows.withColumn("terms", terms), F.filter("terms", lambda t: t.isin(known))
        vocab = F.broadcast(vocab)
    # one exchange by key: the counts, and the norms after them, keep its layout
    n = _counted(rows, terms, key).where(F.col("term").isNotNull()).join(vocab.select("term", "idf"), "term").repartition(key)
    w = n.groupBy(key, "term").agg((F.sum("n") * F.first("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / norm).alias("weight"))


def tfidf_weights(docs: DataFrame, key: str = "item_id", text: str = "synopsis",
                  max_features: int | None = 300, min_df: int = 2,
                  stop_words=T.STOP_WORDS) -> DataFrame:
    """Long ``(key, term, weight)``: L2-normalised tf x idf of kept terms."""
    from ..session import materialize

    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    rows = materialize(tokens(docs.select(key, text, F.lit(1).alias("times")), text, stop_words), "tokens")
    return weights(rows, vocabulary(rows, n_docs, max_features, min_df), key)
