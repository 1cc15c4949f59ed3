"""Text column expressions: tokenising, stop words, n-grams, cleaning.

All are built-in higher-order functions over arrays (JVM-side). A stop-word
test is ``isin`` over a literal list, which the optimizer turns into a hash
set lookup.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words (the 179-word list of the NLTK corpus, in
# its own order). Callers may pass any other list.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
)

# Token patterns. TF-IDF tokens are runs of at least two word
# characters (letters, digits, underscore, any script); URLs are http... or
# www... up to the next space; punctuation is the 32 ASCII marks.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
WORD_PATTERN = r"[\p{L}]+"
URL_PATTERN = r"http\S+|www\S+"
PUNCT_PATTERN = r"[!-/:-@\[-`{-~]"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def term_tokens(text) -> Column:
    """Lower-cased runs of >= 2 word characters (TF-IDF tokens)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(TERM_PATTERN), 0)


def drop_stop_words(tokens: Column, stop_words=STOP_WORDS) -> Column:
    sw = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(sw))


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs joined by a space; empty for fewer than two tokens."""
    return F.when(F.size(tokens) >= 2, F.transform(
        F.sequence(F.lit(0), F.size(tokens) - 2),
        lambda i: F.concat(F.element_at(tokens, i + 1), F.lit(" "), F.element_at(tokens, i + 2)),
    )).otherwise(F.array().cast("array<string>"))


def ngrams_1_2(tokens: Column) -> Column:
    return F.concat(tokens, bigrams(tokens))


def clean_tokens(text, stop_words=STOP_WORDS, min_len: int = 3) -> Column:
    """X-T1..X-T3: lower, drop URLs, drop ASCII punctuation, split on
    whitespace, drop stop words and tokens shorter than ``min_len``.

    Non-string or blank text gives an empty list.
    """
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    t = F.regexp_replace(t, URL_PATTERN, "")
    t = F.regexp_replace(t, PUNCT_PATTERN, "")
    toks = F.split(F.trim(t), r"\s+")
    sw = list(stop_words)
    return F.filter(toks, lambda w: (F.length(w) >= min_len) & ~w.isin(sw))


def clean_text(text, stop_words=STOP_WORDS) -> Column:
    """Cleaned tokens joined by single spaces (stemming is a separate step)."""
    return F.array_join(clean_tokens(text, stop_words), " ")


def words(text) -> Column:
    """Lower-cased letter runs, the unit of the lexicon scorer."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(WORD_PATTERN), 0)
