"""Merkle manifest against plain Python; edge rows."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from castwise.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(level, fan):
    return [h(*level[i:i + fan]) for i in range(0, len(level), fan)]


def proof(level, i, fan):
    out = []
    while len(level) > 1:
        run = i // fan * fan
        out.append(("".join(level[run:i]), "".join(level[i + 1:run + fan])))
        level, i = up(level, fan), i // fan
    return level[0], out


def plain(rows, fan):
    """Sorted (doc_id, leaf, subroot, root, proof) of (doc_id, source, lang, n_chars, text) rows."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(*(field(v) for v in r)), r[0]))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    tops = []
    for x in langs:
        by[x].sort(key=lambda v: v[:3])
        tops.append(proof([v[2] for v in by[x]], 0, fan)[0])
    out = []
    for k, x in enumerate(langs):
        root, high = proof(tops, k, fan)
        leaves = [v[2] for v in by[x]]
        out += [(v[3], v[2], tops[k], root, tuple(proof(leaves, i, fan)[1] + high)) for i, v in enumerate(by[x])]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in df.collect()), key=repr)


EDGE = ([(i, "web", "en", i, f"text {i % 7}") for i in range(1, 150)]           # several blocks, the last one short
        + [(500, "web", "en", 3, "same")] * 70                                     # equal rows over a block
        + [(7, "b", "de", 1, "x"), (7, "a", "de", 1, "y"), (None, None, "de", None, None), (8, "", "de", 0, "")]
        + [(i, "s", None, None, "ü" * i) for i in range(3)]                       # null group
        + [(1, "s", "", 2, "x" * 200_000)]                                        # empty group name, long text, lone leaf
        + [(2, "s", "ü", 2, "  z"), (3, "s", "z", 2, "q")])


@pytest.mark.parametrize("fan", [2, 3])
def test_manifest_equals_plain_python(spark, fan):
    docs = spark.createDataFrame(EDGE, SCHEMA).repartition(5).withColumn("root", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("proof", F.lit(0))
    m = merkle.manifest(docs, fan=fan)
    assert got(m) == plain(EDGE, fan)
    assert m.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()


def test_a_changed_row_does_not_fold_to_the_root(spark):
    docs = spark.createDataFrame(EDGE[:140], SCHEMA)
    claim = merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + F.lit(1), F.col("text"))
    m = merkle.manifest(docs, claim=claim)
    assert m.where(merkle.fold(F.col("claim"), F.col("proof")) == F.col("root")).isEmpty()


def test_empty_and_single(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    (r,) = merkle.manifest(spark.createDataFrame([(1, "a", None, 2, "t")], SCHEMA)).collect()
    assert r.leaf == r.subroot == r.root == h("1:1", "1:a", "-", "1:2", "1:t") and r.proof == []


def test_fan_of_one_is_refused(spark):
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], SCHEMA), fan=1)
