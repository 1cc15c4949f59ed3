"""Merkle manifest of a dataset over concatenated-level strings.

Every row is a leaf digest. Leaves of a group stand in order; runs of ``fan``
consecutive nodes become a parent, level by level, until one node (the
group's subroot) remains; the subroots of all groups make one more tree of the
same law, whose top is the root.

A tree is cut into aligned blocks of ``fan ** DEPTH`` nodes. A block keeps each
of its levels as one string of concatenated hex digests: fixed-width substrings
of a level are hashed to the next one, and the substrings that flank a node
within its run are its siblings. The blocks' tops are the nodes of the next
round, whose blocks are made the same way, so the largest row is one block and
the rounds are the logarithm of the leaves. Proofs are composed on the way
back down: a node's proof is its flanks within the block, then its block's.

Places in a group come from one range exchange of the digests (texts are never
exchanged) and running sums over partitions, so a group of any size is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, DEPTH = 2, 6  # nodes a run, levels a block
HEX = 64           # characters of a digest


def field(value: Column) -> Column:
    """A value inside a leaf: ``-`` for null, else its UTF-8 byte count, ``:`` and itself."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated strings."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """Leaf digest of a row's values."""
    return digest(*(field(v) for v in values))


def fold(node: Column, proof: Column) -> Column:
    """Root that ``node`` and its proof (array of left and right siblings, lowest level first) lead to."""
    return F.aggregate(proof, node, lambda h, s: digest(s["left"], h, s["right"]))


def siblings(proof: Column) -> Column:
    """All digests of a proof as one string, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (written; with ``key``) plus ``pos``, the place within ``key`` in ``order``, and ``total``, the rows of the key.

    One exchange by range. Rows that tie in ``order`` are cut apart by their place in the table, so that
    no number of equal rows meets in one task.
    """
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    by = [F.col("key"), *order, F.col("tie")]
    laid = materialize(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
                       .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "merkle-sorted")
    spans = laid.groupBy("key", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    spans = spans.select("key", "part", "first", F.expr("sum(n) over (partition by key order by part) - n").alias("before"),
                         F.expr("sum(n) over (partition by key)").alias("total"))  # a row for each key and partition
    return laid.join(spans, ["key", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before")


def _rounds(total: Column, fan: int) -> Column:
    """Levels above ``total`` nodes, at most the depth of a block."""
    return F.size(F.filter(F.array(*(F.lit(fan ** i).cast("long") for i in range(DEPTH))), lambda width: width < total))


def _parents(level: Column, fan: int) -> Column:
    runs = F.ceil(F.length(level) / (HEX * fan)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * (HEX * fan) + 1, F.lit(HEX * fan)).cast("binary"), 256)), "")


def blocks(nodes: DataFrame, fan: int, carry: list[str]) -> DataFrame:
    """(key, total, block, rows, levels) of ``nodes`` (key, total, pos, h, *carry).

    rows: (pos, h, *carry) in order, at most ``fan ** DEPTH``; levels: its levels as strings, lowest first.
    """
    size = fan ** DEPTH
    held = (nodes.groupBy("key", "total", F.floor(F.col("pos") / size).alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "h", *carry))).alias("rows")))
    base = F.array(F.array_join(F.col("rows.h"), ""))
    rounds = _rounds(F.col("total"), fan)
    grown = F.aggregate(F.sequence(F.lit(1), rounds), base, lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1), fan))))
    return held.withColumn("levels", F.when(rounds > 0, grown).otherwise(base))


def _flanks(i: Column, levels: Column, fan: int) -> Column:
    """Siblings of the block's node number ``i`` on every level but the top one."""
    def at(level: Column, up: Column) -> Column:
        n = F.floor(i / F.pow(F.lit(fan), up)).cast("int")
        run = n - n % fan
        return F.struct(F.substring(level, run * HEX + 1, (n - run) * HEX).alias("left"),
                        F.substring(level, (n + 1) * HEX + 1, (run + fan - 1 - n) * HEX).alias("right"))
    return F.transform(F.slice(levels, 1, F.size(levels) - 1), at)


def climb(nodes: DataFrame, fan: int, carry: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, and (key, h): the top of every key's tree."""
    size, made, left = fan ** DEPTH, [], nodes.agg(F.max("total")).first()[0]
    while True:
        made.append(materialize(blocks(nodes, fan, carry if not made else []), "merkle-blocks"))
        nodes = made[-1].select("key", F.ceil(F.col("total") / size).alias("total"), F.col("block").alias("pos"), F.element_at("levels", -1).alias("h"))
        if not left or left <= size:
            return made, nodes.select("key", "h")
        left = -(-left // size)


def descend(made: list[DataFrame], tops: DataFrame, fan: int, carry: list[str], down: list[str]) -> DataFrame:
    """(key, h, *carry, *down, proof) of every leaf; ``tops`` has key, *down and the proof of each key's top."""
    size, over = fan ** DEPTH, tops.withColumn("block", F.lit(0).cast("long"))
    for n, round_ in reversed(list(enumerate(made))):
        names = carry if n == 0 else []
        each = round_.join(over, ["key", "block"]).select("key", *down, "levels", "proof", F.explode("rows").alias("r"))
        i = (F.col("r.pos") % size).cast("int")
        over = each.select("key", *down, F.col("r.pos").alias("block"), F.col("r.h").alias("h"), *(F.col(f"r.{c}").alias(c) for c in names),
                           F.concat(_flanks(i, F.col("levels"), fan), F.col("proof")).alias("proof"))
    return over.drop("block")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, by: str = "lang", order: str = "doc_id", fan: int = FAN,
             claim: Column | None = None) -> DataFrame:
    """One row per input row: (id, leaf, subroot, root, proof, claim).

    Groups are the values of ``by`` (null is one of them), leaves of a group
    ascend by ``order`` (null first; rows with one id by their digest, equal
    rows are interchangeable), subroots by the group's value (null first,
    bytewise). ``proof`` is an array of (left, right) sibling digests from the
    leaf to the root, with an empty string where a side has none; ``claim`` is
    carried along untouched (a digest to verify, say). Null and empty values
    differ inside a leaf; values of any length are hashed whole. Columns
    outside ``fields`` are not read, so their names cannot clash. An empty
    table gives an empty manifest.
    """
    if fan < 2:
        raise ValueError("a run has two nodes or more")
    claim = F.lit(None).cast("string") if claim is None else claim
    leaves = materialize(docs.select(field(F.col(by)).alias("key"), F.col(by).alias("name"), F.col(order).alias("id"),
                                     leaf(*(F.col(c) for c in fields)).alias("h"), claim.alias("claim")), "merkle-leaves")
    carry = ["id", "claim"]
    low, subroots = climb(placed(leaves.drop("name"), [F.col("id").asc_nulls_first(), F.col("h")]), fan, carry)
    names = leaves.groupBy("key").agg(F.first("name").alias("name"))
    groups = materialize(subroots.join(names, "key").select(F.lit("").alias("key"), F.col("key").alias("group"), "name", "h"), "merkle-subroots")
    high, root = climb(placed(groups, [F.col("name").asc_nulls_first()]).drop("name"), fan, ["group"])
    top = root.select("key", F.col("h").alias("root"), F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("proof"))
    over = descend(high, top, fan, ["group"], ["root"]).select(F.col("group").alias("key"), F.col("h").alias("subroot"), "root", "proof")
    return (descend(low, materialize(over, "merkle-tops"), fan, carry, ["subroot", "root"])
            .select("id", F.col("h").alias("leaf"), "subroot", "root", "proof", "claim"))
