"""Co-appearance graph of the most credited persons.

Persons are ranked by distinct items (T4); credits are semi-joined to the
top ``top_n`` (J6) and gathered per item, so an item yields at most
top_n * (top_n - 1) / 2 pairs (J7) however many credits it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .credits import top_persons_by_items


def shared_items(credits_clean: DataFrame, top_n: int = 25) -> DataFrame:
    """The items on every edge, long: ``(person_a, person_b, item)``, a < b.

    An item's listed persons (at most ``top_n``) are gathered once and its
    pairs made within the row: one pass over the credits, no self join.
    """
    top = top_persons_by_items(credits_clean, top_n).select("actor_name")
    cast = (credits_clean.where(F.col("item_name").isNotNull()).join(top, "actor_name", "left_semi")
            .groupBy("item_name").agg(F.sort_array(F.collect_set("actor_name")).alias("p")))
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return cast.select(F.col("item_name").alias("item"), F.explode(pairs).alias("e")).select(
        F.col("e.a").alias("person_a"), F.col("e.b").alias("person_b"), "item")


def co_appearance_edges(credits_clean: DataFrame, top_n: int = 25) -> DataFrame:
    """Undirected edges ``(person_a, person_b, n_items, first_item)``, a < b."""
    return (shared_items(credits_clean, top_n).groupBy("person_a", "person_b")
            .agg(F.count(F.lit(1)).alias("n_items"), F.min("item").alias("first_item")))


def graph_size(edges: DataFrame) -> DataFrame:
    """One row ``(n_nodes, n_edges)``; isolated persons are not nodes.

    One pass over the edges: each edge yields its two endpoints, so the
    endpoint rows number 2 x edges.
    """
    ends = edges.select(F.explode(F.array("person_a", "person_b")).alias("p"))
    return ends.agg(F.count_distinct("p").alias("n_nodes"),
                    (F.count(F.lit(1)) / 2).cast("long").alias("n_edges"))
