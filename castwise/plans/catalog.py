"""Query registry: name -> (Spark plan builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
driver tables of that folder; builders that share a stage table write it first. Floating results are rounded to 6 digits and
every computed column is aliased, in the plan and in its oracle alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..sources import roles
from ..sources.tables import Tables


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, ids: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ids)
        return fn
    return deco


class Ctx:
    """Per-query inputs: lazy role views and their cleaned forms.

    Tables that several queries read (roles, feature store) are written once.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.t = Tables(spark, sf_dir)

    @cached_property
    def items(self) -> DataFrame:
        """Items with their text, joined to the written rows."""
        return roles.with_synopsis(self.items_core, self.t)

    @cached_property
    def item_texts(self) -> DataFrame:
        """``(item_id, text_id, copies, n_rows)`` of every item id: its text (null: none), its rows, and its rows joined with texts."""
        ids = self.t.documents.select("doc_id").where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_texts"))
        keyed = roles.text_keys(self.items_core.groupBy("item_id").agg(F.count(F.lit(1)).alias("copies")), self.t)
        both = keyed.join(ids, F.col("doc_key") == F.col("doc_id"), "left")
        return both.select("item_id", F.when(F.col("has_text"), F.col("doc_id")).alias(roles.TEXT_KEY), "copies",
                           (F.col("copies") * F.coalesce("_texts", F.lit(1))).alias("n_rows"))

    @cached_property
    def reviews(self) -> DataFrame:
        """Reviews with their text, joined to the written rows."""
        rows, key = self.reviews_core.columns, roles.TEXT_KEY
        held = self.reviews_keyed.where(F.col(key).isNotNull()).join(roles.review_texts(self.spark, self.sf_dir), key)
        none = self.reviews_keyed.where(F.col(key).isNull()).withColumn("review_text", F.lit(None).cast("string"))
        return held.select(*rows, "review_text").unionByName(none.select(*rows, "review_text"))

    @cached_property
    def credits(self) -> DataFrame:
        return self._role_table("credits", lambda: roles.credits(self.spark, self.sf_dir))

    def _role_table(self, name: str, build) -> DataFrame:
        """A text-free role, written once per application (the raw input
        tables of the original system are files loaded by every step)."""
        from ..session import materialize, stage
        return stage(self.spark, ("role", name, self.sf_dir), self.inputs(),
                     lambda: materialize(build(), f"role-{name}"))

    @cached_property
    def items_core(self) -> DataFrame:
        """Items without the synopsis: no documents join."""
        return self._role_table("items", lambda: roles.items(self.spark, self.sf_dir, with_text=False))

    @cached_property
    def reviews_core(self) -> DataFrame:
        """Reviews without their text: no documents join."""
        return self.reviews_keyed.drop(roles.TEXT_KEY)

    @cached_property
    def reviews_keyed(self) -> DataFrame:
        """Reviews with the key of their text in its place."""
        return self._role_table("reviews", lambda: roles.reviews(self.spark, self.sf_dir, with_text=False, keyed=True))

    @cached_property
    def reviews_clean_keyed(self) -> DataFrame:
        return C.clean_reviews(self.reviews_keyed)

    def by_text(self, rows: DataFrame, of, through=lambda rows: rows) -> DataFrame:
        """Keyed review rows with the columns that ``of`` makes of their texts.

        ``of`` takes ``(text_id, review_text)`` and works on every document
        once, however many reviews hold it; the reviews meet its columns only.
        Reviews without a text get those of the filled text, and are not
        exchanged. ``through`` is a step for the rows before they meet the columns.
        """
        key = roles.TEXT_KEY
        found = of(C.fill_constants(roles.review_texts(self.spark, self.sf_dir), C.REVIEW_FILLS))
        none = of(self.spark.range(1).select(F.col("id").alias(key), F.lit(C.REVIEW_FILLS["review_text"]).alias("review_text")))
        held = through(rows.where(F.col(key).isNotNull())).join(found, key)
        blank = through(rows.where(F.col(key).isNull())).drop(key).crossJoin(F.broadcast(none.drop(key)))  # one row
        return held.drop(key).unionByName(blank)

    @cached_property
    def items_clean_core(self) -> DataFrame:
        return C.clean_items(self.items_core)

    @cached_property
    def reviews_clean_core(self) -> DataFrame:
        return C.clean_reviews(self.reviews_core)

    @cached_property
    def item_keys(self) -> DataFrame:
        """(item_id, item_name) only: a part scan, no joins."""
        return roles.item_keys(self.spark, self.sf_dir)

    @cached_property
    def features(self) -> DataFrame:
        """The long feature store, written once under the checkpoint dir.

        Similarity and ranking plans read it three or more times; reading
        the written table cuts the lineage (TF-IDF, cleaning, joins) and
        a lost executor re-reads files instead of recomputing it.
        """
        from ..session import materialize, stage
        from .featuring import build_feature_store
        return stage(self.spark, ("feature_store", self.sf_dir), self.inputs(),
                     lambda: materialize(build_feature_store(self), "feature_store"))

    def inputs(self) -> list[str]:
        from ..sources.tables import TABLES, table_path
        return [table_path(self.sf_dir, t) for t in TABLES]

    @cached_property
    def items_clean(self) -> DataFrame:
        return C.clean_items(self.items, self.items_core)

    @cached_property
    def reviews_clean(self) -> DataFrame:
        return C.clean_reviews(self.reviews)

    @cached_property
    def credits_clean(self) -> DataFrame:
        return C.clean_credits(self.credits)


def all_queries() -> dict[str, Query]:
    # importing the group modules fills the registry
    from . import cleaning, profiling, featuring, texts, recs, factoring, runs  # noqa: F401
    return REGISTRY
