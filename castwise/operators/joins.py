"""Join helpers for keys that may be hot.

``gridded`` deals a key that is heavy on either side, or on both, over a grid
of cells: rows of the left side are split over the grid's rows and repeated in
its columns, rows of the right side the other way round, so an equi join on
the key and the cell gives the key's product without any cell holding more
than about ``CELL_ROWS`` rows of a side. Other keys stay in one cell.

``salted_join`` splits every key of the large side over ``buckets`` salts
(a hash of another column) and replicates the small side once per salt, so
a key holding a third of the rows is spread over ``buckets`` tasks whatever
AQE's skew thresholds are. Use it when the small side has a bounded number
of rows per key (the replication costs buckets x small).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT_BUCKETS = 16


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread_by: str,
                buckets: int = SALT_BUCKETS, how: str = "inner") -> DataFrame:
    """``big`` join ``small`` on ``on`` with the big side salted by ``spread_by``."""
    b = big.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread_by)), F.lit(buckets)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return b.join(s, on + ["_salt"], how).drop("_salt")


CELL_ROWS = 50_000   # rows of one side of a key that go into one cell
HEAVY_KEYS = 10_000  # keys that can be heavy at most: a heavy key holds more than this share of a side


def _parts(df: DataFrame, on: list[str], out: str, cell_rows: int) -> DataFrame:
    """(on, out): the parts that the heavy keys of ``df`` are dealt over; ``HEAVY_KEYS`` rows at most."""
    from ..session import materialize

    n = materialize(df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])).groupBy(*on).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    least = max(cell_rows, (n.agg(F.sum("n")).first()[0] or 0) // HEAVY_KEYS)
    return n.where(F.col("n") > least).select(*on, F.ceil(F.col("n") / least).cast("int").alias(out))


def _place(parts: str):
    """A part for every row by its place in the table, so that equal rows are split as well."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(parts, F.lit(1)).cast("long")).cast("int")


def _every(parts: str):
    return F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))


def gridded(left: DataFrame, right: DataFrame, on: list[str], cell_rows: int = CELL_ROWS, right_keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_row`` and ``_col``: join them on ``on + ["_row", "_col"]``.

    A key is heavy with more rows on a side than ``cell_rows`` and than that
    side's rows / ``HEAVY_KEYS``. Null keys go to cell (0, 0) and match nothing.
    The right side's rows are counted in ``right_keys`` if given: any choice of
    heavy keys gives the same join.
    """
    from ..session import materialize

    grid = _parts(left, on, "_rows", cell_rows).join(_parts(right if right_keys is None else right_keys, on, "_cols", cell_rows), on, "full_outer")
    heavy = F.broadcast(materialize(grid, "heavy-keys"))  # 2 * HEAVY_KEYS rows at most
    a = left.join(heavy, on, "left").withColumn("_row", _place("_rows")).withColumn("_col", _every("_cols"))
    b = right.join(heavy, on, "left").withColumn("_col", _place("_cols")).withColumn("_row", _every("_rows"))
    return a.drop("_rows", "_cols"), b.drop("_rows", "_cols")


def grid_join(left: DataFrame, right: DataFrame, on: list[str], cell_rows: int = CELL_ROWS, right_keys: DataFrame | None = None) -> DataFrame:
    """Inner equi join of two sides that may both be heavy in one key; (on, the left's others, the right's others)."""
    a, b = gridded(left, right, on, cell_rows, right_keys)
    return a.join(b, [*on, "_row", "_col"]).drop("_row", "_col")


def lookup_join(big: DataFrame, table: DataFrame, on: list[str], how: str = "left", cell_rows: int = CELL_ROWS) -> DataFrame:
    """``big`` joined with a table of one row a key; only rows of that table whose key is heavy in ``big`` are repeated."""
    from ..session import materialize

    heavy = F.broadcast(materialize(_parts(big, on, "_rows", cell_rows), "heavy-keys"))  # HEAVY_KEYS rows at most
    a = big.join(heavy, on, "left").withColumn("_row", _place("_rows")).drop("_rows")
    b = table.join(heavy, on, "left").withColumn("_row", _every("_rows")).drop("_rows")
    return a.join(b, [*on, "_row"], how).drop("_row")
