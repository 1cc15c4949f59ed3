"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import read_table  # noqa: F401  (re-exported for the queries)

#: Share of rows kept away from learning: crc32(doc_id as text) mod 4 is 2.
HELD_OUT_MOD, HELD_OUT_REST = 4, 2

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, mod 4 (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_MOD


def held_out(doc_id: str = "doc_id") -> Column:
    """True for held-out rows; a null id is not held out (and never learned from)."""
    return F.coalesce(fold(doc_id) == HELD_OUT_REST, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) != HELD_OUT_REST, F.lit(False))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


@contextmanager
def uncollected():
    """No cyclic garbage collection within: loops that make many small lasting objects and no cycles.

    The collector would walk a worker's memo again and again as it grows.
    """
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
