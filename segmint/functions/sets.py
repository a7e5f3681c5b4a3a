"""Set-valued column functions (FN-1, FN-3, FN-4, FN-5, PRJ-10).

A profile's segment set is an ``array`` column kept *distinct and sorted* at
every boundary, so equal sets are equal arrays and hash alike.  A null set is
treated as empty.  All of these are Catalyst expressions: they run inside
whole-stage codegen on the executors, never in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_set(x: str | Column) -> Column:
    """FN-5 / PRJ-10: any array to a normalized set (distinct, sorted, never null).

    The empty array literal is coerced to the element type of ``x``.
    """
    return F.sort_array(F.array_distinct(F.coalesce(_c(x), F.array())))


def union(a: str | Column, b: str | Column) -> Column:
    """FN-1: ``a ∪ b`` as a normalized set.

    ``array_union`` returns null if either side is null, so both sides are
    coalesced to the empty set first.
    """
    return F.sort_array(F.array_union(F.coalesce(_c(a), F.array()),
                                      F.coalesce(_c(b), F.array())))


def map_elements(x: str | Column, f: Callable[[Column], Column]) -> Column:
    """FN-3 / UDF-4: apply ``f`` to every element; the result is again a set."""
    return F.sort_array(F.array_distinct(F.transform(_c(x), f)))


def overlap_size(a: str | Column, b: str | Column) -> Column:
    """FN-4 (columns): ``|a ∩ b|`` as a long; null sets count as empty."""
    return F.coalesce(F.size(F.array_intersect(_c(a), _c(b))), F.lit(0)).cast("long")


def to_text(x: str | Column, sep: str = ",") -> Column:
    """A set as stable text (sorted, comma-joined) for reports and hashing."""
    return F.array_join(F.sort_array(_c(x)), sep)
