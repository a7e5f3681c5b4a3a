"""Predicates and projections (PRJ-1 .. PRJ-15).

Key filters and column choices are written as plain ``where`` / ``select`` so
Catalyst pushes them into the scan (``PushedFilters: [EqualTo(..)]``,
``[In(..)]`` and a narrowed ``ReadSchema``).  A *pair frame* is a DataFrame
with columns ``key`` and ``value``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def point_filter(df: DataFrame, key: str, value) -> DataFrame:
    """PRJ-1: rows whose ``key`` equals ``value``."""
    return df.where(F.col(key) == F.lit(value))


def in_filter(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """PRJ-2: rows whose ``key`` is in ``values``; an empty list gives no rows."""
    return df.where(F.col(key).isin(list(values)))


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-3: keep only ``cols``."""
    return df.select(*cols)


def first_value(df: DataFrame, key: str, value, column: str) -> DataFrame:
    """PRJ-4: ``column`` of the first row whose ``key`` equals ``value``.

    The limit is the operator itself (the reference takes the first row).
    """
    return point_filter(df, key, value).select(column).limit(1)


def key_by(df: DataFrame, key: str | Column, value: str | Column | None = None) -> DataFrame:
    """PRJ-5: a pair frame keyed by ``key``; the value is ``value`` or the whole row."""
    v = _c(value) if value is not None else F.struct(*df.columns)
    return df.select(_c(key).alias("key"), v.alias("value"))


def map_values(pairs: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """PRJ-6 / UDF-4: transform the value of each pair, key unchanged."""
    return pairs.withColumn("value", f(F.col("value")))


def sub_record(*fields: str) -> Column:
    """PRJ-7: the named fields as one nested value."""
    return F.struct(*fields)


def point_profile(df: DataFrame, key: str, value, fields: Sequence[str]) -> DataFrame:
    """PRJ-8: point read of a profile keyed by ``key`` with ``fields`` as a sub-record."""
    return key_by(point_filter(df, key, value).select(key, *fields), key, sub_record(*fields))


def row_map(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """PRJ-9: a row as a name → value map (values as text)."""
    names = list(cols) if cols is not None else df.columns
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])


def field(m: str | Column, name: str) -> Column:
    """PRJ-9: look a field up in a row map (null when absent)."""
    return F.element_at(_c(m), F.lit(name))


def pair_side(pairs: DataFrame, side: str) -> DataFrame:
    """PRJ-11: the ``key`` or ``value`` side of a pair frame."""
    if side not in ("key", "value"):
        raise ValueError("side must be 'key' or 'value'")
    return pairs.select(side)


def by_position(df: DataFrame, k: int, v: int, as_text: bool = True) -> DataFrame:
    """PRJ-12: the columns at positions ``k`` and ``v`` as a pair frame."""
    kc, vc = F.col(df.columns[k]), F.col(df.columns[v])
    if as_text:
        kc, vc = kc.cast("string"), vc.cast("string")
    return df.select(kc.alias("key"), vc.alias("value"))


def rest_columns(df: DataFrame, key: str) -> DataFrame:
    """PRJ-13: pair frame key → list (as text) of the columns after the key."""
    rest = [F.col(c).cast("string") for c in df.columns if c != key]
    return df.select(F.col(key).alias("key"), F.array(*rest).alias("value"))


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    """PRJ-14: pair every row with a constant."""
    return df.withColumn(name, F.lit(value))


def increment(x: str | Column, by: int = 1) -> Column:
    """PRJ-15: element-wise arithmetic map (``x + by``)."""
    return _c(x) + F.lit(by)
