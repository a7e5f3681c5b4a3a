"""Aggregations per key (AGG-1 .. AGG-5) and keyed merges (FN-2, FN-6).

Every aggregate here is partial-aggregated on the map side before the shuffle
(by hash, or by a local sort where the buffer holds text or structs), so a key holding a
third of all rows sends one buffer per map task, not its rows.  "Last" is
always made explicit with an ordering column, never left to arrival order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_by_value(df: DataFrame, value: str, name: str = "count") -> DataFrame:
    """AGG-1: number of rows per distinct ``value``."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias(name))


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    """AGG-2: one row with the row count."""
    return df.agg(F.count(F.lit(1)).alias(name))


#: Doubles are added up as integers in units of 2 ** (BLOCK_BITS * block).
BLOCK_BITS = 8
#: Blocks of the values that have no digits.
NAN, PLUS_INF, MINUS_INF = 10_001, 10_002, 10_003
BLOCK, PART = "_block", "_part"


def is_double(dtype: T.DataType | str) -> bool:
    return (dtype if isinstance(dtype, str) else dtype.simpleString()) in ("double", "float")


def plain_sum(x: str | Column, dtype: T.DataType | str) -> Column:
    """Sum of integers (as a long) or decimals; a total beyond the type raises in ANSI mode."""
    name = dtype if isinstance(dtype, str) else dtype.simpleString()
    return F.sum(_c(x)) if name.startswith("decimal") else F.sum(_c(x).cast("decimal(20,0)")).cast("long")


def exact_parts(x: str | Column) -> list[Column]:
    """``BLOCK`` and ``PART`` of a double, so that sums of parts per block lose nothing.

    The block follows the exponent.  A part is the value in the block's unit: a whole
    number below 2 ** 62, as the unit is below the value's last digit; scaling by powers
    of two, in two steps, is exact.  NaN and the infinities are counted in blocks of
    their own; a null's part is null."""
    v = _c(x).cast("double")
    block = F.floor((F.floor(F.log2(F.abs(v))) - 53) / BLOCK_BITS)
    half = F.floor(-block * BLOCK_BITS / 2)
    digits = v * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -block * BLOCK_BITS - half)
    inf = F.lit(float("inf"))

    def cases(nan, plus, minus, zero, other):
        return (F.when(v.isNull() | (v == 0), zero).when(F.isnan(v), nan).when(v == inf, plus).when(v == -inf, minus).otherwise(other))

    return [cases(*map(F.lit, (NAN, PLUS_INF, MINUS_INF, 0)), block).cast("int").alias(BLOCK),
            cases(*[F.lit(1)] * 3, F.when(v == 0, 0), digits.cast("long")).cast("decimal(28,0)").alias(PART)]


@F.arrow_udf(T.DoubleType())
def _total(blocks: pa.Array, sums: pa.Array) -> pa.Array:
    def total(pairs) -> float | None:
        there = {b: int(s) for b, s in pairs if s is not None}
        if there.get(NAN) or there.get(PLUS_INF) and there.get(MINUS_INF):
            return math.nan
        if there.get(PLUS_INF) or there.get(MINUS_INF):
            return math.inf if there.get(PLUS_INF) else -math.inf
        if not there:
            return None
        low = min(there)
        n = sum(s << BLOCK_BITS * (b - low) for b, s in there.items())
        try:  # both ways round once, to the nearest double
            return float(n << BLOCK_BITS * low) if low >= 0 else n / (1 << -BLOCK_BITS * low)
        except OverflowError:
            return math.inf if n > 0 else -math.inf

    return pa.array([total(zip(b, s)) for b, s in zip(blocks.to_pylist(), sums.to_pylist())], pa.float64())


def exact_total(parts: Column) -> Column:
    """The double nearest to the sum, from one key's (block, sum of parts) structs: 270 at most."""
    return _total(F.transform(parts, lambda p: p[BLOCK]), F.transform(parts, lambda p: p[PART]))


def totals(sums: DataFrame, key: str | Sequence[str], name: str, *others: Column) -> DataFrame:
    """One total per key from rows of (key, ``BLOCK``, ``PART`` summed up); ``others`` aggregate along."""
    keys = [key] if isinstance(key, str) else list(key)
    parts = sums.groupBy(*keys).agg(F.collect_list(F.struct(BLOCK, PART)).alias("_parts"), *others)
    return parts.withColumn(name, exact_total(F.col("_parts"))).drop("_parts")


def sum_per_key(df: DataFrame, key: str | Sequence[str], value: str, name: str = "total") -> DataFrame:
    """AGG-3: exact sum of ``value`` per key, whatever the order of the rows.

    Integers stay long and decimals decimal.  For doubles it is the double nearest to the
    true sum of all finite values, an infinity beyond the range; NaN and the infinities
    behave as in arithmetic.  Nulls don't count; only nulls give null.  Two partial
    aggregates: per key and block of exponents, then per key over its few blocks."""
    keys = [key] if isinstance(key, str) else list(key)
    dtype = df.schema[value].dataType
    if not is_double(dtype):
        return df.groupBy(*keys).agg(plain_sum(value, dtype).alias(name))
    sums = df.select(*keys, *exact_parts(value)).groupBy(*keys, BLOCK).agg(F.sum(PART).alias(PART))
    return totals(sums, keys, name)


def last_per_key(df: DataFrame, key: str | Sequence[str], value: str | Column,
                 order: Sequence[str], name: str = "last") -> DataFrame:
    """AGG-4: one value per key, the one with the greatest ``order`` tuple."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(
        F.max_by(_c(value), F.struct(*order)).alias(name))


def set_per_key(df: DataFrame, key: str | Sequence[str], value: str | Column,
                name: str = "segset", value_is_set: bool = False) -> DataFrame:
    """AGG-5: the union of ``value`` per key as a sorted distinct array.

    Set-valued input is exploded first; the partial ``collect_set`` then
    dedups per map task, so the shuffle carries at most one element per
    (task, key, element).
    """
    keys = [key] if isinstance(key, str) else list(key)
    v = _c(value)
    if value_is_set:
        df = df.select(*keys, F.explode_outer(v).alias("_e"))
        v = F.col("_e")
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(v)).alias(name))


def merge_latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """FN-2: two keyed tables merged; where both have a key, ``new`` wins.

    Both sides have one row per key; a full outer join on the key, each column
    from ``new`` when the key is present there.
    """
    cols = [c for c in new.columns if c != key]
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols])
    n = new.select(key, F.lit(True).alias("_in_new"),
                   *[F.col(c).alias(f"_n_{c}") for c in cols])
    j = o.join(n, key, "full_outer")
    return j.select(key, *[F.when(F.col("_in_new"), F.col(f"_n_{c}"))
                          .otherwise(F.col(f"_o_{c}")).alias(c) for c in cols])


def build_map(df: DataFrame, group: str | Sequence[str], key: str, value: str | Column,
              order: Sequence[str], name: str = "entries") -> DataFrame:
    """FN-6: single-entry maps merged into one map per ``group``, the last
    value (by ``order``) winning for a repeated map key.

    The map keys should come from a bounded domain (such as an event type):
    the map of one group is built in one task.  The last value per
    (group, key) is reduced first, with partial aggregation.
    """
    groups = [group] if isinstance(group, str) else list(group)
    last = last_per_key(df, [*groups, key], value, order, "_v")
    return last.groupBy(*groups).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), F.col("_v")))))
        .alias(name))


def collect_map(df: DataFrame, key: str, value: str, max_rows: int = 100_000) -> dict:
    """SNK-5: a *small* keyed result to a driver dict (repeated keys: one value).

    For tests and reports on results already reduced to one row per key.  At
    most ``max_rows`` rows are taken (a bounded take, one job); a larger
    result raises instead of pulling everything through the driver.
    """
    rows = df.select(key, value).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows: not a small keyed result")
    return {r[0]: r[1] for r in rows}


def overlap_count(a: DataFrame, b: DataFrame, name: str = "n") -> DataFrame:
    """FN-4 on tables: the number of distinct rows ``a`` and ``b`` share,
    as a one-row frame (the intersection is a shuffle on the row, never a
    driver set)."""
    return a.intersect(b).agg(F.count(F.lit(1)).alias(name))
