"""Keyed lookups and joins (JOIN-1 .. JOIN-7).

All joins are equi-joins on a key, written as plain joins: the optimizer and
AQE choose the strategy from the sizes they see at run time (a broadcast below
the cluster's threshold, else a shuffle join whose hot partitions are split).
Nothing is counted or collected while a plan is made, and nothing is broadcast
by hint.  Table keys may repeat and may be of any type that can be compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sets


def join_tables(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JOIN-1: inner join on ``key``; both full rows kept as ``left`` / ``right``
    structs.  Table against table: a shuffle join sized by AQE."""
    lt = left.select(F.col(key).alias("_k"), F.struct(*left.columns).alias("left"))
    rt = right.select(F.col(key).alias("_k"), F.struct(*right.columns).alias("right"))
    return lt.join(rt, "_k").select(F.col("_k").alias(key), "left", "right")


def join_typed(left: DataFrame, right: DataFrame, key: str,
               schema: T.StructType) -> DataFrame:
    """JOIN-6: JOIN-1 where each side is first read as a declared record type."""
    def typed(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return join_tables(typed(left), typed(right), key)


def rekey_rest(joined: DataFrame, key: str, side: str = "right") -> DataFrame:
    """JOIN-7: a join result re-keyed to ``key`` → the rest of the ``side`` row
    (the columns after the key, as text)."""
    fields = [f.name for f in joined.schema[side].dataType.fields if f.name != key]
    return joined.select(F.col(key).alias("key"),
                         F.array(*[F.col(f"{side}.{n}").cast("string") for n in fields])
                         .alias("value"))


def lookup_keys(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """JOIN-2: key list → (key, matching table row as ``row``).

    A repeated key is repeated in the output; keys missing from the table are
    absent; an empty key list gives no rows.
    """
    return keys.select(key).join(table.select(F.col(key), F.struct(*table.columns).alias("row")), key)


def lookup_sets(keys: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """JOIN-3: key list → (key, set); missing keys absent, repeats collapse."""
    return table.join(keys.select(key), key, "left_semi").select(F.col(key), sets.as_set(value).alias(value))


def join_keyed(incoming: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """JOIN-4: a (key, set) collection looked up in the table; only the
    table's (key, set) is kept, once per incoming row."""
    return lookup_keys(incoming, table.select(key, value), key).select(
        F.col(key), sets.as_set(F.col(f"row.{value}")).alias(value))


def enrich_merge(incoming: DataFrame, stored: DataFrame, key: str, value: str,
                 keep: Sequence[str] = ()) -> DataFrame:
    """JOIN-5: every incoming key kept, value = stored set ∪ incoming set.

    ``incoming`` has one row per key.  An empty input gives an empty result.
    ``keep`` names further stored columns to carry along (null for keys the
    table does not have yet).
    """
    inc = incoming.select(F.col(key), F.col(value).alias("_in"))
    st = stored.select(F.col(key), F.col(value).alias("_st"), *keep)
    return inc.join(st, key, "left").select(F.col(key), sets.union("_st", "_in").alias(value), *keep)
