"""Running per-key state over micro-batches (STM-4 .. STM-7, SNK-4, UDF-1, UDF-2).

The running value lives in the streaming state store (RocksDB-backed, with changelog
checkpoints, see ``session.DEFAULT_CONF``), one small row a key: exactly once, spread
over the executors, and committed with the query's progress.  :func:`state` reads it
as a table at the last committed batch, so no second copy is kept.  Consumers that
need each change get the updated rows of every batch (``update`` mode) through
:func:`to_table` or a ``foreachBatch`` of their own.  Nothing goes through the driver.

Sums of doubles are kept as exact parts per block of exponents, sets as one row an
element; both are put together when read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import aggregate as agg
from ..sources.keyed import KeyedTable
from . import micro


def upsert_sink(table: KeyedTable, first_version: int = 1,
                order: Sequence[str] | None = None) -> Callable[[DataFrame, int], None]:
    """SNK-4 / UDF-2: a ``foreachBatch`` callback that upserts each batch.

    Empty batches write nothing (the emptiness guard of AGG-2).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            table.upsert(batch, first_version + batch_id, order=order)
    return write


def to_table(aggregated: DataFrame, table: KeyedTable, checkpoint: str,
             trig: dict | None = None, name: str | None = None,
             first_version: int = 1, mode: str = "update",
             order: Sequence[str] | None = None) -> StreamingQuery:
    """Start a stream with the upsert sink; returns the query.  The table version
    follows the batch id, so a replayed batch rewrites the same version."""
    w = aggregated.writeStream.outputMode(mode).foreachBatch(upsert_sink(table, first_version, order))
    return micro.start(w, checkpoint, trig, name)


def keep(running_: DataFrame, checkpoint: str, trig: dict | None = None, name: str | None = None) -> StreamingQuery:
    """Start a stream whose result is its state, for :func:`state` to read."""
    return micro.start(running_.writeStream.outputMode("update").format("noop"), checkpoint, trig, name)


def running(stream: DataFrame, key: str | Sequence[str], *aggs: Column,
            transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """STM-4 / STM-5 / UDF-1: optional stateless ``transform`` then a running
    aggregate per key."""
    s = stream.transform(transform) if transform else stream
    keys = [key] if isinstance(key, str) else list(key)
    return s.groupBy(*keys).agg(*aggs)


def state(spark: SparkSession, checkpoint: str, **columns: Column) -> DataFrame:
    """The running state of the query with this checkpoint: its keys, and ``columns`` of
    the stored values (:func:`count_state`, :func:`last_state`)."""
    stored = spark.read.format("statestore").load(checkpoint)
    return stored.select("key.*", *(c.alias(name) for name, c in columns.items()))


def _value(field: str) -> Column:
    return F.col(f"value.{field}")


def _sum() -> Column:
    """A stored sum; of nulls only it is null."""
    return F.when(~_value("isEmpty"), _value("sum"))


def running_count() -> Column:
    """STM-5: running number of rows per key (AGG-1 over batches); stored as :func:`count_state`."""
    return F.count(F.lit(1)).alias("n")


def count_state() -> Column:
    return _value("count")


def running_last(value: str, order: Sequence[str], name: str = "last") -> Column:
    """STM-6: running last value per key by an explicit order; stored as :func:`last_state`."""
    return F.max_by(F.col(value), F.struct(*order)).alias(name)


def last_state() -> Column:
    return _value("valueWithExtremumOrdering")


def running_sum(stream: DataFrame, key: str | Sequence[str], value: str, *aggs: Column) -> DataFrame:
    """STM-5: running exact sum per key (AGG-3 over batches), read by :func:`sum_state`.

    A key has one state row for each block of exponents that its values fall into (one for
    integers and decimals); ``aggs`` run along per row (counts: :func:`count_state`)."""
    keys = [key] if isinstance(key, str) else list(key)
    dtype = stream.schema[value].dataType
    if not agg.is_double(dtype):
        return stream.groupBy(*keys).agg(agg.plain_sum(value, dtype), *aggs)
    return stream.select("*", *agg.exact_parts(value)).groupBy(*keys, agg.BLOCK).agg(F.sum(agg.PART), *aggs)


def sum_state(spark: SparkSession, checkpoint: str, key: str | Sequence[str], dtype: T.DataType | str = "double",
              name: str = "total", count: str | None = None) -> DataFrame:
    """(key, total, and the row ``count`` if a running count ran along) of a :func:`running_sum`."""
    counts = {count: count_state()} if count else {}
    if agg.is_double(dtype):
        parts = state(spark, checkpoint, **{agg.PART: _sum()}, **counts)
        return agg.totals(parts, key, name, *(F.sum(c).alias(c) for c in counts))
    total = _sum()
    decimal = (dtype if isinstance(dtype, str) else dtype.simpleString()).startswith("decimal")
    return state(spark, checkpoint, **{name: total if decimal else total.cast("long")}, **counts)


def running_set(stream: DataFrame, key: str | Sequence[str], element: str) -> DataFrame:
    """STM-7: running set union per key: the stream's first (key, element) pairs.

    The state has one row an element, a batch emits its new pairs only, and a key's
    whole set is never in one row; :func:`set_state` puts it together.  Set-valued
    messages go through :func:`elements` first."""
    keys = [key] if isinstance(key, str) else list(key)
    return stream.select(*keys, element).dropDuplicates([*keys, element])


def set_state(spark: SparkSession, checkpoint: str, key: str | Sequence[str], element: str, name: str = "segset") -> DataFrame:
    """(key, sorted set) of a :func:`running_set`; its plain pairs are :func:`state`."""
    return agg.set_per_key(state(spark, checkpoint), key, element, name)


def elements(stream: DataFrame, value: str, name: str = "element") -> DataFrame:
    """STM-7: set-valued messages as one row per element (an empty or null set:
    one null element, so that its key still counts)."""
    return stream.withColumn(name, F.explode_outer(value)).drop(value)
