"""Per-batch merges with effects, topic relays and enrichment
(STM-8, STM-9, STM-11, UDF-3).

Each handler is a ``foreachBatch`` callback.  Within a batch the rows are
reduced to one per key first (partial aggregation, no driver round trip);
the effect sees that reduced batch *before* the keyed table changes, as in
the reference; the table upsert is versioned by batch id and so idempotent.
An effect that sends messages is an outbox (:func:`send`), so a crash between
effect and merge, and the replay after it, repeat nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sets
from ..operators import aggregate as agg
from ..operators import lookup
from ..sources import topics
from ..sources.keyed import KeyedTable


def last_in_batch(key: str, order: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Reducer: the last row (by ``order``) per key of a batch."""
    def reduce(df: DataFrame) -> DataFrame:
        cols = df.columns
        return (df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
                  .select("_r.*"))
    return reduce


def send(path: str, topic: str, messages: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """UDF-3: an effect that publishes ``messages(reduced)`` (``value``, and ``key`` if there is
    one) to the outbox at ``path``, each batch once (:func:`topics.write_batch`)."""
    def effect(reduced: DataFrame, batch_id: int) -> None:
        out = messages(reduced)
        topics.write_batch(out, path, topic, "value", batch_id, key="key" if "key" in out.columns else None)
    return effect


def merge_with_effect(table: KeyedTable, reduce: Callable[[DataFrame], DataFrame],
                      effect: Callable[[DataFrame, int], None] | None = None,
                      first_version: int = 1,
                      order: Sequence[str] | None = None) -> Callable[[DataFrame, int], None]:
    """STM-8 / UDF-3: reduce the batch by key, run ``effect`` on the reduced
    rows, then upsert them into ``table`` (by ``order``, if given)."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        reduced = reduce(batch).persist()
        try:
            if reduced.isEmpty():
                return
            if effect is not None:
                effect(reduced, batch_id)
            table.upsert(reduced, first_version + batch_id, order=order)
        finally:
            reduced.unpersist()
    return handle


def enrich_into(table: KeyedTable, key: str, element: str, value: str = "segset",
                first_version: int = 1) -> Callable[[DataFrame, int], None]:
    """STM-11: each batch's elements per key are unioned with the stored set
    (JOIN-5 against the table as it is *now*) and upserted back.

    Only the buckets that the batch's keys fall into are read and rewritten.
    Other stored columns (a score) are kept; new keys get nulls there.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        incoming = agg.set_per_key(batch, key, element, name=value).persist()
        try:
            if incoming.isEmpty():
                return
            v = first_version + batch_id
            stored = table.read_for(incoming, before=v)
            others = [c for c in stored.columns if c not in (key, value)]
            merged = lookup.enrich_merge(incoming, stored, key, value, keep=others)
            table.upsert(merged.select(*stored.columns), v)
        finally:
            incoming.unpersist()
    return handle


def enrich_static(stream: DataFrame, stored: DataFrame, key: str, value: str = "segset",
                  keep: Sequence[str] = ()) -> DataFrame:
    """STM-11 for a stored table that does not change while the stream runs:
    a stream-static left join, each incoming record's set unioned with the
    stored set of its key (``keep`` carries further stored columns).

    Stateless; :func:`enrich_into` reads only the buckets of a batch's keys
    and sees updates.
    """
    st = stored.select(F.col(key), F.col(value).alias("_st"), *keep)
    return (stream.join(st, key, "left")
                  .withColumn(value, sets.union("_st", value))
                  .drop("_st"))
