"""Micro-batch control (STM-1 .. STM-3, UDF-5).

Errors are never swallowed: a failed query raises from :func:`run_bounded`.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

DEFAULT_INTERVAL_MS = 500


def trigger(interval_ms: int | None = DEFAULT_INTERVAL_MS, available_now: bool = False) -> dict:
    """STM-1: keyword arguments for ``DataStreamWriter.trigger``.

    ``available_now`` drains what is there in as many batches as the source's
    rate limit asks for, then stops (tests, backfills).
    """
    if available_now:
        return {"availableNow": True}
    return {"processingTime": f"{interval_ms} milliseconds"}


def start(writer: DataStreamWriter, checkpoint: str, trig: dict | None = None,
          name: str | None = None) -> StreamingQuery:
    """STM-2: start a query with its own checkpoint (replayable progress)."""
    w = writer.option("checkpointLocation", checkpoint).trigger(**(trig or trigger()))
    if name:
        w = w.queryName(name)
    return w.start()


def stop(query: StreamingQuery) -> None:
    """STM-2: stop a query (idempotent)."""
    if query.isActive:
        query.stop()


def drain(*queries: StreamingQuery) -> None:
    """Wait for ``available_now`` queries that run at the same time; a failure is raised."""
    for q in queries:
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()


class RowsRead(StreamingQueryListener):
    """Input rows by query, for predicates of :func:`run_bounded` (STM-3, STM-9).

    Totals the progress of every batch, however many there are, in constant memory: batch
    ids of a query only rise, and a batch that runs again replaces its own count.  A query
    keeps its id over restarts, so one counter follows it as long as the driver lives.

        with RowsRead(spark) as rows:
            q = micro.start(...)
            micro.run_bounded(q, lambda: rows.of(q) < expected, timeout_s=60)
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._lock = spark, threading.Lock()
        self._counts: dict[str, tuple[int, int, int]] = {}  # query → (rows before the last batch, its id, its rows)

    def __enter__(self) -> RowsRead:
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self._spark.streams.removeListener(self)

    def add(self, query: str, batch: int, rows: int) -> None:
        with self._lock:
            before, last, n = self._counts.get(query, (0, -1, 0))
            if batch > last:
                self._counts[query] = (before + n, batch, rows)
            elif batch == last:
                # a replay has the same rows; an idle report of the same batch has none
                self._counts[query] = (before, last, max(n, rows))

    def of(self, query: StreamingQuery) -> int:
        with self._lock:
            before, _, n = self._counts.get(str(query.id), (0, -1, 0))
        return before + n

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.add(str(event.progress.id), event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_bounded(queries: StreamingQuery | Sequence[StreamingQuery], should_continue: Callable[[], bool],
                timeout_s: float, poll_s: float = 0.2) -> None:
    """STM-3 / UDF-5: let one or several queries run at the same time while
    ``should_continue()`` is true, polling every ``poll_s``; then stop them all.

    One predicate and one limit govern them.  ``TimeoutError`` if the predicate
    has not released the wait by then: the results would be partial.  A failed
    query raises its error.
    """
    running = [queries] if isinstance(queries, StreamingQuery) else list(queries)
    deadline = time.monotonic() + timeout_s
    try:
        while should_continue():
            for q in running:
                if q.exception() is not None:
                    raise q.exception()
            if not any(q.isActive for q in running):
                raise RuntimeError("all queries ended before the predicate released the wait")
            if time.monotonic() > deadline:
                raise TimeoutError(f"not released within {timeout_s} s")
            time.sleep(poll_s)
    finally:
        for q in running:
            stop(q)
