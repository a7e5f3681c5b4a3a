"""Streaming queries: the events table is published to topic directories and
consumed by Structured Streaming jobs that keep keyed tables current.

Every run works in fresh folders under the shared checkpoint root (topic
files, query checkpoints, keyed tables) and returns a batch
read of the final state (of the state store, a keyed table or a sink), which the SQL oracle checks against the same question asked of the
events table directly.  Topics are published in two parts with a restart of the
query in between, so state and progress outlive it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, sets
from ..operators import aggregate as agg
from ..session import fresh_dir
from ..sources import bucketed, topics
from ..sources.keyed import KeyedTable
from ..streaming import micro, relay, running
from . import bindings as B
from .batch import SQL_LAST, SQL_SETS, SUFFIX
from .bindings import SQL_SUM

Q = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def reg(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return reg


EVENT_SCHEMA = "event_id long, ts_us long, user_id long, event_type string, value double, k int"
DRAIN = micro.trigger(available_now=True)
TIMEOUT_S = 600


def event_messages(df: DataFrame, *extra: str) -> DataFrame:
    """Events as JSON messages keyed by user (FN-8)."""
    return df.select(
        "ts", *extra,
        F.col("user_id").cast("string").alias("key"),
        codec.render("event_id",
                     F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
                     "user_id", "event_type", "value", B.segment().alias("k")).alias("value"))


def halves(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The event log in the two parts that the streams get one after the other."""
    return [B.first_half(spark, sf), B.second_half(spark, sf)]


def feed_and_drain(parts: list[DataFrame], publish, start) -> None:
    """Publish a part, let the query read what is there, stop it; the next part
    finds it restarted from its checkpoint, with its state."""
    for part in parts:
        publish(part)
        micro.drain(start())


def parsed_events(spark: SparkSession, path: str) -> DataFrame:
    """The events topic as a stream of parsed records (SRC-6, FN-7, STM-4)."""
    s = topics.as_text(topics.stream_topic(spark, path))
    return s.select(codec.parse("value", EVENT_SCHEMA).alias("r")).select("r.*")


def _run(spark, sf, name: str, build) -> str:
    """The checkpoint of ``build(parsed events)``, run over both halves of the log."""
    root = fresh_dir(spark, name)
    path = f"{root}/topic"
    feed_and_drain(halves(spark, sf),
                   lambda part: topics.write_topic(event_messages(part), path, "events", "value", "key"),
                   lambda: running.keep(build(parsed_events(spark, path)), f"{root}/ckpt", DRAIN))
    return f"{root}/ckpt"


# ------------------------------------------------------------ running state
@query("stream_count", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_count(spark, sf):
    """STM-1/2/4/5, UDF-1: running count per event type, read from the query's state."""
    ckpt = _run(spark, sf, "stream_count", lambda s: running.running(
        s, "event_type", running.running_count(), transform=lambda d: d.select("event_type")))
    return running.state(spark, ckpt, n=running.count_state())


@query("stream_sum", f"SELECT user_id, {SQL_SUM} AS total FROM events GROUP BY user_id")
def stream_sum(spark, sf):
    """STM-5 / AGG-3 over batches: running exact sum per user, read from the query's state."""
    ckpt = _run(spark, sf, "stream_sum", lambda s: running.running_sum(s, "user_id", "value"))
    return running.sum_state(spark, ckpt, "user_id").withColumn("total", F.round("total", 6))


@query("stream_last", SQL_LAST)
def stream_last(spark, sf):
    """STM-6: running last event type per user by (ts, event_id), read from the query's state."""
    ckpt = _run(spark, sf, "stream_last", lambda s: running.running(
        s, "user_id", running.running_last("event_type", ["ts_us", "event_id"])))
    return running.state(spark, ckpt, last=running.last_state())


@query("stream_updates", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_updates(spark, sf):
    """SNK-4, UDF-2: each batch's changed counts upserted into a keyed table."""
    root = fresh_dir(spark, "stream_updates")
    path, table = f"{root}/topic", KeyedTable(spark, f"{root}/table", "event_type")

    def start():
        counts = running.running(parsed_events(spark, path), "event_type", running.running_count())
        return running.to_table(counts, table, f"{root}/ckpt", DRAIN)

    feed_and_drain(halves(spark, sf),
                   lambda part: topics.write_topic(event_messages(part), path, "events", "value", "key"), start)
    return table.read()


@query("stream_set", SQL_SETS)
def stream_set(spark, sf):
    """STM-7: running union of set-valued messages per user."""
    root = fresh_dir(spark, "stream_set")
    path = f"{root}/topic"

    def publish(part):
        msgs = part.select(codec.render(F.col("user_id").alias("id"), F.array(B.segment()).alias("seg")).alias("value"))
        topics.write_topic(msgs, path, "sets", "value")

    def start():
        s = topics.as_text(topics.stream_topic(spark, path)).select(
            codec.parse("value", "id long, seg array<int>").alias("r")).select("r.*")
        return running.keep(running.running_set(running.elements(s, "seg", "k"), "id", "k"), f"{root}/ckpt", DRAIN)

    feed_and_drain(halves(spark, sf), publish, start)
    return running.set_state(spark, f"{root}/ckpt", "id", "k").select("id", sets.to_text("segset").alias("segs"))


# ------------------------------------------------------------------ topics
# Fixed value: every so many messages one is cut short on purpose.
BAD_EVERY = 97


@query("topic_text", f"""
  SELECT CAST(user_id AS VARCHAR) AS key, event_id % {BAD_EVERY} = 0 AS bad,
         CASE WHEN event_id % {BAD_EVERY} <> 0 THEN event_id END AS event_id,
         CASE WHEN event_id % {BAD_EVERY} <> 0 THEN user_id END AS user_id,
         CASE WHEN event_id % {BAD_EVERY} <> 0 THEN event_type END AS event_type,
         CASE WHEN event_id % {BAD_EVERY} <> 0 THEN value END AS value
  FROM events""")
def topic_text(spark, sf):
    """SRC-6, FN-7, FN-8, SNK-3: JSON messages through a topic, parsed back;
    messages that don't parse are routed to an output of their own."""
    root = fresh_dir(spark, "topic_text")
    path, sink = f"{root}/topic", f"{root}/sink"
    msgs = event_messages(B.events(spark, sf), "event_id")
    cut = F.when(F.col("event_id") % BAD_EVERY == 0, F.substring("value", 1, 9)).otherwise(F.col("value"))
    topics.write_topic(msgs.withColumn("value", cut), path, "events", "value", "key")
    s = topics.as_text(topics.stream_topic(spark, path))
    out = codec.parse_checked(s, "value", EVENT_SCHEMA, "r").select("key", "value", "r", "bad")
    micro.drain(micro.start(out.writeStream.format("parquet").partitionBy("bad").option("path", sink), f"{root}/ckpt", DRAIN))
    stored = spark.read.schema(out.schema).parquet(sink)
    fields = ["event_id", "user_id", "event_type", "value"]
    return stored.select("key", "bad", *(F.when(~F.col("bad"), F.col(f"r.{c}")).alias(c) for c in fields))


@query("topic_binary", f"""
  SELECT CAST(event_id AS VARCHAR) || '{SUFFIX}' AS text,
         CAST(octet_length(CAST(CAST(event_id AS VARCHAR) || '{SUFFIX}' AS BLOB)) AS INTEGER) AS n_bytes
  FROM events""")
def topic_binary(spark, sf):
    """SRC-7, FN-9, FN-10, FN-11: byte messages kept binary in the stream,
    decoded at the end."""
    root = fresh_dir(spark, "topic_binary")
    path, sink = f"{root}/topic", f"{root}/sink"
    msgs = B.events(spark, sf).select(
        "ts", codec.text_to_bytes(codec.number_text("event_id", SUFFIX)).alias("value"))
    topics.write_topic(msgs, path, "bytes", "value")
    s = topics.stream_topic(spark, path)
    out = s.select(codec.bytes_to_text("value").alias("text"), F.octet_length("value").alias("n_bytes"))
    micro.drain(micro.start(out.writeStream.format("parquet").option("path", sink), f"{root}/ckpt", DRAIN))
    return spark.read.parquet(sink)


def _topics_by_type(spark, sf, root) -> dict[str, str]:
    """One topic per event type, all written in one pass over the events."""
    topics.write_topics(event_messages(B.events(spark, sf), "event_type"), root, "event_type", "value", "key")
    return {t: topics.topic_path(root, t) for t in topics.topic_names(spark, root)}


# The handler of each topic; others pass their values on.
HANDLERS = {"purchase": lambda d: d.withColumn("value", F.col("value") * 2),
            "view": lambda d: d.withColumn("value", F.lit(0.0))}


@query("topic_multi", """
  SELECT event_type AS topic, user_id, count(*) AS n,
         round(CAST(sum(CAST(CAST(CASE event_type WHEN 'purchase' THEN value * 2 WHEN 'view' THEN 0.0 ELSE value END
           AS VARCHAR) AS DECIMAL(38,18))) AS DOUBLE), 6) AS total
  FROM events GROUP BY event_type, user_id""")
def topic_multi(spark, sf):
    """SRC-8: several topics, each with its own handler, read at the same time."""
    root = fresh_dir(spark, "topic_multi")
    ckpts, live = {}, []
    for i, (topic, path) in enumerate(_topics_by_type(spark, sf, f"{root}/topics").items()):
        handled = HANDLERS.get(topic, lambda d: d)(parsed_events(spark, path))
        ckpts[topic] = f"{root}/ckpt{i}"
        live.append(running.keep(running.running_sum(handled, "user_id", "value", running.running_count()), ckpts[topic], DRAIN))
    micro.drain(*live)
    reads = [running.sum_state(spark, ckpt, "user_id", count="n").select(
        F.lit(topic).alias("topic"), "user_id", "n", F.round("total", 6).alias("total")) for topic, ckpt in ckpts.items()]
    return reduce(DataFrame.unionByName, reads)


@query("latest_offset", "SELECT event_type AS topic, count(*) AS next_offset FROM events GROUP BY event_type")
def latest_offset(spark, sf):
    """SRC-10: a bounded read of every topic and its number of messages, which is
    the next offset where a topic has one partition."""
    root = fresh_dir(spark, "latest_offset")
    paths = _topics_by_type(spark, sf, root)
    read = spark.read.schema(topics.TOPIC_SCHEMA).parquet(*paths.values())
    return topics.message_counts(read).withColumnRenamed("n", "next_offset")


@query("topic_earliest_resume", "SELECT event_id, user_id, event_type FROM events")
def topic_earliest_resume(spark, sf):
    """SRC-9, STM-2: start from the earliest message, stop, publish more, and
    restart from the checkpoint: every message is delivered once."""
    root = fresh_dir(spark, "topic_resume")
    path, sink = f"{root}/topic", f"{root}/sink"

    def start():
        out = parsed_events(spark, path).select("event_id", "user_id", "event_type")
        return micro.start(out.writeStream.format("parquet").option("path", sink), f"{root}/ckpt", DRAIN)

    feed_and_drain(halves(spark, sf),
                   lambda part: topics.write_topic(event_messages(part), path, "events", "value", "key"), start)
    return spark.read.parquet(sink)


@query("bounded_run", "SELECT event_id, user_id FROM events")
def bounded_run(spark, sf):
    """STM-1, STM-3, UDF-5: a 500 ms processing-time query, stopped when the
    continue-predicate (rows read still short of the published count) turns
    false; a passed time limit is an error."""
    root = fresh_dir(spark, "bounded_run")
    path, sink = f"{root}/topic", f"{root}/sink"
    events = B.events(spark, sf)
    topics.write_topic(event_messages(events), path, "events", "value", "key")
    expected = events.count()
    out = parsed_events(spark, path).select("event_id", "user_id")
    with micro.RowsRead(spark) as rows:
        q = micro.start(out.writeStream.format("parquet").option("path", sink), f"{root}/ckpt", micro.trigger(500))
        micro.run_bounded(q, lambda: rows.of(q) < expected, timeout_s=TIMEOUT_S)
    return spark.read.parquet(sink)


# ---------------------------------------------------- merges with effects
SQL_EFFECTS = f"""
  WITH ranked AS (
    SELECT user_id, event_type, CASE WHEN ts < TIMESTAMP '{B.SPLIT}' THEN 0 ELSE 1 END AS batch,
           row_number() OVER (PARTITION BY user_id, ts < TIMESTAMP '{B.SPLIT}' ORDER BY ts DESC, event_id DESC) AS rn
    FROM events)
  SELECT r.user_id, CAST(r.batch AS BIGINT) AS batch, r.event_type AS effect, l.last
  FROM ranked r JOIN ({SQL_LAST}) l USING (user_id) WHERE r.rn = 1"""


@query("stream_effect", SQL_EFFECTS)
def stream_effect(spark, sf):
    """STM-8, UDF-3: per batch, reduce to the last row per user, publish the
    reduced rows (the effect) before merging them into the keyed table.
    All effects that were sent are returned, with their batch and the table's last value."""
    root = fresh_dir(spark, "stream_effect")
    path, effects = f"{root}/topic", f"{root}/effects"
    order = ["ts_us", "event_id"]
    table = KeyedTable(spark, f"{root}/table", "user_id")
    publish = relay.send(effects, "effects", lambda reduced: reduced.select(
        F.col("user_id").cast("string").alias("key"), codec.render("user_id", "last", *order).alias("value")))

    def start():
        s = parsed_events(spark, path).select("user_id", F.col("event_type").alias("last"), *order)
        handler = relay.merge_with_effect(table, relay.last_in_batch("user_id", order), publish, order=order)
        return micro.start(s.writeStream.foreachBatch(handler), f"{root}/ckpt", DRAIN)

    feed_and_drain(halves(spark, sf),
                   lambda part: topics.write_topic(event_messages(part), path, "events", "value", "key"), start)
    sent = topics.as_text(topics.read_topic(spark, topics.batches(effects))).select(
        codec.parse("value", "user_id long, last string").alias("r"),
        F.regexp_extract(F.input_file_name(), "batch=([0-9]+)", 1).cast("long").alias("batch"))
    return sent.select("r.user_id", "batch", F.col("r.last").alias("effect")).join(table.read().select("user_id", "last"), "user_id", "left")


STAGE1_SCHEMA = "a long, seg array<int>, ts_us long, id long"
STAGE2_SCHEMA = "key long, value array<int>, ts_us long, id long"


@query("two_stage", """
  SELECT user_id AS key, CAST(k + 1 AS VARCHAR) AS segs FROM (
    SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn = 1""")
def two_stage(spark, sf):
    """STM-9, STM-3, SNK-3: topic1 → key by ``a`` → per-batch merge whose effect
    decorates the sets (+1) into topic2, an outbox → key → keyed table, last by the
    records' own order.  Both queries run at the same time under one predicate and one limit."""
    root = fresh_dir(spark, "two_stage")
    t1, t2 = f"{root}/topic1", f"{root}/topic2"
    ev = B.events(spark, sf)
    topics.write_topic(ev.select(codec.render(F.col("user_id").alias("a"), F.array(B.segment()).alias("seg"),
                                              F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
                                              F.col("event_id").alias("id")).alias("value")), t1, "topic1", "value")
    expected = ev.count()
    decorate = relay.send(t2, "topic2", lambda reduced: reduced.select(codec.render(
        F.col("a").alias("key"), sets.map_elements("seg", lambda x: x + 1).alias("value"), "ts_us", "id").alias("value")))

    def parsed(path, schema):
        return topics.as_text(topics.stream_topic(spark, path)).select(codec.parse("value", schema).alias("r")).select("r.*")

    order = ["ts_us", "id"]
    table1, table2 = KeyedTable(spark, f"{root}/table1", "a"), KeyedTable(spark, f"{root}/table2", "key")
    handler = relay.merge_with_effect(table1, relay.last_in_batch("a", order), decorate, order=order)
    with micro.RowsRead(spark) as rows:
        q1 = micro.start(parsed(t1, STAGE1_SCHEMA).writeStream.foreachBatch(handler), f"{root}/ckpt1")
        q2 = running.to_table(parsed(topics.batches(t2), STAGE2_SCHEMA), table2, f"{root}/ckpt2", mode="append", order=order)
        # what was relayed is what the outbox holds, once the first query is through
        micro.run_bounded([q1, q2], lambda: rows.of(q1) < expected
                          or rows.of(q2) < topics.read_topic(spark, topics.batches(t2)).count(), timeout_s=TIMEOUT_S)
    return table2.read().select("key", sets.to_text("value").alias("segs"))


@query("stream_enrich", SQL_SETS)
def stream_enrich(spark, sf):
    """STM-11: stored profiles (first half) enriched batch by batch with the
    segment sets streaming in (second half) — JOIN-5 inside foreachBatch."""
    root = fresh_dir(spark, "stream_enrich")
    table = KeyedTable(spark, f"{root}/table", "id")
    table.overwrite(B.stored_profiles(spark, sf).select("id", "segset"), version=0)
    path = f"{root}/topic"
    topics.write_topic(event_messages(B.second_half(spark, sf)), path, "events", "value", "key")
    s = parsed_events(spark, path).select(F.col("user_id").alias("id"), "k")
    micro.drain(micro.start(s.writeStream.foreachBatch(relay.enrich_into(table, "id", "k")), f"{root}/ckpt", DRAIN))
    return table.read().select("id", sets.to_text("segset").alias("segs"))


@query("stream_enrich_static", f"""
  SELECT e.event_id, e.user_id AS id,
         array_to_string(list_sort(list_distinct(list_concat(coalesce(s.segset, []), [e.k]))), ',') AS segs
  FROM (SELECT event_id, user_id, {B.SQL_K} AS k FROM events WHERE ts >= TIMESTAMP '{B.SPLIT}') e
  LEFT JOIN ({B.SQL_STORED}) s ON s.id = e.user_id""")
def stream_enrich_static(spark, sf):
    """STM-11: every streamed record (second half) enriched with the stored profile of its
    user (first half) by a stream-static join; no state, no ``foreachBatch``.  The stored
    table is bucketed by id, so batches are brought to it and it isn't shuffled."""
    root = fresh_dir(spark, "stream_enrich_static")
    path, sink = f"{root}/topic", f"{root}/sink"
    stored = bucketed.write(B.stored_profiles(spark, sf).select("id", "segset"), f"{root}/stored", "id")
    topics.write_topic(event_messages(B.second_half(spark, sf)), path, "events", "value", "key")
    s = parsed_events(spark, path).select("event_id", F.col("user_id").alias("id"), F.array("k").alias("segset"))
    out = relay.enrich_static(s, stored, "id").select("event_id", "id", sets.to_text("segset").alias("segs"))
    micro.drain(micro.start(out.writeStream.format("parquet").option("path", sink), f"{root}/ckpt", DRAIN))
    return spark.read.schema(out.schema).parquet(sink)


# ------------------------------------------------------------------ upserts
# The order log is loaded into the keyed table in these slices.
ORDER_SLICES = ["1997-01-01", "1999-01-01"]


@query("upsert_pairs", """
  SELECT o_custkey AS id, o_orderstatus AS status FROM (
    SELECT o_custkey, o_orderstatus,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) WHERE rn = 1""")
def upsert_pairs(spark, sf):
    """SNK-1: customer → status of the latest order, loaded slice by slice
    (newest slice first, so the order-aware merge is exercised)."""
    root = fresh_dir(spark, "upsert_pairs")
    o = B.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"),
        "o_orderdate", "o_orderkey")
    d = F.col("o_orderdate")
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ORDER_SLICES)
    slices = [o.where(d >= hi), o.where((d >= lo) & (d < hi)), o.where(d < lo)]
    table = KeyedTable(spark, f"{root}/table", "id")
    for v, part in enumerate(slices, start=1):
        table.upsert(part, v, order=["o_orderdate", "o_orderkey"])
    return table.read().select("id", "status")


@query("upsert_scored", """
  WITH prof AS (
    SELECT c.c_custkey AS id, c.c_acctbal AS score, o.o_orderdate >= TIMESTAMP '1998-06-01' AS late,
           list_sort(list_distinct(list(o.o_orderpriority))) AS segset
    FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
    GROUP BY c.c_custkey, c.c_acctbal, o.o_orderdate >= TIMESTAMP '1998-06-01'),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY late DESC) AS rn FROM prof)
  SELECT id, score, array_to_string(segset, ',') AS segs FROM ranked WHERE rn = 1""")
def upsert_scored(spark, sf):
    """SNK-2: scored profiles (id, score, segset) upserted twice: the later
    orders' profile replaces the earlier one."""
    root = fresh_dir(spark, "upsert_scored")
    c = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"),
                                              F.col("c_acctbal").alias("score"))
    o = B.table(spark, sf, "orders")
    cut = F.lit("1998-06-01").cast("timestamp_ntz")

    def profiles(orders: DataFrame) -> DataFrame:
        segs = agg.set_per_key(orders.select(F.col("o_custkey").alias("id"), "o_orderpriority"),
                               "id", "o_orderpriority")
        return c.join(segs, "id").select("id", "score", "segset")

    table = KeyedTable(spark, f"{root}/table", "id")
    table.upsert(profiles(o.where(F.col("o_orderdate") < cut)), 1)
    table.upsert(profiles(o.where(F.col("o_orderdate") >= cut)), 2)
    return table.read().select("id", "score", sets.to_text("segset").alias("segs"))
