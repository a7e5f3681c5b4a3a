"""Topics: message logs with the Kafka source's message columns (SRC-6 .. SRC-10, SNK-3).

No Kafka connector is on this class path, so a topic is a directory of
Parquet files::

    key binary, value binary, topic string, timestamp timestamp

Publishing appends files, in parallel.  There are no offsets of our own: a
consumer that needs an order takes it from the records (their own version).
Streams read the directory with the file source, which (like
``startingOffsets = earliest`` plus a checkpoint) delivers every file once
across restarts.  With the connector present only ``format`` and the options
change; the transformations downstream stay the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fs

# Messages per topic file at most.
ROWS_PER_FILE = 1_000_000

TOPIC_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])


def topic_path(root: str, name: str) -> str:
    """Where :func:`write_topics` puts topic ``name`` under ``root``."""
    return f"{root.rstrip('/')}/t={name}"


def topic_names(spark: SparkSession, root: str) -> list[str]:
    """The topics that :func:`write_topics` has written under ``root``."""
    return [n[2:] for n in fs.list_dirs(spark, root) if n.startswith("t=")]


def _messages(df: DataFrame, value: str, key: str | None, timestamp: str | None, topic: Column) -> DataFrame:
    def data(name):
        if name is None:
            return F.lit(None).cast("binary")
        c = F.col(name)
        return c if isinstance(df.schema[name].dataType, T.BinaryType) else F.encode(c.cast("string"), "UTF-8")

    when = F.col(timestamp).cast("timestamp") if timestamp else F.current_timestamp()
    return df.select(data(key).alias("key"), data(value).alias("value"), topic.alias("topic"), when.alias("timestamp"))


def write_topic(df: DataFrame, path: str, topic: str, value: str, key: str | None = None,
                timestamp: str | None = None, rows_per_file: int = ROWS_PER_FILE) -> None:
    """SNK-3: append ``df`` as messages to the topic at ``path``, every task its own rows.

    ``value`` / ``key`` name text or binary columns (text is UTF-8 encoded).
    """
    _messages(df, value, key, timestamp, F.lit(topic)).write.mode("append").option(
        "maxRecordsPerFile", rows_per_file).parquet(path)


def write_topics(df: DataFrame, root: str, topic_col: str, value: str, key: str | None = None,
                 timestamp: str | None = None, rows_per_file: int = ROWS_PER_FILE) -> None:
    """SNK-3 routed: each row goes to the topic named by ``topic_col``, all in
    one pass; topic ``t`` lands in :func:`topic_path` ``(root, t)``.

    Rows are rebalanced by topic first: a small topic gets one file, not one of every
    task, and AQE splits a hot one into tasks of its advisory size."""
    out = _messages(df, value, key, timestamp, F.col(topic_col).cast("string"))
    out.withColumn("t", F.col("topic")).hint("rebalance", F.col("t")).write.mode("append").option(
        "maxRecordsPerFile", rows_per_file).partitionBy("t").parquet(root)


def write_batch(df: DataFrame, path: str, topic: str, value: str, batch_id: int, key: str | None = None,
                timestamp: str | None = None, rows_per_file: int = ROWS_PER_FILE) -> bool:
    """SNK-3 as an outbox (STM-8): the messages of one micro-batch, sent once.

    They are written aside and appear whole by one rename to ``batch=<id>``.  A replay
    finds that directory and sends nothing (the result says so): its rows are the same,
    and readers, streams among them, never see a message twice.  Read it with
    :func:`batches`."""
    spark, there = df.sparkSession, f"{path}/batch={batch_id}"
    if fs.exists(spark, there):
        return False
    _messages(df, value, key, timestamp, F.lit(topic)).write.mode("overwrite").option(
        "maxRecordsPerFile", rows_per_file).parquet(f"{path}/_writing-{batch_id}")
    fs.rename(spark, f"{path}/_writing-{batch_id}", there)
    return True


def batches(path: str) -> str:
    """The path under which :func:`read_topic` and :func:`stream_topic` see an outbox."""
    return f"{path}/batch=*"


def read_topic(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: a bounded (batch) read of a topic."""
    return spark.read.schema(TOPIC_SCHEMA).parquet(path)


def stream_topic(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC-6 / SRC-7 / SRC-9: a streaming read of a topic, earliest first.

    Key and value stay binary (SRC-7); :func:`as_text` gives the string form
    (SRC-6).  Progress is tracked by the query's checkpoint, which replaces
    the reference's consumer group and offset commits.  ``max_files_per_trigger``
    is the rate limit (like ``maxOffsetsPerTrigger``); ``None`` takes all new
    files in each batch.
    """
    fs.mkdirs(spark, path.split("/batch=")[0])
    r = spark.readStream.schema(TOPIC_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def stream_topics(spark: SparkSession, paths: Sequence[str],
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC-8: several topics as one stream; route on the ``topic`` column."""
    streams = [stream_topic(spark, p, max_files_per_trigger) for p in paths]
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def stream_kafka(spark: SparkSession, topics: Sequence[str], bootstrap: str,
                 starting: str = "earliest", max_offsets_per_trigger: int | None = None,
                 **options) -> DataFrame:
    """SRC-6..SRC-9 against a Kafka cluster (needs the connector jar).

    The frame has the same columns as :func:`stream_topic`, so everything
    downstream is unchanged; the query's checkpoint holds the offsets, which
    replaces consumer groups and offset commits.  Without the jar Spark raises
    ``Failed to find data source: kafka``.
    """
    r = (spark.readStream.format("kafka")
         .option("kafka.bootstrap.servers", bootstrap)
         .option("subscribe", ",".join(topics))
         .option("startingOffsets", starting))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return r.options(**options).load()


def write_kafka(df: DataFrame, topic: str, bootstrap: str, value: str,
                key: str | None = None, **options) -> None:
    """SNK-3 against a Kafka cluster (needs the connector jar); the broker
    assigns partitions and offsets."""
    cols = [F.col(value).alias("value")] + ([F.col(key).alias("key")] if key else [])
    (df.select(*cols).write.format("kafka")
       .option("kafka.bootstrap.servers", bootstrap).option("topic", topic)
       .options(**options).save())


def as_text(df: DataFrame) -> DataFrame:
    """SRC-6: key and value decoded as UTF-8 strings."""
    return df.withColumn("key", F.decode("key", "UTF-8")).withColumn("value", F.decode("value", "UTF-8"))


def message_counts(df: DataFrame) -> DataFrame:
    """SRC-10: messages per topic of a bounded read."""
    return df.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
