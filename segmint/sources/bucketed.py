"""Tables bucketed and sorted by key (JOIN-1, JOIN-5 at scale).

A table that many batches are joined with is dealt by its key once, when it is
written.  Joins, aggregations and windows on that key then read it as it lies: the
other side is brought to its buckets, and nothing above its scan is an exchange.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import fs

#: A bucket holds about so many bytes of Parquet.
BUCKET_BYTES = 256 << 20


def bucket_count(spark: SparkSession, size: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for ``size`` bytes: a power of two, and as many as a shuffle has
    partitions at least (with fewer, Spark would rather deal the table anew)."""
    n = 1
    while n < max(size / bucket_bytes, int(spark.conf.get("spark.sql.shuffle.partitions"))):
        n *= 2
    return n


def write(df: DataFrame, path: str, key: str | Sequence[str], bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` stored at ``path`` in buckets of ``key`` sorted by it, and read from there.

    It is written aside once to learn its bytes; then each bucket is one task's file."""
    spark, keys = df.sparkSession, [key] if isinstance(key, str) else list(key)
    aside = f"{path}-unordered"
    df.write.parquet(aside)
    n = bucket_count(spark, sum(fs.sizes(spark, aside).values()), bucket_bytes)
    name = _declare(spark, df.schema, path, keys, n)
    spark.read.schema(df.schema).parquet(aside).repartition(n, *keys).write.insertInto(name)
    fs.delete(spark, aside)
    return spark.table(name)


def read(spark: SparkSession, path: str, schema: T.StructType, key: str | Sequence[str], buckets: int) -> DataFrame:
    """A table that :func:`write` has stored in ``buckets``, in another session."""
    return spark.table(_declare(spark, schema, path, [key] if isinstance(key, str) else list(key), buckets))


def _declare(spark: SparkSession, schema: T.StructType, path: str, keys: Sequence[str], n: int) -> str:
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{path}'")
    return name
