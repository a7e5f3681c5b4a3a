"""Table sources (SRC-1 .. SRC-5).

A keyed table is a DataFrame read from a columnar file set; the format is a
parameter.  Reads are lazy, so filters and projections written after them are
pushed into the scan by Catalyst (``PushedFilters`` / ``ReadSchema``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | str | None = None, **options) -> DataFrame:
    """SRC-1: full scan of a table, all columns."""
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def read_pairs(spark: SparkSession, path: str, key: str, value: str,
               key_type: str = "string", value_type: str = "string",
               fmt: str = "parquet") -> DataFrame:
    """SRC-2: a table read as typed ``(key, value)`` pairs.

    Only the two named columns reach the scan's ``ReadSchema``.
    """
    df = read_table(spark, path, fmt)
    return df.select(F.col(key).cast(key_type).alias("key"),
                     F.col(value).cast(value_type).alias("value"))


def frame_from_rows(spark: SparkSession, rows: Iterable[Sequence],
                    schema: T.StructType | str) -> DataFrame:
    """SRC-3: in-memory rows or pairs to a DataFrame with a declared schema.

    Meant for driver-sized inputs (key lists, small dimensions); the caller
    knows their length.  Values are checked against the schema: one of a wrong
    type raises.
    """
    st = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame([tuple(r) for r in rows], st, verifySchema=True)


def int_range(spark: SparkSession, start: int, end: int,
              num_partitions: int | None = None) -> DataFrame:
    """SRC-4: integers ``start <= id < end``, generated on the executors."""
    return spark.range(start, end, 1, num_partitions)


def replicate_by_frequency(df: DataFrame, n: str | Column,
                           keep: Sequence[str] | None = None,
                           chunk: int = 1024) -> DataFrame:
    """SRC-5: emit each row (its ``keep`` columns) ``n`` times; ``n <= 0`` emits nothing.

    No row ever holds more than ``max(chunk, sqrt(n))`` array elements: a row of
    more than one chunk first becomes about ``n / width`` chunk rows, which are
    spread over tasks, and each chunk then expands to at most ``width`` copies.
    Rows of one chunk expand where they are.  ``array_repeat`` is used rather
    than ``sequence(1, n)`` because the latter yields two rows for ``n = 0``.
    """
    cnt = (F.col(n) if isinstance(n, str) else n).cast("long")
    cols = list(keep) if keep is not None else [c for c in df.columns if c != n]
    base = df.select(F.struct(*cols).alias("_row"), cnt.alias("_n"))
    width = F.greatest(F.lit(chunk).cast("long"), F.ceil(F.sqrt("_n")).cast("long"))
    chunks = F.when(F.col("_n") > 0, F.sequence(F.lit(0).cast("long"),
                                                F.floor((F.col("_n") - 1) / F.col("_w")).cast("long")))
    staged = (base.withColumn("_w", width)
                  .select("_row", "_n", "_w", F.explode(chunks).alias("_chunk")))
    copies = F.least(F.col("_w"), F.col("_n") - F.col("_chunk") * F.col("_w"))
    one = F.explode(F.array_repeat(F.col("_row"), copies.cast("int"))).alias("_row")
    many = staged.where(F.col("_n") > F.col("_w")).repartition(F.xxhash64("_row", "_chunk"))
    return staged.where(F.col("_n") <= F.col("_w")).select(one).unionByName(many.select(one)).select("_row.*")
