"""Sharding by global byte-size prefix sums: contiguous, balanced shards.

Rows are put in range partitions by key.  The totals of the partitions (one
small row each) give every partition its offset; a window inside the partition
gives every row its place.  Cutting the running byte count at equal targets
makes contiguous shards whose sizes differ by less than the largest rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, table

N_SHARDS = 16


def n_parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def prefixed(rows: DataFrame, key: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` in the global order of ``key`` with exclusive running sums.

    ``sums`` maps a new column to the summed long column; the result also has
    ``part`` (the range partition) and ``pos`` (the row's number, from 0).  Ties in the key
    keep one order: the row's first place in the input decides, which also lets
    a hot key spread over partitions.
    """
    tie = rows.withColumn("tie", F.monotonically_increasing_id())
    order = [*key, "tie"]
    # written once: the range borders come from a sample, so they must not be drawn again
    ranged = kept(tie.repartitionByRange(n_parts(rows), *order).withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"),
                                        *(F.sum(c).alias(f"s_{a}") for a, c in sums.items()))
    # one row a partition: their number is the setting above, not the data's size
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o_pos"),
                            *(F.coalesce(F.sum(f"s_{a}").over(before), F.lit(0)).alias(f"o_{a}") for a in sums))
    inside = Window.partitionBy("part").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", (F.row_number().over(inside) - 1).alias("pos"),
                          *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(a) for a, c in sums.items()))
    out = local.join(F.broadcast(offsets), "part")
    return out.select(*[c for c in ranged.columns if c != "tie"], (F.col("pos") + F.col("o_pos")).alias("pos"),
                      *((F.col(a) + F.col(f"o_{a}")).alias(a) for a in sums))


def shard(rows: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32, ...) and their ``shard`` and ``slot``.

    Order: doc_id (null first), then checksum and size.  A row goes to the
    shard in whose byte range its middle byte lies; slots count from 0 in each
    shard.  Repeated rows are rows of their own; an empty table gives no rows.
    """
    placed = prefixed(rows, ["doc_id", "text_crc32", "size"], {"before": "size"})
    total = rows.agg(F.sum("size").alias("total"))
    middle = (2 * F.col("before").cast("decimal(38,0)") + F.col("size")) * n_shards
    cut = placed.join(F.broadcast(total)).withColumn(
        "shard", F.least(F.lit(n_shards - 1), F.floor(middle / (2 * F.col("total"))).cast("int")))
    cut = kept(cut.drop("total"), "shards")
    first = cut.groupBy("shard").agg(F.min("pos").alias("first"))  # n_shards rows
    return cut.join(F.broadcast(first), "shard").withColumn("slot", F.col("pos") - F.col("first")).drop("first")


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1; null: none) and text_crc32: no text is moved."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", (F.octet_length(t) + F.lit(1)).cast("long").alias("size"),
                            F.crc32(t.cast("binary")).alias("text_crc32"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(kept(sized(table(spark, sf_dir, "documents")), "sizes"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
