"""How the reference's profile model binds to the given tables.

* A profile id is an ``events.user_id``; its segments are the ``k`` values
  found in the events' ``props`` JSON; its score is the exact sum of
  ``value``.
* Queries over one profile table build it from the whole event log
  (``profiles``).
* Queries that bring *incoming* sets to *stored* profiles take the stored ones
  from the first half of the log (before ``SPLIT``) and the incoming ones from
  the second, so every event of the whole table is used exactly once.

All readers are lazy DataFrames; filters on ``ts`` reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as agg

# The month of the event log is split here.
SPLIT = "2024-01-16 00:00:00"

# SQL (DuckDB) spelling of the same bindings, used by the oracles.
SQL_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
#: Exact sum of a double column, by its shortest decimal text; rounded, as the
#: last step to a double is not the same in both engines.
SQL_SUM = "round(CAST(sum(CAST(CAST(value AS VARCHAR) AS DECIMAL(38,18))) AS DOUBLE), 6)"


def _sql_profiles(where: str) -> str:
    return f"""
  SELECT user_id AS id,
         list_sort(list_distinct(list({SQL_K}))) AS segset,
         {SQL_SUM} AS score
  FROM events {where} GROUP BY user_id"""


SQL_PROFILES = _sql_profiles("")
SQL_STORED = _sql_profiles(f"WHERE ts < TIMESTAMP '{SPLIT}'")
SQL_INCOMING = f"""
  SELECT user_id AS id, list_sort(list_distinct(list({SQL_K}))) AS segset
  FROM events WHERE ts >= TIMESTAMP '{SPLIT}' GROUP BY user_id"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def segment(props: str = "props") -> Column:
    """The segment id carried by an event."""
    return F.get_json_object(F.col(props), "$.k").cast("int")


def split_ts() -> Column:
    return F.lit(SPLIT).cast("timestamp_ntz")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def first_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("ts") < split_ts())


def second_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("ts") >= split_ts())


def _profiles(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("user_id").alias("id"), segment().alias("k"), *agg.exact_parts("value"))
    per = rows.groupBy("id", agg.BLOCK).agg(F.collect_set("k").alias("ks"), F.sum(agg.PART).alias(agg.PART))
    out = agg.totals(per, "id", "score", F.sort_array(F.array_distinct(F.flatten(F.collect_list("ks")))).alias("segset"))
    # the last step to a double is not the same in both engines
    return out.select("id", "segset", F.round("score", 6).alias("score"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, segset, score) from the whole log."""
    return _profiles(events(spark, sf_dir))


def stored_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, segset, score) from the first half of the log."""
    return _profiles(first_half(spark, sf_dir))


def incoming_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, segset) from the second half of the log."""
    return agg.set_per_key(
        second_half(spark, sf_dir).select(F.col("user_id").alias("id"), segment().alias("k")),
        "id", "k")
