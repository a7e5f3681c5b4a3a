"""Batch queries over the given tables, one per operator family, with the
equivalent DuckDB SQL.  Sets are emitted as sorted comma-joined text so that
results hash alike in both engines; sums are exact, then rounded to 6 places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec, sets
from ..operators import aggregate as agg
from ..operators import lookup, project
from ..session import fresh_dir
from ..sources import bucketed, tables
from . import bindings as B
from .bindings import SQL_INCOMING, SQL_K, SQL_PROFILES, SQL_STORED, SQL_SUM

Q = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def reg(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return reg


def _t(spark, sf, name):
    return B.table(spark, sf, name)


# The key used by the point-read operators (PRJ-1, PRJ-4, PRJ-8)
# and the key list of the IN filter (PRJ-2; 10**9 is absent on purpose).
POINT_KEY = 7
IN_KEYS = [1, 2, 3, 10**9]
# Order priority text → rank, an in-memory dimension (SRC-3).
PRIORITY_RANKS = [("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3),
                  ("4-NOT SPECIFIED", 4), ("5-LOW", 5)]
# Fixed value: the literal appended by the text builders (FN-11).
SUFFIX = " events seen"


# ---------------------------------------------------------------- sources
@query("scan_all", "SELECT * FROM customer")
def scan_all(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-1."""
    return tables.read_table(spark, f"{sf}/customer.parquet")


@query("scan_pair", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer")
def scan_pair(spark, sf):
    """SRC-2."""
    return tables.read_pairs(spark, f"{sf}/customer.parquet", "c_custkey", "c_name")


_VALUES = ", ".join(f"('{p}', {r})" for p, r in PRIORITY_RANKS)


@query("local_pairs", f"""
  SELECT d.rank, count(*) AS n_orders
  FROM orders o JOIN (VALUES {_VALUES}) AS d(priority, rank) ON o.o_orderpriority = d.priority
  GROUP BY d.rank""")
def local_pairs(spark, sf):
    """SRC-3: an in-memory dimension (size known on the driver, so it is
    broadcast without a check) joined to the whole orders table."""
    dim = tables.frame_from_rows(spark, PRIORITY_RANKS, "priority string, rank int")
    o = _t(spark, sf, "orders")
    return (o.join(F.broadcast(dim), o.o_orderpriority == dim.priority)
             .groupBy("rank").agg(F.count(F.lit(1)).alias("n_orders")))


@query("range_inc", """
  SELECT i + 1 AS n FROM (SELECT unnest(range(1, max(c_custkey) + 1)) AS i FROM customer)""")
def range_inc(spark, sf):
    """SRC-4 + PRJ-15: integers 1 .. max customer key, each incremented."""
    hi = _t(spark, sf, "customer").agg(F.max("c_custkey")).first()[0]
    return tables.int_range(spark, 1, int(hi) + 1).select(project.increment("id").alias("n"))


@query("replicate_by_freq", """
  SELECT p.p_partkey, p.p_name FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey""")
def replicate_by_freq(spark, sf):
    """SRC-5: every part name repeated by its frequency in lineitem
    (parts never ordered have frequency 0 and vanish)."""
    freq = _t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    p = _t(spark, sf, "part").select("p_partkey", "p_name")
    with_n = p.join(freq, p.p_partkey == freq.l_partkey, "left").select(
        "p_partkey", "p_name", F.coalesce("n", F.lit(0)).alias("n"))
    return tables.replicate_by_frequency(with_n, "n", keep=["p_partkey", "p_name"])


# ------------------------------------------------------ filters/projections
@query("point_filter", f"SELECT * FROM customer WHERE c_custkey = {POINT_KEY}")
def point_filter(spark, sf):
    """PRJ-1 (pushed as EqualTo)."""
    return project.point_filter(_t(spark, sf, "customer"), "c_custkey", POINT_KEY)


@query("in_filter", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN ({', '.join(map(str, IN_KEYS))})")
def in_filter(spark, sf):
    """PRJ-2 + PRJ-3 (pushed as In, ReadSchema narrowed)."""
    return project.project(project.in_filter(_t(spark, sf, "customer"), "c_custkey", IN_KEYS),
                           ["c_custkey", "c_name"])


@query("first_row", f"""
  SELECT array_to_string(segset, ',') AS segs FROM ({SQL_PROFILES}) WHERE id = {POINT_KEY}""")
def first_row(spark, sf):
    """PRJ-4: the set column of the first profile with the key."""
    st = B.profiles(spark, sf)
    return project.first_value(st, "id", POINT_KEY, "segset").select(
        sets.to_text("segset").alias("segs"))


@query("point_profile", f"""
  SELECT id AS key, score, array_to_string(segset, ',') AS segs
  FROM ({SQL_PROFILES}) WHERE id = {POINT_KEY}""")
def point_profile(spark, sf):
    """PRJ-5, PRJ-7, PRJ-8: point read keyed by id with (score, segset) as a sub-record."""
    st = B.profiles(spark, sf)
    p = project.point_profile(st, "id", POINT_KEY, ["score", "segset"])
    return p.select("key", F.col("value.score").alias("score"),
                    sets.to_text("value.segset").alias("segs"))


@query("row_map", """
  SELECT c_custkey, c_name AS name, c_mktsegment AS segment,
         CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def row_map(spark, sf):
    """PRJ-9: rows as name → value maps, fields looked up by name."""
    c = _t(spark, sf, "customer")
    m = c.select("c_custkey", project.row_map(c).alias("m"))
    return m.select("c_custkey", project.field("m", "c_name").alias("name"),
                    project.field("m", "c_mktsegment").alias("segment"),
                    project.field("m", "c_nationkey").alias("nation"))


@query("set_column", """
  SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_type, ' '))), ',') AS segs
  FROM part""")
def set_column(spark, sf):
    """PRJ-10: a row's list-valued column (the words of the part type)
    extracted as a plain set.  The list is bounded by the row, never built by
    collecting a group."""
    p = _t(spark, sf, "part")
    return p.select("p_partkey", sets.to_text(sets.as_set(F.split("p_type", " "))).alias("segs"))


@query("pair_side", "SELECT c_name AS value FROM customer")
def pair_side(spark, sf):
    """PRJ-11: the value side of a (key, value) pair frame."""
    pairs = project.key_by(_t(spark, sf, "customer"), "c_custkey", "c_name")
    return project.pair_side(pairs, "value")


@query("by_position", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS value FROM customer")
def by_position(spark, sf):
    """PRJ-12: columns 0 and 4 as (key, value) text."""
    return project.by_position(_t(spark, sf, "customer"), 0, 4)


@query("rest_columns", """
  SELECT p_partkey AS key,
         concat_ws('|', p_name, p_brand, p_type, CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)) AS value
  FROM part""")
def rest_columns(spark, sf):
    """PRJ-13: key → the rest of the row (as text, joined for output)."""
    r = project.rest_columns(_t(spark, sf, "part"), "p_partkey")
    return r.select("key", F.array_join("value", "|").alias("value"))


@query("const_column", "SELECT c_custkey, '2' AS c FROM customer")
def const_column(spark, sf):
    """PRJ-14."""
    return project.with_constant(_t(spark, sf, "customer").select("c_custkey"), "c", "2")


# ------------------------------------------------------------------ joins
SQL_JOIN_TABLES = f"""
  SELECT s.id, array_to_string(s.segset, ',') AS stored_segs,
         array_to_string(i.segset, ',') AS incoming_segs
  FROM ({SQL_STORED}) s JOIN ({SQL_INCOMING}) i ON s.id = i.id"""


@query("join_tables", SQL_JOIN_TABLES)
def join_tables(spark, sf):
    """JOIN-1: stored ⋈ incoming on id, both rows kept."""
    j = lookup.join_tables(B.stored_profiles(spark, sf), B.incoming_profiles(spark, sf), "id")
    return j.select("id", sets.to_text("left.segset").alias("stored_segs"),
                    sets.to_text("right.segset").alias("incoming_segs"))


PROFILE_TEXT = T.StructType([T.StructField("id", T.StringType()),
                             T.StructField("segset", T.StringType())])


@query("join_typed", """
  SELECT CAST(c.c_nationkey AS VARCHAR) AS id, c.c_mktsegment AS left_segset, n.n_name AS right_segset
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def join_typed(spark, sf):
    """JOIN-6: both sides read as the declared record (id string, segset string)."""
    left = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("id"),
                                            F.col("c_mktsegment").alias("segset"))
    right = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"),
                                           F.col("n_name").alias("segset"))
    j = lookup.join_typed(left, right, "id", PROFILE_TEXT)
    return j.select("id", F.col("left.segset").alias("left_segset"),
                    F.col("right.segset").alias("right_segset"))


@query("join_keys", """
  SELECT o.o_custkey AS c_custkey, c.c_name, c.c_mktsegment
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def join_keys(spark, sf):
    """JOIN-2: the order's customer keys (with repeats) looked up in customer."""
    keys = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    r = lookup.lookup_keys(keys, _t(spark, sf, "customer"), "c_custkey")
    return r.select("c_custkey", "row.c_name", "row.c_mktsegment")


@query("join_keys_set", f"""
  SELECT s.id, array_to_string(s.segset, ',') AS segs
  FROM ({SQL_PROFILES}) s WHERE s.id IN (SELECT c_custkey FROM customer)""")
def join_keys_set(spark, sf):
    """JOIN-3: every customer key → the set of its profile."""
    keys = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    r = lookup.lookup_sets(keys, B.profiles(spark, sf), "id", "segset")
    return r.select("id", sets.to_text("segset").alias("segs"))


@query("join_keyed", f"""
  SELECT s.id, array_to_string(s.segset, ',') AS segs
  FROM ({SQL_INCOMING}) i JOIN ({SQL_STORED}) s ON s.id = i.id""")
def join_keyed(spark, sf):
    """JOIN-4: incoming (id, set) rows looked up in stored; stored side kept."""
    r = lookup.join_keyed(B.incoming_profiles(spark, sf), B.stored_profiles(spark, sf),
                          "id", "segset")
    return r.select("id", sets.to_text("segset").alias("segs"))


SQL_ENRICH = f"""
  SELECT i.id,
         array_to_string(list_sort(list_distinct(list_concat(coalesce(s.segset, []), i.segset))), ',') AS segs
  FROM ({SQL_INCOMING}) i LEFT JOIN ({SQL_STORED}) s ON s.id = i.id"""


@query("enrich_merge", SQL_ENRICH)
def enrich_merge(spark, sf):
    """JOIN-5 (flagship): every incoming key, stored set ∪ incoming set."""
    r = lookup.enrich_merge(B.incoming_profiles(spark, sf), B.stored_profiles(spark, sf),
                            "id", "segset")
    return r.select("id", sets.to_text("segset").alias("segs"))


@query("join_bucketed", SQL_JOIN_TABLES)
def join_bucketed(spark, sf):
    """JOIN-1 against a stored table that lies in buckets of the key: only the other side moves."""
    stored = bucketed.write(B.stored_profiles(spark, sf).select("id", "segset"), fresh_dir(spark, "join_bucketed"), "id")
    j = lookup.join_tables(stored, B.incoming_profiles(spark, sf), "id")
    return j.select("id", sets.to_text("left.segset").alias("stored_segs"), sets.to_text("right.segset").alias("incoming_segs"))


@query("enrich_bucketed", SQL_ENRICH)
def enrich_bucketed(spark, sf):
    """JOIN-5 against a stored table that lies in buckets of the key."""
    stored = bucketed.write(B.stored_profiles(spark, sf).select("id", "segset"), fresh_dir(spark, "enrich_bucketed"), "id")
    r = lookup.enrich_merge(B.incoming_profiles(spark, sf), stored, "id", "segset")
    return r.select("id", sets.to_text("segset").alias("segs"))


@query("join_rekeyed", """
  SELECT c.c_custkey AS key, c.c_name || '|' || c.c_mktsegment AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def join_rekeyed(spark, sf):
    """JOIN-7: orders ⋈ customer re-keyed to the customer key → rest of its row."""
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    c = _t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    r = lookup.rekey_rest(lookup.join_tables(o, c, "c_custkey"), "c_custkey")
    return r.select(F.col("key"), F.array_join("value", "|").alias("value"))


# ------------------------------------------------------------ aggregates
@query("count_by_value", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_value(spark, sf):
    """AGG-1."""
    return agg.count_by_value(B.events(spark, sf), "event_type", "n")


@query("row_count", "SELECT count(*) AS n FROM events")
def row_count(spark, sf):
    """AGG-2."""
    return agg.row_count(B.events(spark, sf))


@query("sum_per_key", f"SELECT user_id, {SQL_SUM} AS total FROM events GROUP BY user_id")
def sum_per_key(spark, sf):
    """AGG-3: exact sum of event values per user."""
    return agg.sum_per_key(B.events(spark, sf), "user_id", "value").withColumn("total", F.round("total", 6))


SQL_LAST = """
  SELECT user_id, event_type AS last FROM (
    SELECT user_id, event_type,
           row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn = 1"""


@query("last_per_key", SQL_LAST)
def last_per_key(spark, sf):
    """AGG-4: the last event type per user by (ts, event_id)."""
    return agg.last_per_key(B.events(spark, sf), "user_id", "event_type", ["ts", "event_id"])


SQL_SETS = f"""
  SELECT user_id AS id, array_to_string(list_sort(list_distinct(list({SQL_K}))), ',') AS segs
  FROM events GROUP BY user_id"""


@query("set_per_key", SQL_SETS)
def set_per_key(spark, sf):
    """AGG-5."""
    e = B.events(spark, sf).select(F.col("user_id").alias("id"), B.segment().alias("k"))
    return agg.set_per_key(e, "id", "k").select("id", sets.to_text("segset").alias("segs"))


# ------------------------------------------------------------- functions
@query("set_union", f"""
  SELECT coalesce(s.id, i.id) AS id,
         array_to_string(list_sort(list_distinct(list_concat(coalesce(s.segset, []), coalesce(i.segset, [])))), ',') AS segs
  FROM ({SQL_STORED}) s FULL OUTER JOIN ({SQL_INCOMING}) i ON s.id = i.id""")
def set_union(spark, sf):
    """FN-1: union of the stored and incoming sets of every id."""
    s = B.stored_profiles(spark, sf).select("id", F.col("segset").alias("a"))
    i = B.incoming_profiles(spark, sf).select("id", F.col("segset").alias("b"))
    return s.join(i, "id", "full_outer").select(
        "id", sets.to_text(sets.union("a", "b")).alias("segs"))


@query("map_merge", f"""
  WITH ranked AS (
    SELECT user_id, event_type, ts >= TIMESTAMP '{B.SPLIT}' AS late,
           row_number() OVER (PARTITION BY user_id, ts >= TIMESTAMP '{B.SPLIT}'
                              ORDER BY ts DESC, event_id DESC) AS rn
    FROM events),
  o AS (SELECT user_id, event_type FROM ranked WHERE rn = 1 AND NOT late),
  n AS (SELECT user_id, event_type FROM ranked WHERE rn = 1 AND late)
  SELECT coalesce(n.user_id, o.user_id) AS user_id,
         CASE WHEN n.user_id IS NOT NULL THEN n.event_type ELSE o.event_type END AS last
  FROM o FULL OUTER JOIN n ON o.user_id = n.user_id""")
def map_merge(spark, sf):
    """FN-2: the old keyed map (last event type per user, first half) merged
    with the new one (second half); new wins."""
    old = agg.last_per_key(B.first_half(spark, sf), "user_id", "event_type", ["ts", "event_id"])
    new = agg.last_per_key(B.second_half(spark, sf), "user_id", "event_type", ["ts", "event_id"])
    return agg.merge_latest(old, new, "user_id")


@query("set_increment", f"""
  SELECT id, array_to_string(list_sort(list_distinct(list_transform(segset, lambda x: x + 1))), ',') AS segs
  FROM ({SQL_PROFILES})""")
def set_increment(spark, sf):
    """FN-3 / UDF-4: every element of each profile's set incremented."""
    p = B.profiles(spark, sf)
    return p.select("id", sets.to_text(sets.map_elements("segset", lambda x: x + 1)).alias("segs"))


@query("map_values", "SELECT c_custkey AS key, c_nationkey + 1 AS value FROM customer")
def map_values(spark, sf):
    """PRJ-6: the value of each (key, value) pair transformed, the key unchanged."""
    pairs = project.key_by(_t(spark, sf, "customer"), "c_custkey", "c_nationkey")
    return project.map_values(pairs, project.increment)


@query("set_per_key_union", f"""
  SELECT id, array_to_string(list_sort(list_distinct(flatten(list(segset)))), ',') AS segs
  FROM (SELECT id, segset FROM ({SQL_STORED}) UNION ALL SELECT id, segset FROM ({SQL_INCOMING})) GROUP BY id""")
def set_per_key_union(spark, sf):
    """AGG-5 over set-valued rows: the union of the stored and incoming sets per key."""
    both = B.stored_profiles(spark, sf).select("id", "segset").unionByName(B.incoming_profiles(spark, sf))
    r = agg.set_per_key(both, "id", "segset", value_is_set=True)
    return r.select("id", sets.to_text("segset").alias("segs"))


@query("set_overlap", f"""
  SELECT s.id, CAST(len(list_intersect(s.segset, i.segset)) AS BIGINT) AS overlap
  FROM ({SQL_STORED}) s JOIN ({SQL_INCOMING}) i ON s.id = i.id""")
def set_overlap(spark, sf):
    """FN-4: size of the intersection of the stored and incoming sets."""
    s = B.stored_profiles(spark, sf).select("id", F.col("segset").alias("a"))
    i = B.incoming_profiles(spark, sf).select("id", F.col("segset").alias("b"))
    return s.join(i, "id").select("id", sets.overlap_size("a", "b").alias("overlap"))


@query("table_overlap", f"""
  SELECT count(*) AS n FROM (
    SELECT user_id FROM events WHERE ts < TIMESTAMP '{B.SPLIT}'
    INTERSECT
    SELECT user_id FROM events WHERE ts >= TIMESTAMP '{B.SPLIT}')""")
def table_overlap(spark, sf):
    """FN-4 on tables: users active in both halves of the log."""
    return agg.overlap_count(B.first_half(spark, sf).select("user_id"),
                             B.second_half(spark, sf).select("user_id"))


@query("to_set", """
  SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ',') AS words
  FROM part""")
def to_set(spark, sf):
    """FN-5: a sequence with repeats (the words of a part name) to a set."""
    p = _t(spark, sf, "part")
    return p.select("p_partkey", sets.to_text(sets.as_set(F.split("p_name", " "))).alias("words"))


@query("build_map", f"""
  SELECT user_id, string_agg(event_type || ':' || CAST(k AS VARCHAR), ',' ORDER BY event_type) AS entries
  FROM (SELECT user_id, event_type, {SQL_K} AS k,
               row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
        FROM events) WHERE rn = 1 GROUP BY user_id""")
def build_map(spark, sf):
    """FN-6: per user one map event type → last segment seen with it."""
    e = B.events(spark, sf).withColumn("k", B.segment())
    m = agg.build_map(e, "user_id", "event_type", "k", ["ts", "event_id"])
    text = F.array_join(F.transform(F.map_entries("entries"),
                                    lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return m.select("user_id", text.alias("entries"))


@query("concat_text", f"SELECT event_id, CAST(event_id AS VARCHAR) || '{SUFFIX}' AS text FROM events")
def concat_text(spark, sf):
    """FN-11."""
    return B.events(spark, sf).select("event_id", codec.number_text("event_id", SUFFIX).alias("text"))


@query("codec_roundtrip", """
  SELECT event_id, user_id, event_type, value, octet_length(CAST(CAST(event_id AS VARCHAR) AS BLOB)) AS id_bytes
  FROM events""")
def codec_roundtrip(spark, sf):
    """FN-7..FN-10: records rendered to JSON and parsed back; text to bytes and back."""
    e = B.events(spark, sf)
    msg = e.select(codec.text_to_bytes(codec.render("event_id", "user_id", "event_type", "value")).alias("b"),
                   codec.text_to_bytes(F.col("event_id").cast("string")).alias("idb"))
    rec = msg.select(codec.parse(codec.bytes_to_text("b"),
                                 "event_id long, user_id long, event_type string, value double").alias("r"),
                     F.octet_length("idb").cast("bigint").alias("id_bytes"))
    return rec.select("r.*", "id_bytes")
