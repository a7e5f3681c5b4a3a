"""Plan shape: pushdown, pruning, and size-checked broadcasts."""

from pyspark.sql import functions as F

from segmint.operators import lookup, project
from segmint.plans import bindings as B
from segmint.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_point_filter_is_pushed(spark, sf_small):
    df = project.point_filter(B.table(spark, sf_small, "customer"), "c_custkey", 7)
    assert "EqualTo(c_custkey,7)" in plan(df)


def test_in_filter_is_pushed_and_pruned(spark, sf_small):
    df = project.project(project.in_filter(B.table(spark, sf_small, "customer"), "c_custkey", [1, 2]),
                         ["c_custkey"])
    p = plan(df)
    assert "In(c_custkey" in p and "ReadSchema: struct<c_custkey:bigint>" in p


def test_set_functions_stay_in_codegen(spark):
    from segmint.functions import sets
    df = tables.frame_from_rows(spark, [([3, 1],)], "a array<int>")
    p = plan(df.select(sets.union("a", F.array(F.lit(2))).alias("u")))
    assert "lambdafunction" not in p


def no_aqe(spark, f):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return f()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lookups_are_plain_joins(spark, sf_small):
    keys = B.table(spark, sf_small, "orders").select(F.col("o_custkey").alias("c_custkey"))
    p = no_aqe(spark, lambda: plan(lookup.lookup_keys(keys, B.table(spark, sf_small, "customer"), "c_custkey")))
    assert p.count("Join") == 1 and "Coalesce 1" not in p


def test_lookup_of_a_repeated_table_key_is_never_broadcast_by_hint(spark):
    table = tables.int_range(spark, 0, 50_000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    keys = tables.frame_from_rows(spark, [(1,)], "k int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = lookup.lookup_keys(keys, table, "k")
        assert "BroadcastHashJoin" not in plan(j) and j.count() == 50_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_struct_keys(spark):
    schema = "k struct<a:int,b:string>, s array<string>"
    inc = tables.frame_from_rows(spark, [((1, "x"), ["n"]), ((2, "y"), ["m"])], schema)
    st = tables.frame_from_rows(spark, [((1, "x"), ["o"])], schema)
    got = sorted((tuple(r["k"]), r["s"]) for r in lookup.enrich_merge(inc, st, "k", "s").collect())
    assert got == [((1, "x"), ["n", "o"]), ((2, "y"), ["m"])]


def test_no_single_task_above_a_scan_or_join(spark, sf_small, monkeypatch):
    """The upserts never squeeze their input into one task."""
    from pyspark.sql import DataFrame
    from segmint.plans import catalog
    monkeypatch.setattr(DataFrame, "coalesce", lambda *a: (_ for _ in ()).throw(AssertionError("coalesce")))
    type_ = type(spark.range(1))
    monkeypatch.setattr(type_, "coalesce", lambda *a: (_ for _ in ()).throw(AssertionError("coalesce")), raising=False)
    for name in ("upsert_pairs", "upsert_scored", "stream_enrich"):
        assert catalog.queries()[name](spark, sf_small).count() > 0


def test_rows_keep_their_values(spark):
    assert tables.frame_from_rows(spark, [(b"\x00\xff", None)], "b binary, n int").first()[:] == (bytearray(b"\x00\xff"), None)
    import pytest
    with pytest.raises(Exception):
        tables.frame_from_rows(spark, [("text",)], "n int").collect()


def test_shared_root_needs_a_folder_on_a_cluster():
    import pytest
    from segmint.session import shared_root

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_root(Session())


def bucketed_profiles(spark):
    from segmint.session import fresh_dir
    from segmint.sources import bucketed
    stored = tables.int_range(spark, 0, 3000, 6).select((F.col("id") % 1000).alias("id"), F.col("id").cast("string").alias("s"))
    stored = stored.groupBy("id").agg(F.collect_list("s").alias("segset"))
    path = fresh_dir(spark, "t-bucketed")
    return path, bucketed.write(stored, path, "id")


def exchanges_above(p: str, table: str) -> list[str]:
    """The exchanges on the way from the root of a plan's text to the scan of ``table``."""
    way, depth = [], []
    for line in p.splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        while depth and depth[-1] >= at:
            depth.pop(), way.pop()
        depth.append(at), way.append(line)
        if "FileScan" in line and table in line:
            return [x for x in way if "Exchange" in x]
    raise AssertionError(f"no scan of {table} in {p}")


def test_bucketed_table_is_joined_as_it_lies(spark):
    _, stored = bucketed_profiles(spark)
    incoming = tables.int_range(spark, 500, 1500, 5).select("id", F.array(F.lit("x")).alias("segset"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for j in (lookup.join_tables(stored, incoming, "id"), lookup.enrich_merge(incoming, stored, "id", "segset")):
            p = no_aqe(spark, lambda: plan(j))
            assert "SortMergeJoin" in p and p.count("Exchange hashpartitioning") == 1
            assert exchanges_above(p, "bucketed_") == []
        assert lookup.join_tables(stored, incoming, "id").count() == 500
        got = {r["id"]: r["segset"] for r in lookup.enrich_merge(incoming, stored, "id", "segset").collect()}
        assert len(got) == 1000 and got[700] == ["1700", "2700", "700", "x"] and got[1200] == ["x"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_bucketed_table_in_another_session(spark):
    from segmint.sources import bucketed
    path, stored = bucketed_profiles(spark)
    again = bucketed.read(spark, path, stored.schema, "id", bucketed.bucket_count(spark, 1))
    assert sorted(map(str, again.collect())) == sorted(map(str, stored.collect()))
    assert "Exchange" not in no_aqe(spark, lambda: plan(again.groupBy("id").count()))
    assert bucketed.bucket_count(spark, 100 << 40) == 1 << 19 and bucketed.bucket_count(spark, 0) == 4


def test_static_enrichment_has_no_state(spark):
    from segmint.session import fresh_dir
    from segmint.sources import topics
    from segmint.streaming import micro, relay
    root = fresh_dir(spark, "t-stateless")
    _, stored = bucketed_profiles(spark)
    tables.int_range(spark, 0, 50, 2).select(F.lit(None).cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value"),
                                             F.lit("t").alias("topic"), F.current_timestamp().alias("timestamp")).write.parquet(f"{root}/t")
    s = topics.as_text(topics.stream_topic(spark, f"{root}/t")).select(F.col("value").cast("long").alias("id"), F.array(F.lit("n")).alias("segset"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = micro.start(relay.enrich_static(s, stored, "id").writeStream.format("noop"), f"{root}/c", micro.trigger(available_now=True))
        micro.drain(q)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert q.lastProgress["stateOperators"] == [] and q.recentProgress[0]["numInputRows"] == 50
    p = q._jsq.explainInternal(False)
    assert "StateStore" not in p and exchanges_above(p[p.index("Physical Plan"):], "bucketed_") == []
