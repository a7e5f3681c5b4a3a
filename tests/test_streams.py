"""Streaming cases of the reference (running counts, keyed records, two
queues) plus the guarantees our sinks add: replay idempotence, order-aware
merges, effects that see the batch before the merge, bounded runs."""

import pytest
from pyspark.sql import functions as F

from segmint.functions import codec, sets
from segmint.operators import aggregate as agg
from segmint.session import fresh_dir
from segmint.sources import tables, topics
from segmint.sources.keyed import KeyedTable
from segmint.streaming import micro, relay, running

DRAIN = micro.trigger(available_now=True)


def drain(q):
    q.awaitTermination()
    assert q.exception() is None


def as_dict(df, k, v):
    return agg.collect_map(df, k, v)


def test_defaulttest_running_counts(spark):
    root = fresh_dir(spark, "t-default")
    freq = tables.frame_from_rows(spark, [("a", 1), ("b", 2), ("c", 3)], "value string, n int")
    msgs = tables.replicate_by_frequency(freq, "n", keep=["value"])
    # two sends: the running count spans micro-batches
    topics.write_topic(msgs, f"{root}/topic", "test-topic", "value")
    topics.write_topic(msgs.where("value = 'c'"), f"{root}/topic", "test-topic", "value")
    s = topics.as_text(topics.stream_topic(spark, f"{root}/topic", 1))
    counts = running.running(s, "value", running.running_count())
    table = KeyedTable(spark, f"{root}/table", "value")
    drain(running.to_table(counts, table, f"{root}/ckpt", DRAIN))
    assert as_dict(table.read(), "value", "n") == {"a": 1, "b": 2, "c": 6}


def records_topic(spark, root, records):
    df = tables.frame_from_rows(spark, [(*r, i) for i, r in enumerate(records)], "a int, seg array<int>, v int")
    topics.write_topic(df.select(codec.render("a", "seg", "v").alias("value")),
                       f"{root}/topic1", "topic1", "value")  # null key, as in the reference
    return f"{root}/topic1"


def test_simple_records_keyed_and_merged(spark):
    root = fresh_dir(spark, "t-simple")
    path = records_topic(spark, root, [(2, [1, 2]), (4, [3, 5])])
    s = topics.as_text(topics.stream_topic(spark, path, 1))
    assert s.isStreaming
    recs = s.select(codec.parse("value", "a int, seg array<int>, v int").alias("r")).select("r.*")
    table = KeyedTable(spark, f"{root}/table", "a")
    drain(running.to_table(recs, table, f"{root}/ckpt", DRAIN, mode="append", order=["v"]))
    assert as_dict(table.read(), "a", "seg") == {2: [1, 2], 4: [3, 5]}


def test_two_queues(spark):
    root = fresh_dir(spark, "t-two")
    t1 = records_topic(spark, root, [(2, [1, 2]), (4, [3, 5])])
    t2 = f"{root}/topic2"

    decorate = relay.send(t2, "topic2", lambda reduced: reduced.select(codec.render(
        F.col("a").alias("key"), sets.map_elements("seg", lambda x: x + 1).alias("value"), "v").alias("value")))

    table1 = KeyedTable(spark, f"{root}/r1", "a")
    s1 = topics.as_text(topics.stream_topic(spark, t1, 1)).select(
        codec.parse("value", "a int, seg array<int>, v int").alias("r")).select("r.*")
    drain(micro.start(s1.writeStream.foreachBatch(
        relay.merge_with_effect(table1, relay.last_in_batch("a", ["v"]), decorate)),
        f"{root}/c1", DRAIN))
    table2 = KeyedTable(spark, f"{root}/r2", "key")
    s2 = topics.as_text(topics.stream_topic(spark, topics.batches(t2), 1)).select(
        codec.parse("value", "key int, value array<int>, v int").alias("r")).select("r.*")
    drain(running.to_table(s2, table2, f"{root}/c2", DRAIN, mode="append", order=["v"]))
    assert as_dict(table1.read(), "a", "seg") == {2: [1, 2], 4: [3, 5]}
    assert as_dict(table2.read(), "key", "value") == {2: [2, 3], 4: [4, 6]}


def test_effect_sees_batch_before_merge(spark):
    root = fresh_dir(spark, "t-effect")
    table = KeyedTable(spark, f"{root}/table", "k")
    table.overwrite(tables.frame_from_rows(spark, [(1, "old"), (2, "keep")], "k int, v string"), 0)
    seen = []

    def effect(reduced, batch_id):
        seen.append((sorted(tuple(r) for r in reduced.collect()),
                     sorted(tuple(r) for r in table.read().collect())))

    batch = tables.frame_from_rows(spark, [(1, "new")], "k int, v string")
    relay.merge_with_effect(table, lambda d: d, effect)(batch, 0)
    assert seen == [([(1, "new")], [(1, "old"), (2, "keep")])]
    assert as_dict(table.read(), "k", "v") == {1: "new", 2: "keep"}


def test_upsert_replay_is_idempotent(spark):
    t = KeyedTable(spark, fresh_dir(spark, "t-replay"), "k")
    t.overwrite(tables.frame_from_rows(spark, [(1, "a"), (2, "b")], "k int, v string"), 0)
    new = tables.frame_from_rows(spark, [(2, "c"), (3, "d")], "k int, v string")
    t.upsert(new, 1)
    first = sorted(tuple(r) for r in t.read().collect())
    t.upsert(new, 1)  # the same micro-batch again
    assert sorted(tuple(r) for r in t.read().collect()) == first == [(1, "a"), (2, "c"), (3, "d")]
    assert t.versions() == [0, 1]


def test_upsert_with_order_keeps_newer_row(spark):
    t = KeyedTable(spark, fresh_dir(spark, "t-order"), "k")
    t.upsert(tables.frame_from_rows(spark, [(1, "late", 9), (2, "x", 1)], "k int, v string, ts int"),
             1, order=["ts"])
    t.upsert(tables.frame_from_rows(spark, [(1, "early", 3), (2, "y", 2), (2, "z", 5)],
                                    "k int, v string, ts int"), 2, order=["ts"])
    assert as_dict(t.read(), "k", "v") == {1: "late", 2: "z"}


def test_enrich_into_batches(spark):
    root = fresh_dir(spark, "t-enrich")
    table = KeyedTable(spark, f"{root}/table", "id")
    table.overwrite(tables.frame_from_rows(spark, [("a1", ["s1", "s2"]), ("a2", ["s2", "s3"])],
                                           "id string, segset array<string>"), 0)
    h = relay.enrich_into(table, "id", "k")
    h(tables.frame_from_rows(spark, [("a2", "s1"), ("a3", "s1"), ("a3", "s3")], "id string, k string"), 0)
    h(tables.frame_from_rows(spark, [("a1", "s3"), ("a1", "s4")], "id string, k string"), 1)
    h(tables.frame_from_rows(spark, [], "id string, k string"), 2)
    assert as_dict(table.read(), "id", "segset") == {
        "a1": ["s1", "s2", "s3", "s4"], "a2": ["s1", "s2", "s3"], "a3": ["s1", "s3"]}


def live(spark, root, name="t"):
    topics.write_topic(tables.frame_from_rows(spark, [("x",)], "value string"), f"{root}/{name}", name, "value")
    s = topics.stream_topic(spark, f"{root}/{name}", 1)
    return micro.start(s.writeStream.format("parquet").option("path", f"{root}/{name}-sink"), f"{root}/{name}-ckpt", micro.trigger(200))


def test_run_bounded_raises_on_failure(spark):
    root = fresh_dir(spark, "t-fail")
    topics.write_topic(tables.frame_from_rows(spark, [("x",)], "value string"),
                       f"{root}/topic", "t", "value")
    s = topics.stream_topic(spark, f"{root}/topic", 1)

    def boom(df, batch_id):
        raise RuntimeError("sink failed")

    q = micro.start(s.writeStream.foreachBatch(boom), f"{root}/ckpt", micro.trigger(200))
    with pytest.raises(Exception):
        micro.run_bounded(q, lambda: True, timeout_s=60)


def test_topic_files_follow_the_rows(spark):
    root = fresh_dir(spark, "t-files")
    df = tables.int_range(spark, 0, 100, 7).select(F.col("id").cast("string").alias("v"))
    topics.write_topic(df, f"{root}/t", "t", "v", key="v", rows_per_file=5)
    topics.write_topic(df, f"{root}/t", "t", "v", key="v")
    got = topics.as_text(topics.read_topic(spark, f"{root}/t"))
    assert sorted(r["value"] for r in got.collect()) == sorted(2 * [str(i) for i in range(100)])
    # every task writes its own rows: seven at the usual size, at most five rows a file before
    files = got.select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) == 7 * 3 + 7 and got.where("key <> value").count() == 0
    assert topics.message_counts(got).collect()[0]["n"] == 200


def test_parse_checked_routes_bad_rows(spark):
    df = tables.frame_from_rows(spark, [('{"a": 1}',), ("not json",)], "value string")
    out = codec.parse_checked(df, "value", "a int").orderBy("bad").collect()
    assert [r["bad"] for r in out] == [False, True] and out[0]["record"]["a"] == 1


def test_write_topics_in_one_pass(spark):
    root = fresh_dir(spark, "t-topics")
    df = tables.int_range(spark, 0, 90, 4).select(
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("t"),
        F.col("id").cast("string").alias("v"))
    topics.write_topics(df, root, "t", "v")
    topics.write_topics(df.where("t = 'x'"), root, "t", "v")
    assert topics.topic_names(spark, root) == ["x", "y"]
    from segmint.sources import fs
    assert len(fs.list_files(spark, topics.topic_path(root, "y"))) == 1  # four tasks, one file
    for t, n in (("x", 60), ("y", 60)):
        got = topics.read_topic(spark, topics.topic_path(root, t)).collect()
        assert len(got) == n and {r["topic"] for r in got} == {t}


KV = "k int, v string"


def rows(spark, *values, schema=KV):
    return tables.frame_from_rows(spark, values, schema)


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_repeated_keys_need_an_order(spark):
    t = KeyedTable(spark, fresh_dir(spark, "t-dups"), "k")
    with pytest.raises(ValueError, match="order"):
        t.upsert(rows(spark, (1, "a"), (1, "b")), 1)
    t.upsert(rows(spark, (1, "a"), (1, "b")), 1, order=["v"])
    assert content(t.read()) == [(1, "b")]


def test_kafka_source_needs_the_connector(spark):
    # no connector jar here: the failure is loud, not a silent empty stream
    with pytest.raises(Exception, match="(?i)kafka"):
        topics.stream_kafka(spark, ["t"], "localhost:1")


def test_enrich_into_keeps_other_columns(spark):
    table = KeyedTable(spark, fresh_dir(spark, "t-enrich-score"), "id")
    table.overwrite(tables.frame_from_rows(spark, [("a1", 0.5, ["s1"])],
                                           "id string, score double, segset array<string>"), 0)
    relay.enrich_into(table, "id", "k")(
        tables.frame_from_rows(spark, [("a1", "s2"), ("a9", "s1")], "id string, k string"), 0)
    got = {r["id"]: (r["score"], r["segset"]) for r in table.read().collect()}
    assert got == {"a1": (0.5, ["s1", "s2"]), "a9": (None, ["s1"])}


def test_null_is_a_key_like_others(spark):
    t = KeyedTable(spark, fresh_dir(spark, "t-null"), "k")
    schema = "k int, v string, ts int"
    t.overwrite(rows(spark, (None, "n0", 1), (1, "a", 1), (2, "b", 1), schema=schema), 0)
    t.upsert(rows(spark, (2, "b2", 5), (3, "c", 5), (None, "n1", 5), schema=schema), 1, order=["ts"])
    assert content(t.read()) == sorted([(1, "a", 1), (2, "b2", 5), (3, "c", 5), (None, "n1", 5)], key=repr)


def test_run_bounded_raises_on_timeout(spark):
    q = live(spark, fresh_dir(spark, "t-timeout"))
    with pytest.raises(TimeoutError):
        micro.run_bounded(q, lambda: True, timeout_s=2)
    assert not q.isActive


def test_enrich_static_stream(spark):
    root = fresh_dir(spark, "t-static")
    recs = tables.frame_from_rows(spark, [("a2", ["s1", "s3"]), ("a3", ["s1", "s3"])],
                                  "id string, segset array<string>")
    topics.write_topic(recs.select(codec.render("id", "segset").alias("value")),
                       f"{root}/topic", "t", "value")
    s = topics.as_text(topics.stream_topic(spark, f"{root}/topic")).select(
        codec.parse("value", "id string, segset array<string>").alias("r")).select("r.*")
    stored = tables.frame_from_rows(spark, [("a1", ["s1", "s2"]), ("a2", ["s2", "s3"])],
                                    "id string, segset array<string>")
    out = relay.enrich_static(s, stored, "id")
    assert out.isStreaming
    drain(micro.start(out.writeStream.format("parquet").option("path", f"{root}/sink"),
                      f"{root}/ckpt", DRAIN))
    got = {r["id"]: r["segset"] for r in spark.read.parquet(f"{root}/sink").collect()}
    assert got == {"a2": ["s1", "s2", "s3"], "a3": ["s1", "s3"]}


# ------------------------------------------------------- buckets that grow
def buckets_of(t):
    return t.commit_of(t.latest())["buckets"]


def ids(spark, lo, hi, v="old"):
    return tables.int_range(spark, lo, hi).select(F.col("id").cast("int").alias("k"), F.lit(v).alias("v"))


def test_buckets_and_write_tasks_grow_with_the_table(spark):
    from segmint.sources import fs
    t = KeyedTable(spark, fresh_dir(spark, "t-grow"), "k", bucket_bytes=4000)
    t.upsert(rows(spark, (1, "a"), (None, "n")), 1)
    assert len(buckets_of(t)) == 1
    written = []
    for version, hi in ((2, 2000), (3, 8000), (4, 24000)):
        t.upsert(ids(spark, 0, hi, f"v{version}"), version)
        files = [fs.list_files(spark, f"{t.root}/v{version}/{d}") for d in fs.list_dirs(spark, f"{t.root}/v{version}")]
        written.append(len(files))
        assert all(len([f for f in names if f.startswith("part")]) == 1 for names in files)  # one task a bucket
    assert written[0] < written[1] < written[2] == len(buckets_of(t)) and written[2] >= 8
    assert max(b[3] for b in buckets_of(t)) <= 3 * 4000
    got = t.read()
    assert got.count() == 24001 and got.where("k is null").first()["v"] == "n" and got.where("v = 'v4'").count() == 24000


def test_upsert_splits_and_rewrites_only_touched_buckets(spark):
    t = KeyedTable(spark, fresh_dir(spark, "t-buckets"), "k", bucket_bytes=2000)
    t.overwrite(ids(spark, 0, 4000), 0)
    before = buckets_of(t)
    assert len(before) >= 8
    t.upsert(rows(spark, (7, "new")), 1)
    after = buckets_of(t)
    assert sum(b[2] == 1 for b in after) == 1 and [b for b in after if b[2] == 0] == [b for b in before if b[:2] in [x[:2] for x in after if x[2] == 0]]
    # one bucket grows: it alone is split, so buckets of two widths live side by side
    n, b = next(x[:2] for x in after if x[2] == 1)
    h = F.pmod(F.xxhash64("k"), F.lit(n))
    many = ids(spark, 10**6, 10**6 + 60_000, "more").where(h == b)
    t.upsert(many, 2)
    assert {x[0] for x in buckets_of(t)} > {n} and sum(x[2] == 2 for x in buckets_of(t)) > 1
    t.upsert(rows(spark, (8, "late"), (10**6, "x")), 3)
    got = as_dict(t.read().where("k < 100"), "k", "v")
    assert got[7] == "new" and got[8] == "late" and got[9] == "old" and t.read().count() == 4000 + many.count() + (1 if many.where("k = 1000000").isEmpty() else 0)
    assert content(t.lookup(7, 8, 10**9)) == [(7, "new"), (8, "late")]
    assert len(t.lookup(7).inputFiles()) < len(t.read().inputFiles())


def test_upsert_of_nothing_keeps_the_table(spark):
    t = KeyedTable(spark, fresh_dir(spark, "t-nothing"), "k")
    t.overwrite(ids(spark, 0, 5), 0)
    t.upsert(ids(spark, 0, 0), 1)
    assert t.read().count() == 5 and t.latest() == 1
    empty = KeyedTable(spark, fresh_dir(spark, "t-empty"), "k")
    empty.upsert(ids(spark, 0, 0), 1)
    assert empty.read().count() == 0 and empty.read().columns == ["k", "v"]


def test_vacuum_by_age_keeps_named_buckets(spark):
    t = KeyedTable(spark, fresh_dir(spark, "t-vacuum"), "k", bucket_bytes=300)
    for v in range(1, 6):
        t.upsert(rows(spark, (v % 3, f"v{v}"), (10 + v, "x")), v)
    want = content(t.read())
    t.vacuum(older_than_s=3600)
    assert t.versions() == [1, 2, 3, 4, 5]
    t.vacuum(older_than_s=-5)
    assert t.versions() == [4, 5] and content(t.read()) == want and t.read(4).count() == 3 + 4
    t.upsert(rows(spark, (0, "again")), 5)  # replay of 5
    assert as_dict(t.read(), "k", "v")[0] == "again"


def test_writes_below_the_newest_are_refused(spark):
    from segmint.sources.keyed import StaleVersion
    t = KeyedTable(spark, fresh_dir(spark, "t-stale"), "k")
    t.upsert(rows(spark, (1, "a")), 5)
    t.upsert(rows(spark, (2, "b")), 6)
    for write in (t.upsert, t.overwrite):
        with pytest.raises(StaleVersion):
            write(rows(spark, (3, "z")), 1)


def test_crash_at_a_commit_loses_nothing(spark, monkeypatch):
    from segmint.sources import keyed
    t = KeyedTable(spark, fresh_dir(spark, "t-crash"), "k", bucket_bytes=300)
    t.upsert(rows(spark, (1, "a"), (2, "b")), 1)

    def crash(*a, **k):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(keyed.fs, "write_text", crash)
        with pytest.raises(RuntimeError):
            t.upsert(rows(spark, (2, "c"), (3, "d")), 2)
    assert content(t.read()) == [(1, "a"), (2, "b")]
    t.upsert(rows(spark, (2, "c"), (3, "d")), 2)
    with monkeypatch.context() as m:  # a replay that crashes before its text takes the old one's place
        m.setattr(keyed.fs, "rename", crash)
        with pytest.raises(RuntimeError):
            t.upsert(rows(spark, (2, "c"), (3, "d")), 2)
    assert t.versions() == [1, 2] and content(t.read()) == [(1, "a"), (2, "c"), (3, "d")]


# ------------------------------------------------------- state that is read
def test_running_union_of_sets(spark):
    root = fresh_dir(spark, "t-sets")
    for part in ([(2, [1, 2]), (4, [])], [(2, [2, 5])]):
        df = tables.frame_from_rows(spark, part, "a int, seg array<int>")
        topics.write_topic(df.select(codec.render("a", "seg").alias("value")), f"{root}/t", "t", "value")
    s = topics.as_text(topics.stream_topic(spark, f"{root}/t", 1)).select(
        codec.parse("value", "a int, seg array<int>").alias("r")).select("r.*")
    drain(running.keep(running.running_set(running.elements(s, "seg", "e"), "a", "e"), f"{root}/c", DRAIN))
    assert as_dict(running.set_state(spark, f"{root}/c", "a", "e"), "a", "segset") == {2: [1, 2, 5], 4: []}


def test_a_large_set_is_one_small_state_row_an_element(spark):
    """A batch emits its new pairs only; no state row holds a set."""
    root = fresh_dir(spark, "t-large")
    for lo, hi in ((0, 20_000), (19_990, 20_010)):
        tables.int_range(spark, lo, hi, 2).select(F.lit("hot").alias("k"), F.col("id").alias("e")).write.mode("append").parquet(f"{root}/t")
        out = running.running_set(spark.readStream.schema("k string, e long").parquet(f"{root}/t"), "k", "e")
        drain(micro.start(out.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/c", DRAIN))
    assert spark.read.parquet(f"{root}/out").count() == 20_010  # the second batch: ten
    state = running.state(spark, f"{root}/c")
    assert state.columns == ["k", "e"] and state.count() == 20_010
    assert running.set_state(spark, f"{root}/c", "k", "e").selectExpr("size(segset) n").collect() == [(20_010,)]


def test_running_state_follows_the_stream_over_restarts(spark):
    root = fresh_dir(spark, "t-state")
    for part in (["a", "b", "b"], ["b", "c", None]):
        topics.write_topic(tables.frame_from_rows(spark, [(v,) for v in part], "value string"), f"{root}/topic", "t", "value")
        s = topics.as_text(topics.stream_topic(spark, f"{root}/topic", 1))
        drain(running.keep(running.running(s, "value", running.running_count()), f"{root}/ckpt", DRAIN))
    assert as_dict(running.state(spark, f"{root}/ckpt", n=running.count_state()), "value", "n") == {"a": 1, "b": 3, "c": 1, None: 1}


def test_running_sums_keep_every_digit_and_a_hot_key(spark):
    root = fresh_dir(spark, "t-sums")
    parts = ([("hot", 0.1, 10**15)] * 1000 + [("b", 1e300, 1), ("n", float("nan"), 1)], [("b", 1e-300, 2), ("b", -1e300, 3), ("n", 1.0, 1), ("z", None, None)])
    for part in parts:
        tables.frame_from_rows(spark, part, "k string, d double, n long").write.mode("append").parquet(f"{root}/t")
        s = spark.readStream.schema("k string, d double, n long").parquet(f"{root}/t")
        drain(running.keep(running.running_sum(s, "k", "d", running.running_count()), f"{root}/cd", DRAIN))
        drain(running.keep(running.running_sum(s, "k", "n"), f"{root}/cn", DRAIN))
    d = {r["k"]: (r["total"], r["rows"]) for r in running.sum_state(spark, f"{root}/cd", "k", count="rows").collect()}
    assert d["hot"] == (100.0, 1000) and d["b"] == (1e-300, 3) and d["n"][0] != d["n"][0] and d["z"] == (None, 1)
    assert as_dict(running.sum_state(spark, f"{root}/cn", "k", "long"), "k", "total") == {"hot": 10**18, "b": 6, "n": 2, "z": None}


# ------------------------------------------------------- bounded runs
def test_run_bounded_counts_150_batches(spark):
    """More batches than a query's progress list keeps."""
    root = fresh_dir(spark, "t-150")
    tables.int_range(spark, 0, 450, 150).write.option("maxRecordsPerFile", 3).parquet(f"{root}/t")
    s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{root}/t")
    with micro.RowsRead(spark) as seen:
        q = micro.start(s.writeStream.format("noop"), f"{root}/c", micro.trigger(0))
        micro.run_bounded(q, lambda: seen.of(q) < 450, timeout_s=240)
        assert q.lastProgress["batchId"] >= 149 and seen.of(q) == 450
    assert sum(p["numInputRows"] for p in q.recentProgress) < 450


def test_a_replayed_batch_counts_once(spark):
    root = fresh_dir(spark, "t-replayed")
    tables.int_range(spark, 0, 40, 4).write.parquet(f"{root}/t")
    s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{root}/t")
    failed = []

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/out/b={batch_id}")
        if batch_id == 2 and not failed:
            failed.append(batch_id)
            raise RuntimeError("after the batch, before its commit")

    with micro.RowsRead(spark) as seen:
        q = micro.start(s.writeStream.foreachBatch(sink), f"{root}/c", DRAIN)
        with pytest.raises(Exception):
            micro.drain(q)
        q = micro.start(s.writeStream.foreachBatch(sink), f"{root}/c", micro.trigger(100))
        micro.run_bounded(q, lambda: seen.of(q) < 40, timeout_s=60)
        assert seen.of(q) == 40
    assert failed == [2] and spark.read.parquet(f"{root}/out").count() == 40
    counter = micro.RowsRead(spark)
    for batch, n in ((0, 5), (1, 7), (1, 7), (1, 0), (2, 1), (1, 99)):
        counter.add("q", batch, n)
    assert counter.of(type("Q", (), {"id": "q"})) == 13


def test_run_bounded_governs_several_queries(spark):
    root = fresh_dir(spark, "t-several")
    with micro.RowsRead(spark) as seen:
        qs = [live(spark, root, n) for n in ("a", "b")]
        micro.run_bounded(qs, lambda: any(seen.of(q) < 1 for q in qs), timeout_s=120)
    assert not any(q.isActive for q in qs)
    assert [spark.read.parquet(f"{root}/{n}-sink").count() for n in ("a", "b")] == [1, 1]


# ------------------------------------------------------- effects sent once
def test_crash_between_effect_and_merge_changes_nothing(spark, monkeypatch):
    root = fresh_dir(spark, "t-outbox")
    table = KeyedTable(spark, f"{root}/table", "k")
    tables.frame_from_rows(spark, [(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, ts int").write.parquet(f"{root}/in")
    sent = relay.send(f"{root}/out", "t", lambda d: d.select(F.col("k").cast("string").alias("key"), F.concat_ws("=", "k", "v").alias("value")))
    handler = relay.merge_with_effect(table, relay.last_in_batch("k", ["ts"]), sent, order=["ts"])

    def start():
        s = spark.readStream.schema("k int, v string, ts int").parquet(f"{root}/in")
        return micro.start(s.writeStream.foreachBatch(handler), f"{root}/c", DRAIN)

    def consumer():
        s = topics.as_text(topics.stream_topic(spark, topics.batches(f"{root}/out")))
        drain(micro.start(s.writeStream.format("parquet").option("path", f"{root}/seen"), f"{root}/c2", DRAIN))

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "upsert", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(Exception):
            micro.drain(start())
    consumer()  # sees what was sent before the crash
    assert table.latest() is None
    micro.drain(start())
    consumer()
    for df in (topics.as_text(topics.read_topic(spark, topics.batches(f"{root}/out"))), spark.read.parquet(f"{root}/seen")):
        assert sorted(tuple(r) for r in df.select("key", "value").collect()) == [("1", "1=b"), ("2", "2=c")]
    assert content(table.read()) == [(1, "b", 2), (2, "c", 1)]


def test_a_batch_half_written_is_not_seen(spark, monkeypatch):
    from segmint.sources import fs
    root = fresh_dir(spark, "t-half")
    msgs = tables.frame_from_rows(spark, [("x",)], "value string")
    with monkeypatch.context() as m:
        m.setattr(fs, "rename", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            topics.write_batch(msgs, f"{root}/o", "t", "value", 0)
    topics.write_batch(msgs, f"{root}/o", "t", "value", 1)
    assert topics.read_topic(spark, topics.batches(f"{root}/o")).count() == 1
    assert topics.write_batch(msgs, f"{root}/o", "t", "value", 0) and not topics.write_batch(msgs, f"{root}/o", "t", "value", 0)
    assert topics.read_topic(spark, topics.batches(f"{root}/o")).count() == 2
