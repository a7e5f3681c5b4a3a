"""The reference's own test cases, on its fixture rows (see FIXTURES.md)."""

from pyspark.sql import functions as F

from segmint.functions import sets
from segmint.operators import aggregate as agg
from segmint.operators import lookup, project
from segmint.session import fresh_dir
from segmint.sources import tables
from segmint.sources.keyed import KeyedTable

SEG_SET = [("a1", ["s1", "s2"]), ("a2", ["s2", "s3"])]
SEG_SIMPLE = [("a1", "s1"), ("a2", "s1"), ("a3", "s1"), ("a4", "s1")]


def seg_set(spark):
    return tables.frame_from_rows(spark, SEG_SET, "id string, segset array<string>")


def as_dict(df, k, v):
    return agg.collect_map(df, k, v)


def test_tabfirst_set_of_a1(spark):
    r = project.first_value(seg_set(spark), "id", "a1", "segset").first()
    assert set(r["segset"]) == {"s1", "s2"}


def test_in_filter_a1_a2(spark):
    rows = project.in_filter(seg_set(spark), "id", ["a1", "a2"]).collect()
    assert {r["id"]: sorted(r["segset"]) for r in rows} == {"a1": ["s1", "s2"], "a2": ["s2", "s3"]}


def test_in_filter_empty_list_gives_no_rows(spark):
    assert project.in_filter(seg_set(spark), "id", []).count() == 0


def test_join_two_tables_rest_of_right_row(spark):
    seg = tables.frame_from_rows(spark, [("a1", "s1"), ("a2", "s1")], "id string, segset string")
    seg2 = tables.frame_from_rows(spark, [("a1", "s2"), ("a2", "s3")], "id string, segset string")
    j = lookup.join_tables(seg, seg2, "id")
    r = lookup.rekey_rest(j, "id")
    assert as_dict(r, "key", "value") == {"a1": ["s2"], "a2": ["s3"]}


def test_join_typed_seg2_to_seg(spark):
    from segmint.plans.batch import PROFILE_TEXT
    seg = tables.frame_from_rows(spark, [("a1", "s1"), ("a2", "s1")], "id string, segset string")
    seg2 = tables.frame_from_rows(spark, [("a1", "s2"), ("a2", "s3")], "id string, segset string")
    j = lookup.join_typed(seg2, seg, "id", PROFILE_TEXT)
    got = {r["id"]: (r["left"]["segset"], r["right"]["segset"]) for r in j.collect()}
    assert got == {"a1": ("s2", "s1"), "a2": ("s3", "s1")}


def test_join_with_list_of_keys(spark):
    seg = tables.frame_from_rows(spark, SEG_SIMPLE, "id string, segset string")
    keys = tables.frame_from_rows(spark, [("a1",), ("a2",)], "id string")
    r = lookup.lookup_keys(keys, seg, "id")
    r = lookup.rekey_rest(r.select("id", F.col("row").alias("right")), "id")
    assert as_dict(r, "key", "value") == {"a1": ["s1"], "a2": ["s1"]}


def test_key_list_repeats_and_missing(spark):
    seg = tables.frame_from_rows(spark, SEG_SIMPLE, "id string, segset string")
    keys = tables.frame_from_rows(spark, [("a1",), ("a1",), ("zz",)], "id string")
    rows = lookup.lookup_keys(keys, seg, "id").collect()
    assert [r["id"] for r in rows] == ["a1", "a1"]


def test_joinon_key_list_to_sets(spark):
    keys = tables.frame_from_rows(spark, [("a1",), ("a2",), ("a2",)], "id string")
    r = lookup.lookup_sets(keys, seg_set(spark), "id", "segset")
    assert as_dict(r, "id", "segset") == {"a1": ["s1", "s2"], "a2": ["s2", "s3"]}


def test_joinon_empty_key_list(spark):
    keys = tables.frame_from_rows(spark, [], "id string")
    assert lookup.lookup_sets(keys, seg_set(spark), "id", "segset").count() == 0


def test_joinonrdd_enrich_and_merge(spark):
    inc1 = tables.frame_from_rows(spark, [("a2", ["s1", "s3"]), ("a3", ["s1", "s3"])],
                                  "id string, segset array<string>")
    inc2 = tables.frame_from_rows(spark, [("a1", ["s3", "s4"])], "id string, segset array<string>")
    r1 = lookup.enrich_merge(inc1, seg_set(spark), "id", "segset")
    r2 = lookup.enrich_merge(inc2, seg_set(spark), "id", "segset")
    assert as_dict(r1, "id", "segset") == {"a2": ["s1", "s2", "s3"], "a3": ["s1", "s3"]}
    assert as_dict(r2, "id", "segset") == {"a1": ["s1", "s2", "s3", "s4"]}


def test_joinonrdd_empty_input(spark):
    inc = tables.frame_from_rows(spark, [], "id string, segset array<string>")
    assert lookup.enrich_merge(inc, seg_set(spark), "id", "segset").count() == 0


def test_joincolrdd_keeps_table_side(spark):
    inc = tables.frame_from_rows(spark, [("a2", ["s9"]), ("a3", ["s1"])],
                                 "id string, segset array<string>")
    r = lookup.join_keyed(inc, seg_set(spark), "id", "segset")
    assert as_dict(r, "id", "segset") == {"a2": ["s2", "s3"]}


def test_simple_set_get_write_pairs_and_read_back(spark):
    pairs = tables.frame_from_rows(spark, [(str(i), str(i + 4)) for i in range(4)],
                                   "id string, segset string")
    t = KeyedTable(spark, fresh_dir(spark, "t-pairs"), "id")
    t.upsert(pairs, 1)
    back = t.read()
    ids = {r["id"] for r in back.collect()}
    segs = {r["segset"] for r in back.collect()}
    assert len(ids & {"0", "1", "2", "3"}) == 4
    assert len(segs & {"4", "5", "6", "7"}) == 4
    # FN-4 on columns and on tables
    a = tables.frame_from_rows(spark, [(["0", "1", "2", "3"],)], "s array<string>")
    assert a.select(sets.overlap_size("s", F.array(*[F.lit(x) for x in "0123"]))).first()[0] == 4
    assert agg.overlap_count(back.select("id"), pairs.select("id")).first()["n"] == 4


def test_persist_score_then_point_read(spark):
    t = KeyedTable(spark, fresh_dir(spark, "t-score"), "id")
    t.overwrite(tables.frame_from_rows(spark, [("a1", None, ["s1", "s2"]), ("a2", None, ["s2", "s3"])],
                                       "id string, score double, segset array<string>"), 0)
    new = tables.frame_from_rows(spark, [("a1", 0.1, ["s1"]), ("a2", 0.2, ["s2"])],
                                 "id string, score double, segset array<string>")
    t.upsert(new, 1)
    got = project.point_profile(t.read(), "id", "a2", ["score", "segset"]).first()
    assert got["key"] == "a2" and got["value"]["score"] == 0.2 and got["value"]["segset"] == ["s2"]


def test_row_map_and_fields(spark):
    df = tables.frame_from_rows(spark, [("a1", "s1")], "id string, segset string")
    r = df.select(project.field(project.row_map(df), "segset").alias("v"),
                  project.field(project.row_map(df), "nope").alias("n")).first()
    assert r["v"] == "s1" and r["n"] is None


def test_map_values_and_increment(spark):
    pairs = project.key_by(tables.int_range(spark, 1, 10), "id", "id")
    inc = project.map_values(pairs, lambda v: project.increment(v))
    assert sorted(r["value"] for r in inc.collect()) == list(range(2, 11))


def test_pair_side_and_const(spark):
    pairs = project.key_by(seg_set(spark), "id")
    assert sorted(r["key"] for r in project.pair_side(pairs, "key").collect()) == ["a1", "a2"]
    c = project.with_constant(seg_set(spark), "c", "2")
    assert {r["c"] for r in c.collect()} == {"2"}


def test_frequencies_replicated_running_counts(spark):
    freq = tables.frame_from_rows(spark, [("a", 1), ("b", 2), ("c", 3), ("z", 0)],
                                  "value string, n int")
    msgs = tables.replicate_by_frequency(freq, "n", keep=["value"])
    counts = agg.count_by_value(msgs, "value")
    assert as_dict(counts, "value", "count") == {"a": 1, "b": 2, "c": 3}


def test_replicate_large_frequency_is_chunked(spark):
    freq = tables.frame_from_rows(spark, [("hot", 5000), ("cold", 3)], "value string, n int")
    out = tables.replicate_by_frequency(freq, "n", keep=["value"], chunk=16)
    assert as_dict(agg.count_by_value(out, "value"), "value", "count") == {"hot": 5000, "cold": 3}


def test_minto_set_union_per_key(spark):
    df = tables.frame_from_rows(spark, [(2, [1, 2]), (2, [2, 5]), (4, [3])], "a int, seg array<int>")
    r = agg.set_per_key(df, "a", "seg", value_is_set=True)
    assert as_dict(r, "a", "segset") == {2: [1, 2, 5], 4: [3]}


def test_mmerge_right_replaces(spark):
    old = tables.frame_from_rows(spark, [(1, "x"), (2, "y")], "k int, v string")
    new = tables.frame_from_rows(spark, [(2, "z"), (3, "w")], "k int, v string")
    assert as_dict(agg.merge_latest(old, new, "k"), "k", "v") == {1: "x", 2: "z", 3: "w"}


def test_decoratevals_increment_sets(spark):
    df = tables.frame_from_rows(spark, [(2, [1, 2]), (4, [3, 5])], "a int, seg array<int>")
    r = df.select("a", sets.map_elements("seg", lambda x: x + 1).alias("s"))
    assert as_dict(r, "a", "s") == {2: [2, 3], 4: [4, 6]}


def test_sets_null_is_empty(spark):
    df = tables.frame_from_rows(spark, [(None, ["b", "a", "b"])], "a array<string>, b array<string>")
    r = df.select(sets.as_set("a").alias("x"), sets.union("a", "b").alias("u")).first()
    assert r["x"] == [] and r["u"] == ["a", "b"]


def test_build_map_last_wins(spark):
    df = tables.frame_from_rows(spark, [(1, "t", 5, 1), (1, "t", 6, 2), (1, "u", 7, 0)],
                                "g int, key string, v int, ord int")
    m = agg.build_map(df, "g", "key", "v", ["ord"]).first()["entries"]
    assert m == {"t": 6, "u": 7}


def test_hot_key_holding_a_third_of_the_key_list(spark):
    """One key is a third of the probe rows: the result stays whole."""
    table = tables.frame_from_rows(spark, [(f"k{i}", f"s{i}") for i in range(50)],
                                   "id string, segset string")
    keys = tables.int_range(spark, 0, 3000, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit("k1"))
         .otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("id"))
    out = lookup.lookup_keys(keys, table, "id")
    counts = as_dict(agg.count_by_value(out, "id"), "id", "count")
    expect = as_dict(agg.count_by_value(keys, "id"), "id", "count")
    assert counts == expect and sum(counts.values()) == 3000


def test_collect_map_refuses_large_results(spark):
    import pytest
    with pytest.raises(ValueError):
        agg.collect_map(tables.int_range(spark, 0, 50).select("id", F.col("id").alias("v")), "id", "v",
                        max_rows=10)
