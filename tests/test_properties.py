"""Set functions and per-key aggregates against plain Python semantics, on
generated inputs (all examples of a property go through one Spark job)."""

import math
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segmint.functions import sets
from segmint.operators import aggregate as agg
from segmint.sources import tables

small_sets = st.one_of(st.none(), st.lists(st.integers(-5, 20), max_size=8))
pairs = st.lists(st.tuples(small_sets, small_sets), min_size=1, max_size=30)


def norm(xs):
    return sorted(set(xs or []))


@settings(max_examples=15, deadline=None)
@given(pairs)
def test_set_functions_match_python(spark, rows):
    df = tables.frame_from_rows(spark, [(i, a, b) for i, (a, b) in enumerate(rows)],
                                "i int, a array<int>, b array<int>")
    out = df.select("i", sets.as_set("a").alias("s"), sets.union("a", "b").alias("u"),
                    sets.overlap_size("a", "b").alias("o"),
                    sets.map_elements(F.coalesce("a", F.array().cast("array<int>")),
                                      lambda x: x * 2 + 1).alias("m"),
                    sets.to_text(sets.as_set("a")).alias("t")).collect()
    for r in out:
        a, b = rows[r["i"]]
        assert r["s"] == norm(a)
        assert r["u"] == norm((a or []) + (b or []))
        assert r["o"] == len(set(a or []) & set(b or []))
        assert r["m"] == norm(x * 2 + 1 for x in (a or []))
        assert r["t"] == ",".join(map(str, norm(a)))


keyed = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9), st.integers(0, 1000)),
                 min_size=1, max_size=60, unique_by=lambda t: t[2])


@settings(max_examples=15, deadline=None)
@given(keyed)
def test_per_key_aggregates_match_python(spark, rows):
    df = tables.frame_from_rows(spark, rows, "k int, v int, ts int")
    sets_ = agg.collect_map(agg.set_per_key(df, "k", "v"), "k", "segset")
    last = agg.collect_map(agg.last_per_key(df, "k", "v", ["ts"]), "k", "last")
    sums = agg.collect_map(agg.sum_per_key(df, "k", "v"), "k", "total")
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        assert sets_[k] == norm(r[1] for r in mine)
        assert last[k] == max(mine, key=lambda r: r[2])[1]
        assert sums[k] == sum(r[1] for r in mine)


doubles = st.one_of(st.floats(), st.sampled_from([0.0, -0.0, 5e-324, -5e-324, 1e-300, 1e300, -1e300, 4e-19, 1e21, 0.1, 2.0**-1022, 1.7976931348623157e308]),
                    st.builds(math.ldexp, st.sampled_from([1.0, -1.0, 1.5]), st.integers(-1074, 1022)), st.none())


def true_sum(values):
    """``math.fsum``, with infinities where the total is beyond the range, and by arithmetic for values without digits."""
    values = [v for v in values if v is not None]
    special = [v for v in values if not math.isfinite(v)]
    if special or not values:
        return sum(special) if values else None
    try:
        return math.fsum(values)
    except OverflowError:  # fsum also gives up on a partial sum
        total = sum(map(Fraction, values))
        try:
            return float(total)
        except OverflowError:
            return math.inf if total > 0 else -math.inf


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(doubles, min_size=1, max_size=12), min_size=1, max_size=12))
def test_sums_of_doubles_are_exact(spark, keys):
    rows = [(k, v) for k, values in enumerate(keys) for v in values]
    got = agg.collect_map(agg.sum_per_key(tables.frame_from_rows(spark, rows, "k int, v double"), "k", "v"), "k", "total")
    for k, values in enumerate(keys):
        want = true_sum(values)
        assert got[k] == want or (want != want and got[k] != got[k]), (values, want, got[k])


def test_sums_of_named_cases(spark):
    nan, inf = math.nan, math.inf
    cases = [[4e-19, 4e-19], [1e21], [1.0, nan], [inf, 1.0], [inf, -inf], [1e300, 1e-300, -1e300], [1e308] * 3, [-1e308] * 3, [None], [None, 2.0], [0.1] * 10, [-0.0]]
    rows = [(k, v) for k, values in enumerate(cases) for v in values]
    got = agg.collect_map(agg.sum_per_key(tables.frame_from_rows(spark, rows, "k int, v double"), "k", "v"), "k", "total")
    assert str([got[k] for k in range(len(cases))]) == str([8e-19, 1e21, nan, inf, nan, 1e-300, inf, -inf, None, 2.0, 1.0, 0.0])
    typed = tables.frame_from_rows(spark, [(1, 10**17, 1.5)] * 3, "k int, n long, f float")
    r = agg.sum_per_key(typed, "k", "n", "n").join(agg.sum_per_key(typed, "k", "f", "f"), "k").first()
    assert r["n"] == 3 * 10**17 and r["f"] == 4.5
    assert agg.sum_per_key(typed.limit(0), "k", "f").count() == 0
