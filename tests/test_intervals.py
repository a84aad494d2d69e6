"""Overlap operators against brute force over all pairs."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tarmaq.operators import intervals as I
from tarmaq.operators.running import SLICE, with_slice
from tarmaq.operators.sessions import sessions

BASE = datetime(2024, 1, 1)
SCHEMA = "id long, k string, s timestamp_ntz, e timestamp_ntz"
ARGS = (["k"], "s", "e", "id")
# Key, start, length: short range, so touching, nested, equal and empty ones are common.
SPANS = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40), st.integers(0, 9)),
                 min_size=1, max_size=25)
LIGHT = settings(max_examples=6, deadline=None,
                 suppress_health_check=[HealthCheck.function_scoped_fixture])


def build(spans, first=0):
    return [(first + i, k, BASE + timedelta(hours=s), BASE + timedelta(hours=s + n))
            for i, (k, s, n) in enumerate(spans)]


def clash(a, b):
    return a[1] == b[1] and a[2] < b[3] and a[3] > b[2]


@LIGHT
@given(SPANS)
def test_counts_first_and_running_match_brute_force(spark, spans):
    data = build(spans)
    df = spark.createDataFrame(data, SCHEMA)
    others = {a[0]: [b for b in data if b[0] != a[0] and clash(a, b)] for a in data}

    counts = {r.id: r.clashes for r in I.self_clash_counts(df, *ARGS, slice_seconds=10_000).collect()}
    assert counts == {i: len(o) for i, o in others.items()}

    first = {r.id: r.first_clash for r in I.first_clash(df, *ARGS, slice_seconds=10_000).collect()}
    assert first == {i: min(((b[2], b[3], b[0]) for b in o), default=(None,))[-1]
                     for i, o in others.items()}

    flags = {r.id: r.clashes
             for r in I.clashes_with_earlier(df, *ARGS, slice_seconds=10_000).collect()}
    ranked = sorted(data, key=lambda a: (a[2], a[3], a[0]))
    assert flags == {a[0]: any(b[1] == a[1] and b[3] > a[2] for b in ranked[:i])
                     for i, a in enumerate(ranked)}


@LIGHT
@given(SPANS, SPANS)
def test_candidates_against_busy(spark, wanted, taken):
    asked, busy = build(wanted), build(taken, 1000)
    got = {r.id: r.clashes for r in I.clash_counts(
        spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(busy, SCHEMA), *ARGS,
        slice_seconds=10_000).collect()}
    assert got == {a[0]: sum(clash(a, b) for b in busy) for a in asked}


def test_touching_intervals_do_not_clash(spark):
    df = spark.createDataFrame(build([("a", 0, 2), ("a", 2, 2), ("a", 4, 1)]), SCHEMA)
    assert {r.clashes for r in I.self_clash_counts(df, *ARGS).collect()} == {0}
    assert {r.first_clash for r in I.first_clash(df, *ARGS).collect()} == {None}


@pytest.mark.parametrize("size", [1800, 7200, 100_000])
def test_slice_size_does_not_matter(spark, rows, size):
    spans = [("a", (7 * i) % 50, i % 11) for i in range(120)]  # one hot key
    df = spark.createDataFrame(build(spans), SCHEMA)
    assert rows(I.first_clash(df, *ARGS, slice_seconds=size)) == rows(I.first_clash(df, *ARGS))
    assert rows(I.self_clash_counts(df, *ARGS, slice_seconds=size)) == rows(I.self_clash_counts(df, *ARGS))


def test_a_burst_is_cut_as_finely_as_the_slice(spark):
    moments = [(1, BASE + timedelta(seconds=i % 5)) for i in range(1000)] + [(1, BASE + timedelta(days=366))]
    df = spark.createDataFrame(moments, "k long, s timestamp_ntz")
    sizes = [r["count"] for r in with_slice(df, "s", 1).groupBy("k", SLICE).count().collect()]
    assert sorted(sizes) == [1, 200, 200, 200, 200, 200]


def test_building_a_plan_runs_nothing(spark):
    df = spark.createDataFrame(build([("a", i, 3) for i in range(9)]), SCHEMA)
    spark.sparkContext.setJobGroup("plans", "plans")
    try:
        I.self_clash_counts(df, *ARGS)
        I.clash_counts(df, df, *ARGS)
        I.first_clash(df, *ARGS)
        I.clashes_with_earlier(df, *ARGS)
        sessions(df, "k", "s", 60)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
