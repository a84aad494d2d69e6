"""Sessions and holds against brute force."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarmaq.operators.sessions import follow_sessions, lapsed, no_sessions, sessions

BASE = datetime(2024, 1, 1)
EVENTS = st.lists(st.tuples(st.integers(1, 2), st.integers(0, 600)), min_size=1, max_size=30)
LIGHT = settings(max_examples=6, deadline=None,
                 suppress_health_check=[HealthCheck.function_scoped_fixture])
SCHEMA = "user long, ts timestamp_ntz"


def at(minutes):
    return BASE + timedelta(minutes=minutes)


@LIGHT
@given(EVENTS)
def test_sessions_match_session_windows(spark, rows, events):
    df = spark.createDataFrame([(u, at(m)) for u, m in events], SCHEMA)
    want = df.groupBy("user", F.session_window("ts", "60 minutes").alias("w")).agg(
        F.count("*").alias("requests")).select("user", "w.start", "w.end", "requests")
    for seconds in (60, 3600, 20_000):
        assert rows(sessions(df, "user", "ts", 60, slice_seconds=seconds)) == rows(want)


def test_a_gap_of_exactly_the_limit_continues_the_session(spark):
    df = spark.createDataFrame([(1, at(0)), (1, at(60)), (1, at(121))], SCHEMA)
    got = sorted(r.requests for r in sessions(df, "user", "ts", 60).collect())
    assert got == [1, 2]


@LIGHT
@given(EVENTS, EVENTS)
def test_holds_match_brute_force(spark, held, paid):
    holds = [(i, u, at(m)) for i, (u, m) in enumerate(held)]
    df = spark.createDataFrame(holds, "id long, user long, ts timestamp_ntz")
    pays = spark.createDataFrame([(u, at(m)) for u, m in paid], SCHEMA)
    got = {r.id: r.paid for r in lapsed(df, pays, "user", "ts", 45).collect()}
    assert got == {i: any(u == v and t <= at(m) <= t + timedelta(minutes=45) for v, m in paid)
                   for i, u, t in holds}


@LIGHT
@given(EVENTS, st.lists(st.integers(0, 700), max_size=4))
def test_days_that_go_on_equal_one_run(spark, rows, events, cuts):
    df = spark.createDataFrame([(u, at(m)) for u, m in events], SCHEMA)
    open_, done, since = no_sessions(df, "user", "ts"), [], None
    for cut in [*sorted(cuts), 5000]:
        until = str(at(cut))
        today = df.filter(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
        if since is not None:
            today = today.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
        closed, open_ = follow_sessions(open_, today, "user", "ts", 60, until)
        done += rows(closed)
        open_ = spark.createDataFrame(open_.collect(), open_.schema)
        since = until
    assert sorted(done, key=repr) == rows(sessions(df, "user", "ts", 60)) and open_.count() == 0


def test_an_open_session_waits_for_the_next_day(spark):
    df = spark.createDataFrame([(1, at(0)), (1, at(50)), (2, at(0))], SCHEMA)
    closed, open_ = follow_sessions(no_sessions(df, "user", "ts"), df, "user", "ts", 60, str(at(100)))
    assert [(r.user, r.requests) for r in closed.collect()] == [(2, 1)]
    assert [(r.user, r.session_start, r.last_ts, r.requests) for r in open_.collect()] == [(1, at(0), at(50), 2)]
    later = spark.createDataFrame([(1, at(110))], SCHEMA)  # 60 minutes after the last event: the same session
    closed, open_ = follow_sessions(open_, later, "user", "ts", 60, str(at(1000)))
    assert [(r.session_start, r.session_end, r.requests) for r in closed.collect()] == [(at(0), at(170), 3)]
