"""Candidates for new flights against every pair of flight and member."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarmaq.plans import candidates as B
from tarmaq.plans import scheduling as C

BASE = datetime(2026, 5, 1)
DEMAND = "flight_id string, role string, start_ts timestamp_ntz, end_ts timestamp_ntz, fit_only boolean, seats int"
POOL = "role string, member string, fit boolean, load bigint"
BUSY = "role string, member string, start_ts timestamp_ntz, end_ts timestamp_ntz"


def every_pair(demand, pool, busy):
    out = set()
    for flight, role, start, end, fit_only, seats in demand:
        if start is None or end is None:
            continue
        free = sorted((load, member) for r, member, fit, load in pool
                      if r == role and (fit or not fit_only)
                      and not any(r2 == role and m2 == member and None not in (s, e) and start < e and end > s
                                  for r2, m2, s, e in busy))
        out |= {(flight, role, place, member, load) for place, (load, member) in enumerate(free[:seats], 1)}
    return out


def world(seed, flights=60, members=25, intervals=160):
    """Little time and few members, so that touching, nested, empty and fully booked times are common."""
    draw = random.Random(seed)

    def span(most):
        start = BASE + timedelta(hours=draw.randrange(120))
        return start, start + timedelta(hours=draw.choice((0, 1, 2, 6, 7, 12, most)))

    pool = [(role, f"{role[0]}{k:02d}", draw.choice((True, False, None)), draw.randrange(4))
            for role in ("pilot", "plane") for k in range(members)]
    busy = []
    for _ in range(intervals):
        role, member, _, _ = draw.choice(pool[:members // 3] if draw.random() < .6 else pool)
        busy.append((role, member, *span(200)))
    busy += [("pilot", "nobody", *span(5)), ("pilot", "p01", None, None)]
    demand = [(f"F{k}", role, *span(90), draw.random() < .4, draw.randrange(0, 5))
              for k in range(flights) for role in ("pilot", "plane")]
    return demand + [("F-none", "pilot", None, None, False, 2), ("F-role", "steward", *span(3), False, 1)], pool, busy


def frames(spark, demand, pool, busy):
    return spark.createDataFrame(demand, DEMAND), spark.createDataFrame(pool, POOL), spark.createDataFrame(busy, BUSY)


@pytest.mark.parametrize("seed", range(4))
def test_equals_every_pair(spark, seed):
    data = world(seed)
    got = B.shortlist(*frames(spark, *data), step_hours=(1, 6, 6, 24)[seed]).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == every_pair(*data)


def test_nearly_all_are_busy(spark):
    """All but one of the best 40 are busy; places come from behind them."""
    pool = [("pilot", f"p{k:02d}", True, k) for k in range(50)]
    busy = [("pilot", f"p{k:02d}", BASE, BASE + timedelta(hours=30)) for k in range(40) if k != 17]
    demand = [("F1", "pilot", BASE, BASE + timedelta(hours=2), True, 3),
              ("F2", "pilot", BASE + timedelta(hours=30), BASE + timedelta(hours=31), True, 1),
              ("F3", "pilot", BASE, BASE + timedelta(hours=2), True, 60)]
    got = {tuple(r) for r in B.shortlist(*frames(spark, demand, pool, busy)).collect()}
    assert got == every_pair(demand, pool, busy)
    assert {r[3] for r in got if r[0] == "F1"} == {"p17", "p40", "p41"} and len([r for r in got if r[0] == "F3"]) == 11


def test_blocks_of_ranks(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 4)
    data = world(9)
    assert {tuple(r) for r in B.shortlist(*frames(spark, *data)).collect()} == every_pair(*data)


def test_empty_inputs(spark):
    demand, pool, busy = world(1, flights=5)
    none = frames(spark, [], [], [])
    assert B.shortlist(none[0], *frames(spark, demand, pool, busy)[1:]).count() == 0
    assert B.shortlist(frames(spark, demand, pool, busy)[0], none[1], none[2]).count() == 0
    alone = B.shortlist(*frames(spark, demand, pool, [])).collect()
    assert {tuple(r) for r in alone} == every_pair(demand, pool, [])


def test_few_members_are_looked_at(spark):
    """Free members are not listed: each flight meets the best of its window only."""
    pool = spark.range(20_000).select(F.lit("pilot").alias("role"), F.col("id").cast("string").alias("member"),
                                      F.lit(True).alias("fit"), F.col("id").alias("load"))
    demand, _, busy = frames(spark, [(f"F{k}", "pilot", BASE, BASE + timedelta(hours=1), False, 2) for k in range(50)],
                             [], [("pilot", "0", BASE, BASE + timedelta(hours=9))])
    lengths = B._lengths(B.STEP_HOURS)
    members, asked = B.ranked(pool), B._placed(demand, lengths)
    needed = asked.groupBy(*B.WINDOW, "_width").agg(F.max("seats").cast("bigint").alias("k"))
    intervals = B._busy_in_windows(busy, members, needed, {0: lengths[0]})
    taken = intervals.select(*B.WINDOW, "rank").distinct()
    limits = B._limits(needed, taken, members.groupBy(*B.POOL).agg(F.max("size").alias("size")))
    assert [r["_limit"] for r in limits.collect()] == [2]
    assert B._gaps(limits, taken, intervals).count() == 2 + 2  # two are free, one before and after its flight
    assert {r["member"] for r in B.shortlist(demand, pool, busy).collect()} == {"1", "2"}


def test_demand_follows_the_crew_rules(air):
    timed = C.timed(air["flight"], air["route"])
    demand = {(r["flight_id"], r["role"]): (r["seats"], r["fit_only"]) for r in B.crew_demand(timed).collect()}
    for row in timed.collect():
        long = row["minutes"] >= 360
        assert [demand[row["flight_id"], role] for role in ("pilot", "attendant", "plane")] == [
            (3 if long else 2, long), (6 if long else 3, long), (1, long)]


def test_agrees_with_the_check_for_one_flight(spark, air):
    """The first candidates are among those that available_for lists for the same time."""
    timed = C.open_flights(C.timed(air["flight"], air["route"]))
    busy = timed.join(air["pilot_flight"], "flight_id").select(
        F.lit("pilot").alias("role"), F.col("employee_id").alias("member"), "start_ts", "end_ts")
    pool = B.loads(air["pilot"].select(F.lit("pilot").alias("role"), F.col("employee_id").alias("member"),
                                       F.col("long_flight_training").alias("fit")), busy)
    asked = timed.withColumn("seats", F.lit(100)).select(
        "flight_id", F.lit("pilot").alias("role"), "start_ts", "end_ts", (F.col("minutes") >= 360).alias("fit_only"), "seats")
    got = {}
    for r in B.shortlist(asked, pool, busy).collect():
        got.setdefault(r["flight_id"], set()).add(r["member"])
    for row in timed.limit(3).collect():
        free = C.available_for(air["pilot"], air["pilot_flight"], C.timed(air["flight"], air["route"]), "employee_id",
                               "long_flight_training", str(row["start_ts"]), row["minutes"])
        assert got.get(row["flight_id"], set()) == {r["employee_id"] for r in free.collect()}


def test_few_ranks_are_looked_at_first(spark, monkeypatch):
    """Windows whose limit lies beyond the first ranks are looked at again; the result is that of all pairs."""
    monkeypatch.setattr(B, "REACH", 2)
    monkeypatch.setattr(B, "REACH_FACTOR", 3)
    looked_at = []
    whole = B._busy_in_windows
    monkeypatch.setattr(B, "_busy_in_windows", lambda busy, members, needed, lengths: looked_at.append(
        (members.count(), needed.count())) or whole(busy, members, needed, lengths))
    data = world(5)
    got = B.shortlist(*frames(spark, *data), step_hours=6).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == every_pair(*data)
    members, windows = zip(*looked_at)
    assert len(looked_at) > 1 and list(members) == sorted(members)
    assert list(windows) == sorted(windows, reverse=True) and windows[-1] < windows[0]
