"""Changes bucket by bucket against whole-table changes."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airline import AS_OF
from tarmaq.plans import flows, scoped, transitions
from tarmaq.sources import buckets

N = 16
NOW = datetime(2026, 2, 1)


@pytest.fixture
def store(spark, air, tmp_path):
    folder = str(tmp_path / "store")
    buckets.create(spark, folder, {name: air[name] for name in scoped.BY_FLIGHT}, "flight_id", N)
    return folder


def same(spark, rows, store, want):
    got = scoped.read(spark, store)
    for name in scoped.BY_FLIGHT:
        if name in want:
            assert rows(got[name]) == rows(want[name].select(got[name].columns)), name


def rewritten(store, name="orders", version=2):
    folder = f"{store}/{name}/v={version}"
    return sorted(int(n.partition("=")[2]) for n in os.listdir(folder) if "=" in n) if os.path.isdir(folder) else []


def test_whole_tables_come_back(spark, air, rows, store):
    same(spark, rows, store, air)
    assert buckets.layout(spark, store) == ("flight_id", N)


def test_a_cancellation_of_ten_orders_writes_ten_buckets_at_most(spark, air, rows, store):
    ten = (air["orders"].filter("order_status = 'Active'").orderBy("order_id").limit(10)
           .select("order_id", F.coalesce("guest_email", "reg_customer_email").alias("email")))
    ten = spark.createDataFrame(ten.collect(), ten.schema)
    want = flows.cancel_orders(air, ten, "2025-01-01 00:00:00")
    decided = scoped.cancel_orders(spark, store, ten, "2025-01-01 00:00:00")
    assert rows(decided, "order_id", "decision") == rows(want["decisions"], "order_id", "decision")
    assert decided.filter("decision = 'accepted'").count() > 0
    touched = buckets.touched(air["orders"].join(ten, "order_id").select("flight_id"), "flight_id", N)
    assert rewritten(store) == touched and 0 < len(touched) <= 10
    same(spark, rows, store, want)


def test_flights_are_cancelled_with_their_orders(spark, air, rows, store):
    early = "2025-01-01 00:00:00"
    asks = air["flight"].filter("flight_status in ('Scheduled', 'Full')").orderBy("flight_id").limit(2).select(
        "flight_id", "manager_id")
    want = flows.cancel_requests(air, asks, early)
    got = scoped.cancel_flights(spark, store, asks, early)
    for name in ("decisions", "refunds"):
        assert rows(got[name], *want[name].columns) == rows(want[name])
    assert len(rewritten(store)) <= 2 and rewritten(store) == rewritten(store, "seat")
    same(spark, rows, store, want)


def test_holds_lapse_and_flights_leave(spark, air, rows, tmp_path):
    stale = air["orders"].withColumn("order_status", F.when(F.col("flight_id") == "F1007", "Pending")
                                     .otherwise(F.col("order_status")))
    store = str(tmp_path / "stale")
    buckets.create(spark, store, {**{n: air[n] for n in scoped.BY_FLIGHT}, "orders": stale}, "flight_id", N)
    scoped.expire_holds(spark, store, AS_OF)
    orders, seats = transitions.expire_holds(stale, air["seat"], AS_OF)
    same(spark, rows, store, {"orders": orders, "seat": seats})
    assert len(rewritten(store, "seat")) == 1
    scoped.refresh_status(spark, store, AS_OF)
    flights = transitions.refresh_status(air["flight"], AS_OF)
    done = transitions.derive_order_completed(orders, flights)
    same(spark, rows, store, {"flight": flights})
    # orders of flights that were completed before are not looked at
    changed = flights.join(air["flight"].withColumnRenamed("flight_status", "was").select("flight_id", "was"), "flight_id").filter(
        "flight_status <> was").select("flight_id")
    got = scoped.read(spark, store)["orders"].join(changed, "flight_id", "left_semi")
    assert rows(got, "order_id", "order_status") == rows(done.join(changed, "flight_id", "left_semi"), "order_id", "order_status")


def test_booking_touches_the_flights_asked_for(spark, air, rows, store):
    requests = spark.createDataFrame(
        [(o, "F1005", f"{o}@example.org", None, 3, c, NOW + timedelta(minutes=c)) for o, c in (("N1", 1), ("N2", 1), ("N3", 2))],
        "order_id string, flight_id string, guest_email string, reg_customer_email string, s_row int, s_column int, "
        "requested_ts timestamp_ntz")
    payments = spark.createDataFrame([("N1", NOW + timedelta(minutes=9))], "order_id string, paid_at timestamp_ntz")
    want = flows.book(air, requests, payments, AS_OF)
    scoped.book(spark, store, requests, payments, AS_OF)
    assert rewritten(store) == buckets.touched(requests, "flight_id", N)
    same(spark, rows, store, {"orders": want["orders"], "seat": want["seat"]})


def test_an_emptied_bucket_is_read_as_empty(spark, air, rows, store):
    gone = air["flight"].select("flight_id")
    mine = buckets.touched(gone.limit(1), "flight_id", N)
    gone = gone.filter(buckets.bucket_of("flight_id", N).isin(mine))
    scoped.delete_flights(spark, store, gone)
    for name in scoped.BY_FLIGHT:
        assert rows(scoped.read(spark, store)[name]) == rows(air[name].join(gone, "flight_id", "left_anti").select(air[name].columns))
    assert not [r for r in buckets.manifest(spark, store) if r["bucket"] in mine]


def test_a_failed_change_changes_nothing(spark, air, rows, store):
    with pytest.raises(ValueError, match="outside"):
        scoped.apply(spark, store, air["flight"].limit(1), lambda t: {"orders": t["orders"], "seat": air["seat"]})
    same(spark, rows, store, air)
    scoped.apply(spark, store, air["flight"].limit(0), lambda t: {"orders": t["orders"].limit(0)})
    same(spark, rows, store, air)
