"""State changes, with rows on both sides of every boundary."""

from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal as D

from airline import AS_OF
from tarmaq.operators.relations import (exists_in, not_existing, null_orphans, replace_children,
                                        upsert)
from tarmaq.plans import datasets, reports
from tarmaq.plans import transitions as X

NOW = datetime(2026, 2, 1)
ORDER = "order_id string, flight_id string, date_of_purchase timestamp_ntz, order_status string"
SEAT = "flight_id string, s_row int, s_column int, order_id string"


def before(minutes):
    return NOW - timedelta(minutes=minutes)


def after(hours, minutes=0):
    return NOW + timedelta(hours=hours, minutes=minutes)


def test_refresh_status(air, rows):
    refreshed = X.refresh_status(air["flight"], AS_OF)
    assert Counter(r.flight_status for r in refreshed.collect())["Completed"] == 21
    changes = X.status_changes(air["flight"], refreshed, "flight_id", "flight_status")
    assert ("Full", "Completed", 4, 4) in rows(changes)
    full = X.status_changes(air["flight"], refreshed, "flight_id", "flight_status")
    assert full.filter("old_status = 'Cancelled'").collect()[0].n == 2


def test_a_flight_taking_off_right_now_stays_open(spark):
    flights = spark.createDataFrame([("A", NOW, "Scheduled"), ("B", before(1), "Scheduled")],
                                    "flight_id string, takeoff_ts timestamp_ntz, flight_status string")
    got = {r.flight_id: r.flight_status for r in X.refresh_status(flights, AS_OF).collect()}
    assert got == {"A": "Scheduled", "B": "Completed"}


def test_holds_lapse_strictly_after_fifteen_minutes(spark):
    orders = spark.createDataFrame([
        ("late", "F", before(15) - timedelta(minutes=1), "Pending"),
        ("edge", "F", before(15), "Pending"),
        ("young", "F", before(14) - timedelta(seconds=59), "Pending"),
        ("paid", "F", before(600), "Active")], ORDER)
    seats = spark.createDataFrame([("F", 1, i, o) for i, o in enumerate(
        ["late", "late", "edge", "young", "paid", None])], SEAT)
    left, freed = X.expire_holds(orders, seats, AS_OF)
    assert {r.order_id for r in left.collect()} == {"edge", "young", "paid"}
    assert Counter(r.order_id for r in freed.collect()) == {
        None: 3, "edge": 1, "young": 1, "paid": 1}


def test_confirm_payment(spark, rows):
    orders = spark.createDataFrame(
        [("a", "F", before(5), "Pending"), ("b", "F", before(5), "Active"),
         ("c", "F", before(5), "Pending"), ("edge", "F", before(20), "Pending"),
         ("late", "F", before(20), "Pending")], ORDER)
    payments = spark.createDataFrame(
        [("a", before(1)), ("a", before(2)), ("b", before(1)), ("gone", before(1)),
         ("edge", before(5)), ("late", before(4))], "order_id string, paid_at timestamp_ntz")
    confirmed, rejected = X.confirm_payment(orders, payments)
    assert {(r.order_id, r.order_status, r.date_of_purchase) for r in confirmed.collect()} == {
        ("a", "Active", before(2)), ("b", "Active", before(5)), ("c", "Pending", before(5)),
        ("edge", "Active", before(5)), ("late", "Pending", before(20))}
    assert {(r.order_id, r.paid_at) for r in rejected.collect()} == {
        ("a", before(1)), ("b", before(1)), ("gone", before(1)), ("late", before(4))}


def test_early_and_repeated_payments(spark):
    orders = spark.createDataFrame([("a", "F", before(5), "Pending"), ("b", "F", before(5), "Pending")], ORDER)
    payments = spark.createDataFrame(
        [("a", before(3)), ("a", before(3)), ("a", before(9)), ("b", before(60 * 24 * 30)), ("b", None)],
        "order_id string, paid_at timestamp_ntz")
    confirmed, rejected = X.confirm_payment(orders, payments)
    assert {(r.order_id, r.order_status, r.date_of_purchase) for r in confirmed.collect()} == {
        ("a", "Active", before(3)), ("b", "Pending", before(5))}
    assert sorted((r.order_id, str(r.paid_at)) for r in rejected.collect()) == sorted([
        ("a", str(before(3))), ("a", str(before(9))), ("b", str(before(60 * 24 * 30))), ("b", "None")])


def test_codes_go_on_after_the_highest(spark):
    new = spark.createDataFrame([("x",), ("y",)], "name string")
    old = spark.createDataFrame([("00007",), ("00003",), ("odd",), (None,)], "code string")
    assert sorted(r.code for r in X.assign_codes(new, ["name"], existing=old).collect()) == ["00008", "00009"]
    assert sorted(r.code for r in X.assign_codes(new, ["name"], existing=old.limit(0)).collect()) == ["00001", "00002"]


def test_customer_cancel_needs_more_than_36_hours(spark):
    cases = [("early", after(36, 1), "Active", "100.00"), ("edge", after(36), "Active", "100.00"),
             ("late", after(35, 59), "Active", "100.00"), ("done", after(99), "Completed", "100.00"),
             ("cent", after(99), "Active", "10.10"), ("dime", after(99), "Active", "0.30")]
    orders = spark.createDataFrame(
        [(o, "F", t, s, D(m)) for o, t, s, m in cases],
        "order_id string, flight_id string, takeoff_ts timestamp_ntz, order_status string, "
        "total decimal(18,2)")
    decided = X.cancel_decisions(orders, AS_OF)
    got = {r.order_id: (r.decision, r.fee, r.refund) for r in decided.collect()}
    nothing = (D("0.00"), D("0.00"))
    assert got == {
        "early": ("accepted", D("5.00"), D("95.00")), "edge": ("too_late", *nothing),
        "late": ("too_late", *nothing), "done": ("not_active", *nothing),
        # Half cents: the fee is rounded up and the refund is the rest.
        "cent": ("accepted", D("0.51"), D("9.59")), "dime": ("accepted", D("0.02"), D("0.28"))}
    seats = spark.createDataFrame([("F", 1, 1, "early"), ("F", 1, 2, "edge"), ("F", 1, 3, None)], SEAT)
    changed, freed = X.apply_customer_cancel(orders, seats, decided)
    assert {r.order_id for r in changed.filter("order_status = 'Cancelled by customer'").collect()} \
        == {"early", "cent", "dime"}
    assert Counter(r.order_id for r in freed.collect()) == {None: 2, "edge": 1}


def test_flight_cancel_needs_its_manager_and_72_hours(spark):
    flights = spark.createDataFrame([
        ("ok", "M1", after(72), "Scheduled"), ("full", "M1", after(73), "Full"),
        ("late", "M1", after(71, 59), "Scheduled"), ("done", "M1", after(99), "Completed"),
        ("other", "M2", after(99), "Scheduled")],
        "flight_id string, manager_id string, takeoff_ts timestamp_ntz, flight_status string")
    requests = spark.createDataFrame([(f, "M1") for f in ("ok", "full", "late", "done", "other",
                                                          "none")],
                                     "flight_id string, manager_id string")
    decided = X.flight_cancel_decisions(requests, flights, AS_OF)
    assert {r.flight_id: r.decision for r in decided.collect()} == {
        "ok": "accepted", "full": "accepted", "late": "too_late", "done": "not_open",
        "other": "not_manager", "none": "not_found"}

    orders = spark.createDataFrame([("a", "ok", NOW, "Active"), ("b", "ok", NOW, "Pending"),
                                    ("c", "ok", NOW, "Completed"), ("d", "late", NOW, "Active"),
                                    ("e", "ok", NOW, "Active")], ORDER)
    seats = spark.createDataFrame([("ok", 1, 1, "a"), ("ok", 1, 2, "b"), ("ok", 1, 3, "c"),
                                   ("late", 1, 1, "d"), ("late", 1, 2, None)], SEAT)
    totals = spark.createDataFrame([("a", D("120.50")), ("b", D("70.00"))],
                                   "order_id string, total decimal(18,2)")
    gone = X.cancelled_flights(decided)
    refunds = {r.flight_id: (r.refunded_orders, r.total_refunded)
               for r in X.flight_cancel_refunds(gone, orders, totals).collect()}
    assert refunds == {"ok": (2, D("120.50")), "full": (0, D("0.00"))}
    new_flights, new_orders, new_seats = X.cancel_flights(gone, flights, orders, seats)
    assert {r.flight_id for r in new_flights.filter("flight_status = 'Cancelled'").collect()} == {
        "ok", "full"}
    assert {r.order_id: r.order_status for r in new_orders.collect()} == {
        "a": "Cancelled by system", "b": "Cancelled by system", "c": "Completed", "d": "Active",
        "e": "Cancelled by system"}
    assert Counter(r.order_id for r in new_seats.collect()) == {None: 4, "d": 1}


def test_derived_states(air, spark):
    tally = reports.seat_tally(air["seat"], air["orders"])
    opened = air["flight"].replace("Full", "Scheduled", "flight_status")
    full = X.derive_full(opened, tally).filter("flight_status = 'Full'")
    # F1025's last rows do not exist, so its seats are all taken as well.
    assert {r.flight_id for r in full.collect()} == {"F1003", "F1011", "F1017", "F1022", "F1025"}
    refreshed = X.refresh_status(air["flight"], "2026-03-01 00:00:00")
    done = X.derive_order_completed(air["orders"], refreshed)
    # F1005-F1007 and F1031-F1033 have departed by then; F1019 and F1020 have not.
    assert done.filter("order_status = 'Active'").select("flight_id").distinct().count() == 2

    flights = spark.createDataFrame([("empty", "Scheduled")], "flight_id string, flight_status string")
    nothing = tally.limit(0)
    assert X.derive_full(flights, nothing).collect()[0].flight_status == "Scheduled"
    assert X.derive_full(flights, nothing, count_empty=True).collect()[0].flight_status == "Full"


def test_codes_are_dense_unique_and_wide_enough(spark):
    df = spark.range(0, 2500, 1, 7).selectExpr("id", "id % 3 as hot")
    coded = X.assign_codes(df, ["hot", "id"], width=3)
    got = [r.code for r in coded.orderBy("hot", "id").collect()]
    assert got[:2] == ["001", "002"] and got[-1] == "2500"
    assert [int(c) for c in got] == list(range(1, 2501))


def test_upsert_keeps_the_highest_version(spark, rows):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 9)], "k int, name string, v int")
    new = spark.createDataFrame([(2, "B", 1), (2, "BB", 3), (3, "c", 1)], "k int, name string, v int")
    assert rows(upsert(old, new, ["k"], "v")) == [(1, "a", 0), (2, "BB", 3), (3, "c", 1)]


def test_replace_children(spark, rows):
    old = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3")], "k string, phone string")
    new = spark.createDataFrame([("x", "9")], "k string, phone string")
    assert rows(replace_children(old, new, "k")) == [("x", "9"), ("y", "3")]


def test_null_orphans_and_probes(spark, rows):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, fk string")
    parent = spark.createDataFrame([("a",), ("a",)], "pk string")
    assert rows(null_orphans(child, parent, "fk", "pk")) == [(1, "a"), (2, None), (3, None)]
    keys = parent.withColumnRenamed("pk", "fk")
    assert rows(exists_in(child, keys, ["fk"])) == [(1, "a")]
    assert rows(not_existing(child, keys, ["fk"])) == [(2, "b"), (3, None)]


def test_order_totals_and_history(air):
    lines = datasets.order_lines(air["seat"], air["pricing"])
    totals = {r.order_id: r.total for r in datasets.order_totals(
        air["orders"].select("order_id", "order_status"), lines).collect()}
    assert len(totals) == 220 and sum(totals.values()) == D("998330.00")


def test_sales_of_cancelled_flights_are_void_in_one_join(spark, rows):
    sales = spark.createDataFrame([(1, "A", "Active"), (1, "B", "Pending"), (1, "C", "Completed"), (2, "D", "Active"),
                                   (None, "E", "Active")], "flight_id int, order_id string, order_status string")
    gone = spark.createDataFrame([(1,), (1,), (3,)], "flight_id int")
    assert rows(X.void_sales(gone, sales), "order_id", "order_status", "seat_order") == [
        ("A", "Cancelled by system", None), ("B", "Cancelled by system", None), ("C", "Completed", None),
        ("D", "Active", "D"), ("E", "Active", "E")]
