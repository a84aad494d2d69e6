"""Derived datasets on the airline tables."""

from datetime import datetime
from decimal import Decimal as D

from pyspark.sql import functions as F

from airline import AS_OF
from tarmaq.functions.predicates import in_tuples, owned_by
from tarmaq.operators.relations import number_series
from tarmaq.operators.relations import coalesce_owner
from tarmaq.plans import datasets, seating


def routed(air):
    return air["flight"].join(air["route"], "route_id")


def test_search_shows_only_scheduled_flights(air, rows):
    found = datasets.flight_search(routed(air), air["pricing"])
    assert found.count() == 9
    one = datasets.flight_search(routed(air), air["pricing"], date="2026-02-07", origin="AKL",
                                 destination="DXB")
    assert rows(one, "flight_id", "landing_date", "landing_time", "from_price") == [
        ("F1032", "2026-02-08", "02:00:00", D("1250.00"))]
    assert datasets.flight_search(routed(air), air["pricing"], origin="JFK").count() == 0


def test_from_price_is_null_without_prices(air, rows):
    priced = datasets.from_price(air["flight"], air["pricing"])
    assert rows(priced.filter("from_price is null"), "flight_id") == [("F1030",)]


def test_listing_cancel_flag_and_order(air):
    listed = datasets.flight_listing(routed(air), AS_OF, n=8).collect()
    takeoffs = [r.takeoff_ts for r in listed]
    assert takeoffs == sorted(takeoffs, reverse=True) and len(listed) == 8
    by_id = {r.flight_id: r.can_cancel
             for r in datasets.flight_listing(routed(air), AS_OF).collect()}
    assert not by_id["F1006"] and by_id["F1031"] and not by_id["F1001"]
    only = datasets.flight_listing(routed(air), AS_OF, status="Full", date="2025-10-19").collect()
    assert [r.flight_id for r in only] == ["F1017"]


def test_cancel_flag_at_exactly_72_hours(air):
    at = {r.flight_id: r.can_cancel for r in datasets.flight_listing(
        routed(air), "2026-02-02 18:55:00", flight_id="F1031").collect()}
    late = {r.flight_id: r.can_cancel for r in datasets.flight_listing(
        routed(air), "2026-02-02 18:55:01", flight_id="F1031").collect()}
    assert at == {"F1031": True} and late == {"F1031": False}


def test_cabin_offer(air, rows):
    offer = datasets.cabin_offer(air["flight"], air["cabin_class"], air["pricing"], air["seat"])
    got = {(r.flight_id, r.class_type): (r.rows_num, r.price, r.available) for r in offer.collect()}
    assert got[("F1003", "Economy")] == (10, D("480.00"), 0)
    assert got[("F1030", "Business")][1] is None
    assert got[("F1014", "Business")] == (5, D("2300.00"), 20)
    free = datasets.free_seats(air["seat"])
    assert free.filter("flight_id = 'F1003'").count() == 0


def test_seat_map(air):
    taken = datasets.seat_map(air["seat"], "Economy").filter("flight_id = 'F1001' and is_taken")
    assert taken.count() == 12


def test_order_summary(air):
    lines = datasets.order_lines(air["seat"], air["pricing"])
    flights = routed(air).drop("flight_status")
    summary = datasets.order_summary(air["orders"], flights, lines)
    got = {r.order_id: (r.origin_airport, r.seats, r.total) for r in summary.collect()}
    assert len(got) == 220
    assert got["O0001"] == ("TLV", "1A, 1B, 1C", D("1350.00"))
    assert got["O0004"][1:] == ("", D("0.00"))  # cancelled: seats are free again


def test_purchase_history(air):
    orders = coalesce_owner(air["orders"], "guest_email", "reg_customer_email")
    lines = datasets.order_lines(air["seat"], air["pricing"])
    all_of = datasets.purchase_history(orders, lines, "owner")
    assert all_of.count() == 220
    newest = datasets.purchase_history(orders, lines, "owner", n=2)
    by_owner = {}
    for r in newest.collect():
        by_owner.setdefault(r.owner, []).append((r.position, r.date_of_purchase))
    assert len(by_owner) == 20 and all(len(v) == 2 for v in by_owner.values())
    assert all(a[1] >= b[1] for a, b in (sorted(v) for v in by_owner.values()))
    void = datasets.purchase_history(orders, lines, "owner", status="Cancelled by customer")
    assert {(r.seats_count, r.total) for r in void.collect()} == {(0, D("0.00"))}


def test_history_counts_seats_without_a_price(air):
    orders = coalesce_owner(air["orders"], "guest_email", "reg_customer_email")
    lines = datasets.order_lines(air["seat"], air["pricing"])
    f1030 = datasets.purchase_history(orders.filter("flight_id = 'F1030'"), lines, "owner",
                                      status="Completed")
    assert {(r.seats_count, r.total) for r in f1030.collect()} == {(3, D("0.00"))}


def test_contacts_and_owner(air, spark, rows):
    people = spark.createDataFrame([("a",), ("b",)], "customer_email string")
    phones = spark.createDataFrame([("a", "2"), ("a", "1"), ("a", "2")],
                                   "customer_email string, customer_phone string")
    assert rows(datasets.contact_list(people, phones, "customer_email", "customer_phone")) == [
        ("a", "1, 2"), ("b", "")]
    mine = air["orders"].filter(owned_by("guest_email", "reg_customer_email", "g001@example.org"))
    assert mine.count() == 11


def test_tuples(air, rows):
    some = [(1, 1), (2, 3)]
    assert in_tuples(air["seat"], ["s_row", "s_column"], some).count() == 2 * 33
    many = [(r, c) for r in range(1, 13) for c in range(1, 12)]
    assert in_tuples(air["seat"], ["s_row", "s_column"], many).count() == \
        air["seat"].filter("s_row <= 12").count()
    assert in_tuples(air["seat"], ["s_row", "s_column"], []).count() == 0
    for copies in (1, 101):  # values of another type, NULLs and repeats, however long the list is
        assert in_tuples(air["seat"], ["s_row", "s_column"], [("1", "1"), (None, 3)] * copies).count() == 33


def test_cabins_without_seats_and_empty_series(air, spark):
    cabins = spark.createDataFrame([("P1", "Business", 4, 0), ("P1", "Economy", 2, 2), ("P2", "Business", 0, 3)],
                                   "plane_id string, class_type string, columns_num int, rows_num int")
    flights = spark.createDataFrame([("F1", "P1"), ("F2", "P2")], "flight_id string, plane_id string")
    seats = seating.seats_from_layout(flights, cabins).collect()
    assert sorted((r.flight_id, r.class_type, r.s_row, r.s_column) for r in seats) == [
        ("F1", "Economy", r, c) for r in (1, 2) for c in (1, 2)]
    assert seating.seat_grid(seating.start_rows(cabins)).count() == 4
    for limit, want in ((0, []), (-2, []), (1, [1]), (3, [1, 2, 3])):
        one = spark.createDataFrame([(limit,)], "n int")
        assert sorted(r.n for r in number_series(one, "n").collect()) == want


def test_seats_are_created_once(air):
    again = seating.seats_from_layout(air["flight"], air["cabin_class"], air["seat"])
    assert again.count() == 0
    fewer = air["seat"].filter("not (flight_id = 'F1001' and s_row = 1)")
    missing = seating.seats_from_layout(air["flight"], air["cabin_class"], fewer)
    assert missing.count() == 4


def test_rebuild_replaces_seats_and_needs_economy(air):
    one = air["flight"].filter("flight_id in ('F1003', 'F1009')")
    without = air["cabin_class"].filter("not (plane_id = 'P0002' and class_type = 'Economy')")
    rebuilt = seating.rebuild_seats(air["seat"], one, without)
    assert rebuilt.count() == 1940
    held = rebuilt.filter(F.col("order_id").isNotNull()).groupBy("flight_id").count()
    held = {r.flight_id: r["count"] for r in held.collect()}
    assert "F1003" not in held and held["F1009"] == 24


def test_landing_over_midnight(spark):
    df = spark.createDataFrame([(datetime(2024, 2, 28, 23, 30), 1470)],
                               "takeoff_ts timestamp_ntz, flight_duration int")
    got = datasets.with_landing(df).collect()[0]
    assert (got.landing_date, got.landing_time) == ("2024-03-01", "00:00:00")
