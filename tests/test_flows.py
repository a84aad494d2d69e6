"""Whole flows on the airline tables."""

from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest

from airline import AS_OF
from tarmaq import jobs
from tarmaq.plans import flows
from tarmaq.schemas import schema_of
from tarmaq.sources import sinks
from tarmaq.sources.scans import manifest, scan_tables
from tarmaq.sources.sinks import write_version

NOW = datetime(2026, 2, 1)


def test_dashboard(air):
    reports = flows.dashboard(air, AS_OF)
    assert len(reports) == 9
    months = [tuple(r) for r in reports["completed_by_month"].collect()]
    # Full flights that have departed count as completed after the refresh.
    assert months == [("2025-08", 2), ("2025-09", 3), ("2025-10", 6), ("2025-11", 5),
                      ("2026-01", 5)]
    assert reports["revenue_by_class"].count() == 8
    hours = [r.total_hours for r in reports["staff_hours"].collect()]
    assert hours == sorted(hours, reverse=True) and len(hours) == 30
    empty = {name: df.limit(0) for name, df in air.items()}
    assert flows.dashboard(empty, AS_OF)["staff_hours"].count() == 0


def test_book(air, spark):
    ask = []
    for order, seats, minute in (("N1", [(3, 1), (3, 2)], 1), ("N2", [(3, 2), (3, 3)], 2),
                                 ("N3", [(3, 3)], 3), ("N4", [(1, 1)], 4)):
        ask += [(order, "F1005", f"{order.lower()}@example.org", None, r, c,
                 NOW + timedelta(minutes=minute)) for r, c in seats]
    requests = spark.createDataFrame(ask, "order_id string, flight_id string, guest_email string, "
                                          "reg_customer_email string, s_row int, s_column int, "
                                          "requested_ts timestamp_ntz")
    payments = spark.createDataFrame([("N1", NOW + timedelta(minutes=9)),
                                      ("N2", NOW + timedelta(minutes=9))],
                                     "order_id string, paid_at timestamp_ntz")
    after = flows.book(air, requests, payments, AS_OF)
    status = {r.order_id: r.order_status for r in after["orders"].collect()}
    # N2 lost seat 3B to N1 and frees 3C for N3; N4's seat was sold long ago.
    assert {k: status[k] for k in ("N1", "N2", "N3", "N4")} == {
        "N1": "Active", "N2": "Cancelled by system", "N3": "Pending", "N4": "Cancelled by system"}
    assert len(status) == 224
    assert [r.order_id for r in after["rejected_payments"].collect()] == ["N2"]
    summary = {r.order_id: (r.seats, r.total) for r in flows.summaries(air | after).collect()}
    assert summary["N1"] == ("3A, 3B", D("800.00")) and summary["N3"] == ("3C", D("400.00"))


def test_book_pays_before_holds_lapse(air, spark):
    """Hold at 10:00, payment at 10:05, run at 10:30: the order is paid, an unpaid one lapses."""
    at = lambda minute: NOW + timedelta(minutes=minute)
    orders = air["orders"].unionByName(spark.createDataFrame(
        [("P1", "F1005", "p1@example.org", None, at(0), "Pending"), ("P2", "F1005", "p2@example.org", None, at(0), "Pending")],
        air["orders"].schema))
    held = {(3, 1): "P1", (3, 2): "P2"}
    seats = air["seat"].filter("NOT (flight_id = 'F1005' AND s_row = 3 AND s_column <= 2)").unionByName(
        spark.createDataFrame([("F1005", r, c, "P0004", "Business", o) for (r, c), o in held.items()],
                              air["seat"].schema))
    ask = [("O0001", 3, 4, 20), ("N1", 3, 2, 10), ("N2", 3, 2, 20), ("N3", 3, 1, 25)]
    requests = spark.createDataFrame(
        [(o, "F1005", f"{o.lower()}@example.org", None, r, c, at(m)) for o, r, c, m in ask],
        "order_id string, flight_id string, guest_email string, reg_customer_email string, s_row int, s_column int, "
        "requested_ts timestamp_ntz")
    payments = spark.createDataFrame([("P1", at(5)), ("N2", at(21))], "order_id string, paid_at timestamp_ntz")
    guests = spark.createDataFrame(
        [("P1", "p1@example.org", "New", "One", "050"), ("P1", "p1@example.org", "New", "One", "051"),
         ("N3", "n3@example.org", "Not", "Paid", "052")],
        "order_id string, customer_email string, customer_first_name string, customer_last_name string, customer_phone string")
    after = flows.book(air | {"orders": orders, "seat": seats}, requests, payments, "2026-02-01 00:30:00", guests)
    status = {r.order_id: r.order_status for r in after["orders"].collect()}
    # N1 came before the hold of P2 had lapsed; P1 keeps its seat.
    assert "P2" not in status and {k: status[k] for k in ("P1", "N1", "N2", "N3")} == {
        "P1": "Active", "N1": "Cancelled by system", "N2": "Active", "N3": "Cancelled by system"}
    assert after["rejected_payments"].count() == 0
    assert [r.order_id for r in after["rejected_requests"].collect()] == ["O0001"]
    assert after["guest"].count() == air["guest"].count() + 1
    assert sorted(r.customer_phone for r in after["guest_phone"].filter("customer_email = 'p1@example.org'").collect()) == [
        "050", "051"]


def test_refresh_frees_lapsed_holds(air, spark):
    held = air["orders"].filter("flight_id = 'F1007'")
    stale = air["orders"].replace("Active", "Pending", "order_status")
    fresh = flows.refresh(air | {"orders": stale}, AS_OF)
    assert fresh["orders"].filter("order_status = 'Pending'").count() == 0
    assert fresh["seat"].filter("flight_id = 'F1007' and order_id is not null").count() == 0
    assert held.count() == 4
    status = Counter(r.flight_status for r in fresh["flight"].collect())
    assert status == {"Completed": 21, "Cancelled": 2, "Scheduled": 9, "Full": 1}


def proposal(spark, flight, plane, start, pilots, attendants, price=True, route=101):
    rows = {"flight": [(flight, route, plane, "M1", start, "Scheduled")],
            "pricing": [(flight, plane, "Economy", D("100.00"))] if price else [],
            "pilot_flight": [(flight, p) for p in pilots],
            "attendant_flight": [(flight, a) for a in attendants]}
    return {name: spark.createDataFrame(r, schema_of(name)) for name, r in rows.items()}


CREW = (["Psmall0", "Psmall1"], ["Asmall0", "Asmall1", "Asmall2"])


@pytest.mark.parametrize("case, rules", [
    (dict(plane="P0003", start=datetime(2026, 4, 1)), set()),
    (dict(plane="P0003", start=datetime(2026, 4, 1), price=False), {"cabin without a price"}),
    (dict(plane="P0001", start=datetime(2026, 3, 15, 9)),
     {"plane has an overlapping flight", "cabin without a price"}),
    (dict(plane="P0003", start=datetime(2026, 2, 22, 10)),
     {"pilot has an overlapping flight", "attendant has an overlapping flight"}),
    (dict(plane="P0003", start=datetime(2026, 4, 1), route=108),
     {"plane not fit for a long flight", "pilot not fit for a long flight",
      "attendant not fit for a long flight", "crew size"}),
])
def test_schedule(air, spark, case, rules):
    got = flows.schedule(air, proposal(spark, "F2000", pilots=CREW[0], attendants=CREW[1], **case))
    assert {r.rule for r in got["violations"].collect()} == rules
    assert got["flight"].count() == (0 if rules else 1)
    assert got["seat"].count() == (0 if rules else 40)


@pytest.mark.parametrize("change, rules", [
    (dict(route=999), {"unknown route"}), (dict(plane="P9999"), {"unknown plane"}), (dict(manager="M9"), {"unknown manager"}),
    (dict(pilots=["Psmall0", "nobody"]), {"unknown pilot"}), (dict(status="Completed"), {"flight is not open"}),
    (dict(attendants=["Asmall0", "Asmall1", "nobody"]), {"unknown attendant"}),
    (dict(flight="F1001"), {"flight id is taken"}),
    (dict(flight="F1001", pilots=[], attendants=[]), {"flight id is taken", "crew size"})])
def test_schedule_rejects_broken_references(air, spark, change, rules):
    case = dict(flight="F2000", route=101, plane="P0003", manager="M1", status="Scheduled", pilots=CREW[0], attendants=CREW[1]) | change
    rows = {"flight": [(case["flight"], case["route"], case["plane"], case["manager"], datetime(2026, 4, 1), case["status"])],
            "pricing": [(case["flight"], case["plane"], "Economy", D("100.00"))],
            "pilot_flight": [(case["flight"], p) for p in case["pilots"]],
            "attendant_flight": [(case["flight"], a) for a in case["attendants"]]}
    got = flows.schedule(air, {name: spark.createDataFrame(r, schema_of(name)) for name, r in rows.items()})
    found = {r.rule for r in got["violations"].collect()}
    assert rules <= found and found - rules <= {"plane without Economy"}
    assert got["flight"].count() == 0 and got["seat"].count() == 0


def test_cancel_requests(air, spark):
    asks = spark.createDataFrame([("F1007", "M2"), ("F1019", "M2"), ("F1031", "M3")],
                                 "flight_id string, manager_id string")
    after = flows.cancel_requests(air, asks, AS_OF)
    assert {r.flight_id: r.decision for r in after["decisions"].collect()} == {
        "F1007": "accepted", "F1019": "not_manager", "F1031": "accepted"}
    assert {r.flight_id: (r.refunded_orders, r.total_refunded)
            for r in after["refunds"].collect()} == {
        "F1007": (4, D("6880.00")), "F1031": (4, D("21000.00"))}
    assert after["seat"].filter("order_id is not null").count() == 753 - 16 - 12
    fact = flows.sale_fact(air, AS_OF)  # what was sold stays known
    assert fact.agg({"seat_cnt": "sum"}).collect()[0][0] == 744  # F1030 has no prices


def test_cancel_orders(air, spark):
    owner = {r.order_id: r.guest_email or r.reg_customer_email for r in air["orders"].collect()}
    held = air["orders"].filter("order_status = 'Active'").collect()
    early = next(r.order_id for r in held if r.flight_id == "F1007")
    late = next(r.order_id for r in held if r.flight_id == "F1005")
    asks = spark.createDataFrame(
        [(early, f" {owner[early].upper()} "), (late, owner[late]), ("O0001", owner["O0001"]),
         ("O0002", "stranger@example.org"), ("none", "a@example.org")], "order_id string, email string")
    after = flows.cancel_orders(air, asks, AS_OF)
    assert {r.order_id: (r.decision, r.fee, r.refund) for r in after["decisions"].collect()} == {
        early: ("accepted", D("86.00"), D("1634.00")), late: ("too_late", D("0.00"), D("0.00")),
        "O0001": ("not_active", D("0.00"), D("0.00")), "O0002": ("not_found", D("0.00"), D("0.00")),
        "none": ("not_found", D("0.00"), D("0.00"))}
    assert after["seat"].filter("order_id is not null").count() == 753 - 4
    assert after["orders"].filter("order_status = 'Cancelled by customer'").count() == 14


def test_jobs(air, spark, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    for name, df in air.items():
        write_version(df, f"{store}/{name}")
    written = jobs.run(spark, "dashboard", store, out, AS_OF)
    assert len(written) == 9 and spark.read.parquet(f"{out}/fleet_monthly").count() == 5
    assert sorted(jobs.run(spark, "refresh", store, as_of=AS_OF)) == [
        "flight v=2", "orders v=2", "seat v=2"]
    jobs.run(spark, "audit", store, out, fmt="csv")
    found = spark.read.option("header", True).csv(f"{out}/audit")
    assert found.filter("bad_rows <> '0'").count() == 0 and found.count() > 100


def test_a_refresh_that_stops_half_way_changes_nothing(air, spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    for name, df in air.items():
        write_version(df, f"{store}/{name}")
    real = sinks.write_version

    def stops(df, path):
        if path.endswith("/orders"):
            raise RuntimeError("lost")
        return real(df, path)

    monkeypatch.setattr(sinks, "write_version", stops)
    with pytest.raises(RuntimeError):
        jobs.run(spark, "refresh", store, as_of=AS_OF)
    monkeypatch.undo()
    seen = scan_tables(spark, store)
    for name in ("flight", "seat", "orders"):
        assert seen[name].exceptAll(air[name]).count() == 0 and seen[name].count() == air[name].count()
    jobs.run(spark, "refresh", store, as_of=AS_OF)
    assert manifest(spark, store)["orders"] == 2
    assert scan_tables(spark, store)["flight"].filter("flight_status = 'Completed'").count() == 21
