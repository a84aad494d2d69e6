"""Golden values of the management reports."""

from collections import Counter
from decimal import Decimal as D

from pyspark.sql import functions as F

from airline import AS_OF
from tarmaq.functions.scalars import percent
from tarmaq.plans import datasets, reports, seating, transitions
from tarmaq.sources.sinks import colocate


def occupancy(air):
    tally = reports.seat_tally(air["seat"], air["orders"])
    return tally.select("flight_id", percent(F.col("kept"), F.col("seats"), 12)
                        .alias("occupancy_pct"))


def test_seed_counts(air):
    assert Counter(r.flight_status for r in air["flight"].collect()) == {
        "Completed": 17, "Full": 5, "Scheduled": 9, "Cancelled": 2}
    assert Counter(r.order_status for r in air["orders"].collect()) == {
        "Completed": 161, "Active": 36, "Cancelled by customer": 13, "Cancelled by system": 10}
    held = air["seat"].filter("order_id is not null")
    assert air["seat"].count() == 1940
    assert held.count() == 753
    assert held.select("order_id").distinct().count() == 195


def test_start_rows(air, rows):
    started = seating.start_rows(air["cabin_class"]).filter("class_type = 'Economy'")
    assert rows(started, "plane_id", "start_row") == [
        ("P0001", 9), ("P0002", 6), ("P0003", 1), ("P0004", 9), ("P0005", 1), ("P0006", 5)]
    grid = seating.seat_grid(seating.start_rows(air["cabin_class"]))
    assert rows(grid.groupBy("plane_id").count()) == [
        ("P0001", 68), ("P0002", 62), ("P0003", 40), ("P0004", 68), ("P0005", 36), ("P0006", 68)]


def test_average_occupancy(air):
    tally = reports.seat_tally(air["seat"], air["orders"])
    got = reports.average_occupancy(air["flight"], tally).collect()
    assert [r.avg_seat_occupancy_pct for r in got] == [D("29.85")]
    per_flight = reports.occupancy_by_flight(air["flight"], tally)
    assert per_flight.count() == 17


REVENUE = [
    ("Large", "Airbus", "Business", D("330250.00")), ("Large", "Airbus", "Economy", D("121080.00")),
    ("Large", "Boeing", "Business", D("182000.00")), ("Large", "Boeing", "Economy", D("39600.00")),
    ("Large", "Dassault", "Business", D("239800.00")),
    ("Large", "Dassault", "Economy", D("18000.00")),
    ("Small", "Airbus", "Economy", D("24520.00")), ("Small", "Dassault", "Economy", D("43080.00"))]


def test_revenue_by_class(air, rows):
    lines = reports.priced_lines(air["seat"], air["orders"], air["flight"], air["plane"],
                                 air["pricing"])
    assert rows(reports.revenue_by_class(lines)) == REVENUE


def test_revenue_from_the_sale_fact_keeps_fees(air, rows):
    fact = reports.order_line_fact(air["seat"], air["pricing"])
    same = reports.fact_lines(fact, air["orders"], air["flight"], air["plane"])
    assert rows(reports.revenue_by_class(same)) == REVENUE

    # A customer cancels all of F1005 (12 seats at 400): 5 % stays.
    cancelled = air["orders"].withColumn("order_status", F.when(
        (F.col("flight_id") == "F1005") & (F.col("order_status") == "Active"),
        "Cancelled by customer").otherwise(F.col("order_status")))
    later = reports.fact_lines(fact, cancelled, air["flight"], air["plane"])
    got = dict(((r[0], r[1], r[2]), r[3]) for r in rows(reports.revenue_by_class(later)))
    assert got[("Small", "Airbus", "Economy")] == D("24520.00") - 12 * 400 + 12 * 20


def test_fee_on_half_cents(spark, rows):
    lines = spark.createDataFrame(
        [("Full", "Cancelled by customer", D("10.10")), ("Full", "Cancelled by customer", D("0.30")),
         ("Full", "Cancelled by system", D("99.00")), ("Cancelled", "Active", D("50.00"))],
        "flight_status string, order_status string, amount decimal(18,2)").withColumn(
        "k", F.lit("x"))
    assert rows(reports.revenue_by_class(lines, keys=("k",))) == [("x", D("0.52"))]


def test_staff_hours(air):
    people = air["pilot"].select("employee_id").unionByName(
        air["attendant"].select("employee_id"))
    links = air["pilot_flight"].unionByName(air["attendant_flight"])
    flown = reports.completed_minutes(air["flight"], air["route"])
    got = Counter((r.long_flight_hours, r.short_flight_hours)
                  for r in reports.staff_hours(people, links, flown).collect())
    assert got == {(D("0.00"), D("9.83")): 5, (D("45.00"), D("8.33")): 9,
                   (D("57.00"), D("3.17")): 9, (D("0.00"), D("0.00")): 7}


def test_cancel_rate(air, rows):
    want = [("2025-03", 2, D("0.00")), ("2025-04", 4, D("25.00")), ("2025-05", 3, D("33.33")),
            ("2025-06", 22, D("13.64")), ("2025-07", 96, D("6.25")), ("2025-08", 50, D("2.00")),
            ("2025-09", 30, D("0.00")), ("2025-10", 13, D("7.69"))]
    assert rows(reports.cancel_rate_by_month(air["orders"])) == want
    assert rows(reports.cancel_rate_by_month(air["orders"], exclude=())) == want


def test_fleet_monthly(air, rows):
    got = rows(reports.fleet_monthly(air["flight"], air["route"], occupancy(air), AS_OF))
    assert got == [
        ("P0002", "2025-11", 5, 1, D("16.67"), "CDG -> BER"),
        ("P0003", "2025-08", 2, 0, D("6.67"), "FCO -> CDG"),
        ("P0003", "2025-09", 3, 0, D("10.00"), "CDG -> BER"),
        ("P0004", "2025-10", 6, 0, D("20.00"), "CDG -> BER"),
        ("P0006", "2026-01", 5, 0, D("16.67"), "DXB -> SYD")]


def test_completed_by_month(air, rows):
    want = [("2025-08", 2), ("2025-09", 2), ("2025-10", 5), ("2025-11", 4), ("2026-01", 4)]
    assert rows(reports.completed_by_month(air["flight"])) == want
    assert rows(reports.completed_by_month(air["flight"], AS_OF)) == want
    refreshed = transitions.refresh_status(air["flight"], AS_OF)
    assert sum(r[1] for r in rows(reports.completed_by_month(refreshed))) == 21


def test_top_routes(air, rows):
    per_route = reports.completed_per_route(air["flight"], air["route"], AS_OF)
    top = [tuple(r) for r in reports.top_routes(per_route).collect()]
    assert top == [("BER → JFK", 2), ("CDG → BER", 2), ("DXB → CDG", 2), ("DXB → SYD", 2),
                   ("FCO → CDG", 2)]


def test_flights_by_hour(air, rows):
    assert rows(reports.flights_by_hour(air["flight"], AS_OF)) == sorted(
        [(7, 5), (8, 1), (9, 5), (10, 1), (11, 3), (12, 2), (14, 1), (16, 1), (22, 2)], key=repr)


def test_kpis_and_counts(air, rows):
    assert rows(reports.kpi_counts({"planes": air["plane"], "routes": air["route"],
                                    "flights": air["flight"]})) == [
        ("flights", 33), ("planes", 6), ("routes", 14)]
    made = reports.seats_per_flight(air["flight"], air["seat"].filter("flight_id <> 'F1001'"),
                                    ["flight_id", "plane_id"])
    assert dict((r.flight_id, r.seats_created) for r in made.collect())["F1001"] == 0
    taken = reports.occupancy_counts(air["seat"], "flight_id", F.col("order_id").isNotNull())
    full = {r.flight_id: r.occ_percent for r in taken.collect()}
    assert full["F1003"] == D("100.0") and full["F1014"] == D("0.0")


def test_empty_inputs_give_empty_reports(air):
    none = air["orders"].limit(0)
    assert reports.cancel_rate_by_month(none).count() == 0
    no_flights = air["flight"].limit(0)
    assert reports.fleet_monthly(no_flights, air["route"], occupancy(air), AS_OF).count() == 0


def test_endpoints(air):
    assert datasets.route_endpoints(air["route"]).count() == 9


def test_sales_by_flight_need_no_shuffle_by_flight(air, spark, rows, tmp_path):
    kept = colocate({"sales": reports.sales(air["seat"], air["orders"], air["pricing"]), "flown": air["flight"]},
                    str(tmp_path), "flight_id", 4)
    revenue = reports.revenue_by_class(reports.sale_lines(kept["sales"], kept["flown"], air["plane"]))
    occupancy_ = reports.sale_tally(kept["sales"]).join(kept["flown"].select("flight_id", "flight_status"), "flight_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for report in (revenue, occupancy_):
            assert "hashpartitioning(flight_id" not in report._jdf.queryExecution().executedPlan().toString()
        lines = reports.priced_lines(air["seat"], air["orders"], air["flight"], air["plane"], air["pricing"])
        assert rows(revenue) == rows(reports.revenue_by_class(lines)) and revenue.count() == 8
        assert rows(occupancy_, "flight_id", "seats", "kept") == rows(
            reports.seat_tally(air["seat"], air["orders"]), "flight_id", "seats", "kept")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
