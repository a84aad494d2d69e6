"""Scheduling checks on the airline tables and on made-up clashes."""

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tarmaq.plans import scheduling as C

START = datetime(2026, 5, 1, 8)
FLIGHT = ("flight_id string, plane_id string, minutes int, start_ts timestamp_ntz, "
          "end_ts timestamp_ntz, flight_status string")


def flight(ident, hours, minutes, plane="P1", status="Scheduled"):
    start = START + timedelta(hours=hours)
    return (ident, plane, minutes, start, start + timedelta(minutes=minutes), status)


def test_long_boundary(spark, rows):
    df = spark.createDataFrame([(359,), (360,), (361,)], "minutes int")
    assert rows(C.flight_length(df)) == [(359, "short"), (360, "long"), (361, "long")]


def test_crew_size_violations(air):
    links = (air["pilot_flight"].withColumn("role", F.lit("pilot"))
             .unionByName(air["attendant_flight"].withColumn("role", F.lit("attendant"))))
    broken = C.crew_size_violations(C.timed(air["flight"], air["route"]), links)
    assert {r.flight_id for r in broken.collect()} == {
        "F1009", "F1013", "F1015", "F1016", "F1017", "F1019", "F1023", "F1025", "F1031"}
    alone = C.crew_size_violations(C.timed(air["flight"], air["route"]), links.limit(0))
    assert alone.count() == 2 * 33  # no crew at all breaks both roles


def test_seed_schedule_has_no_clashes(air):
    timed = C.timed(air["flight"], air["route"])
    assert C.vehicle_clashes(timed).filter("first_clash is not null").count() == 0
    broken = C.schedule_violations(timed, air["plane"], air["cabin_class"], air["pricing"],
                                   air["pilot"], air["attendant"], air["pilot_flight"],
                                   air["attendant_flight"])
    rules = Counter((r.flight_id, r.rule) for r in broken.collect())
    assert rules == {(f, "crew size"): 2 for f in ("F1017", "F1019", "F1025", "F1031")}


def test_long_trained_and_large(air):
    assert air["pilot"].filter("long_flight_training").count() == 7
    assert air["attendant"].filter("long_flight_training").count() == 12
    assert air["plane"].filter("plane_size = 'Large'").count() == 4


def test_missing_prices(air, rows):
    sold = air["flight"].select("flight_id", "plane_id").join(air["cabin_class"], "plane_id")
    gaps = C.missing_prices(sold, air["pricing"], ("flight_id", "plane_id", "class_type"))
    assert rows(gaps, "flight_id", "class_type") == [("F1030", "Business"), ("F1030", "Economy")]


def test_assignments(spark):
    flights = spark.createDataFrame([
        flight("A", 0, 360), flight("B", 5, 60), flight("C", 6, 60), flight("D", 6.5, 30)], FLIGHT)
    links = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "x"), ("A", "y"), ("D", "z"),
                                   ("C", "z"), ("B", "stranger")], "flight_id string, employee_id string")
    pool = spark.createDataFrame([("x", False), ("y", True), ("z", False)],
                                 "employee_id string, long_flight_training boolean")
    checked = C.check_assignments(links, C.open_flights(flights), pool, ["employee_id"],
                                  "long_flight_training")
    got = {(r.flight_id, r.employee_id): (r.qualified, r.clashes, r.eligible)
           for r in checked.collect()}
    assert got == {("A", "x"): (False, 1, False), ("B", "x"): (True, 1, False),
                   ("C", "x"): (True, 0, True), ("A", "y"): (True, 0, True),
                   ("D", "z"): (True, 1, False), ("C", "z"): (True, 1, False),
                   ("B", "stranger"): (False, 0, False)}


def test_available_for_one_flight(air):
    timed = C.timed(air["flight"], air["route"])
    at = "2026-02-07 10:00:00"  # F1032 (far crew) is in the air
    short = C.available_for(air["pilot"], air["pilot_flight"], timed, "employee_id",
                            "long_flight_training", at, 120)
    assert short.count() == 7
    long = C.available_for(air["pilot"], air["pilot_flight"], timed, "employee_id",
                           "long_flight_training", at, 360)
    assert long.count() == 4
    planes = air["plane"].withColumn("large", F.col("plane_size") == "Large")
    links = air["flight"].select("flight_id", "plane_id")
    fit = C.available_for(planes, links, timed, "plane_id", "large", at, 500)
    assert {r.plane_id for r in fit.collect()} == {"P0001", "P0002", "P0004"}


def test_cancelled_flights_do_not_block(spark):
    flights = spark.createDataFrame([flight("A", 0, 120), flight("B", 1, 120, status="Cancelled"),
                                     flight("C", 1, 60, status="Full"), flight("D", 2, 60)], FLIGHT)
    found = {r.flight_id: r.first_clash for r in C.vehicle_clashes(flights).collect()}
    assert found == {"A": "C", "C": "A", "D": None}
