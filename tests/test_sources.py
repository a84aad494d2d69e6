"""Scans, versions, reports, catalog."""

import json
import os

import pytest

from tarmaq import session
from tarmaq.plans import seating
from tarmaq.schemas import schema_of
from tarmaq.sources import catalog, scans, sinks


def test_versions(air, spark, tmp_path):
    path = str(tmp_path / "flight")
    assert scans.scan_version(spark, path, schema_of("flight")).count() == 0
    assert sinks.write_version(air["flight"], path) == 1
    newer = scans.scan_version(spark, path, schema_of("flight")).limit(3)
    assert sinks.write_version(newer, path) == 2
    assert scans.scan_version(spark, path, schema_of("flight")).count() == 3
    assert scans.scan_version(spark, path, schema_of("flight"), 1).count() == 33
    os.makedirs(f"{path}/v=3")  # an aborted write has no success marker
    assert scans.versions(spark, path) == [1, 2]


def test_scan_reads_only_named_columns(spark):
    df = scans.scan(spark, "/root/testdata/sf0.001", "part", ["p_partkey"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint>" in plan


def test_append_is_repeatable(air, spark, tmp_path):
    path = str(tmp_path / "seat.parquet")
    seats = seating.seats_from_layout(air["flight"], air["cabin_class"])
    seats.limit(0).write.parquet(path)
    for _ in range(2):
        existing = spark.read.schema(schema_of("seat")).parquet(path)
        sinks.append_new(seats, existing, path, ["flight_id", "s_row", "s_column"])
    assert spark.read.parquet(path).count() == 1940


def test_one_writer_appends_at_a_time(air, spark, tmp_path):
    path = str(tmp_path / "plane.parquet")
    air["plane"].limit(0).write.parquet(path)
    with sinks.exclusive(spark, path):
        with pytest.raises(RuntimeError, match="another job"):
            sinks.append_new(air["plane"], air["plane"].limit(0), path, ["plane_id"])
    assert spark.read.parquet(path).count() == 0
    sinks.append_new(air["plane"], air["plane"].limit(0), path, ["plane_id"])  # the lock is gone
    assert spark.read.parquet(path).count() == 6 and os.listdir(tmp_path) == ["plane.parquet"]


def test_merged_profiles(spark):
    """Parts sketched one by one give the exact counts and bounds, and estimates within their error."""
    whole = spark.range(30_000).selectExpr("id AS n", "CAST(id % 997 AS STRING) AS t", "IF(id % 10 = 0, NULL, id / 7.0) AS x",
                                           "TIMESTAMP_NTZ'2026-01-01' + make_dt_interval(0, 0, id) AS ts")
    parts = [whole.filter(f"n % 4 = {k}") for k in range(4)] + [whole.limit(0)]
    sketched = catalog.sketched(parts[0], "t")
    for part in parts[1:]:
        sketched = sketched.unionByName(catalog.sketched(part, "t"))
    got = {r["column_name"]: r for r in catalog.estimated(catalog.merged_profiles(sketched)).collect()}
    assert {c: (r["row_count"], r["null_count"]) for c, r in got.items()} == {
        "n": (30_000, 0), "t": (30_000, 0), "x": (30_000, 3000), "ts": (30_000, 0)}
    assert (got["n"]["min_number"], got["n"]["max_number"]) == (0, 29_999)
    assert (got["t"]["min_text"], got["t"]["max_text"], got["t"]["q50"]) == ("0", "996", None)
    assert got["ts"]["max_number"] - got["ts"]["min_number"] == 29_999 * 60_000_000
    for column, distinct in (("n", 30_000), ("t", 997), ("x", 27_000), ("ts", 30_000)):
        assert abs(got[column]["distinct_estimate"] - distinct) <= .03 * distinct
    for share in (25, 50, 75):  # three times the sketch's rank error
        assert abs(got["n"][f"q{share}"] / 30_000 - share / 100) < .02


def test_profile_of_nothing(spark):
    empty = spark.createDataFrame([], "a int, b string")
    got = catalog.estimated(catalog.merged_profiles(catalog.sketched(empty, "e"))).collect()
    assert {(r["column_name"], r["row_count"], r["distinct_estimate"], r["q50"]) for r in got} == {
        ("a", 0, 0, None), ("b", 0, 0, None)}
    assert catalog.nullable_columns(empty, "e").count() == 2


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_report_round_trip(air, spark, tmp_path, fmt):
    report = air["flight"].groupBy("flight_status").count()
    target = sinks.write_report(report, str(tmp_path), "by_status", fmt)
    back = spark.read.option("header", True).format(fmt).load(target)
    assert back.count() == 4
    assert [f for f in os.listdir(target) if f.startswith("part-")]


def test_catalog(air, spark):
    declared = catalog.declared_columns(air["orders"], "orders", nullable_only=True)
    assert {r.column_name for r in declared.collect()} == {"guest_email", "reg_customer_email"}
    seen = {r.column_name: r for r in catalog.profile(air["orders"], "orders", "exact").collect()}
    assert seen["guest_email"].null_count == 110 and seen["guest_email"].distinct_count == 10
    assert seen["order_id"].min_value == "O0001" and seen["order_id"].distinct_count == 220
    rough = {r.column_name: r for r in catalog.profile(air["orders"], "orders", "approx").collect()}
    assert abs(rough["order_id"].distinct_count - 220) < 25


def test_layout_map(air):
    maps = {r.plane_id: json.loads(r.layout_json)
            for r in catalog.layout_map(air["cabin_class"]).collect()}
    assert maps["P0001"] == {"Business": {"rows": 8, "cols": 4}, "Economy": {"rows": 6, "cols": 6}}
    assert list(maps["P0001"]) == ["Business", "Economy"] and len(maps) == 6


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == named
    assert session.run_dir(spark, "x").startswith(named)


def test_bucketed_facts_join_without_a_shuffle(air, spark, tmp_path):
    stored = {name: sinks.write_bucketed(air[name], f"bucketed_{name}", str(tmp_path / name),
                                         "flight_id", 4) for name in ("flight", "seat")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stored["seat"].join(stored["flight"].select("flight_id", "flight_status"),
                                     "flight_id").groupBy("flight_id").count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 33
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in stored:
            spark.sql(f"DROP TABLE bucketed_{name}")
