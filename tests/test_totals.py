"""Totals by signed changes against full counts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarmaq import jobs
from tarmaq import params as P
from tarmaq.plans import flows, reports
from tarmaq.plans import totals as X
from tarmaq.sources.sinks import publish
from tarmaq.streaming import read_files
from tarmaq.streaming.totals import drain_totals

BASE = datetime(2026, 1, 30, 22)
ORDER = "order_id string, date_of_purchase timestamp_ntz, order_status string"
CHANGE = "order_id string, old_date timestamp_ntz, old_status string, new_date timestamp_ntz, new_status string"


def versions(seed, count=6, orders=80):
    """Versions of an order table: orders come, change status, move (paid later) and go."""
    draw, table, out = random.Random(seed), {}, []
    for _ in range(count):
        for _ in range(orders // 3):
            name = f"O{draw.randrange(orders)}"
            if draw.random() < .15:
                table.pop(name, None)
            else:
                when = None if draw.random() < .05 else BASE + timedelta(minutes=draw.randrange(9000))
                old = table.get(name)
                table[name] = (old[0] if old and draw.random() < .7 else when, draw.choice(P.ORDER_STATUSES))
        out.append(dict(table))
    return out


def frame(spark, table):
    return spark.createDataFrame([(k, *v) for k, v in table.items()], ORDER)


@pytest.mark.parametrize("unit", ["hour", "day", "month"])
def test_folded_changes_equal_the_full_count(spark, rows, unit):
    tables = [frame(spark, t) for t in versions(len(unit))]
    totals = X.booking_totals(tables[0], unit)
    for before, after in zip(tables, tables[1:]):
        totals = X.fold(totals, X.signed(X.order_changes(before, after), unit))
    want = rows(X.booking_totals(tables[-1], unit), "period", "order_status", "n")
    assert rows(totals, "period", "order_status", "n") == want and len(want) > 5


def test_nothing_changed(spark):
    table = frame(spark, versions(1)[-1])
    assert X.order_changes(table, table).count() == 0
    assert X.fold(X.booking_totals(table), X.signed(X.order_changes(table, table.limit(0)))).count() == 0


def test_a_cancellation_moves_a_booking(spark, air, rows):
    """After customers cancel, the totals follow from the touched orders alone."""
    active = air["orders"].filter(F.col("order_status") == P.ACTIVE).limit(9)
    asked = active.select("order_id", F.coalesce("guest_email", "reg_customer_email").alias("email"))
    after = flows.cancel_orders(air, asked, "2026-01-01 00:00:00")
    touched = after["decisions"].select("order_id")
    changes = X.order_changes(air["orders"].join(touched, "order_id", "left_semi"),
                              after["orders"].join(touched, "order_id", "left_semi"))
    got = X.fold(X.booking_totals(air["orders"], "month"), X.signed(changes, "month"))
    assert changes.count() > 0
    assert rows(got, "period", "order_status", "n") == rows(X.booking_totals(after["orders"], "month"), "period", "order_status", "n")
    for exclude in ((P.PENDING,), ()):
        assert rows(X.cancel_rate(got, exclude)) == rows(reports.cancel_rate_by_month(after["orders"], exclude))


def test_stream_of_changes(spark, rows, tmp_path):
    tables = [frame(spark, t) for t in versions(5, count=5)]
    folder, target = str(tmp_path / "changes"), str(tmp_path / "target")
    schema = spark.createDataFrame([], CHANGE).schema
    for k, (before, after) in enumerate(zip(tables, tables[1:])):
        X.order_changes(before, after).coalesce(1).write.mode("append").parquet(folder)
        if k % 2:  # a run over two files, and later one over the next two
            stream = read_files(spark, folder, schema, files_per_trigger=1)
            got = drain_totals(stream, target, "day", X.booking_totals(tables[0], "day"))
            assert rows(got) == rows(X.booking_totals(after, "day"), *got.columns)


def test_stream_without_a_start(spark, rows, tmp_path):
    table = frame(spark, versions(3)[-1])
    X.order_changes(table.limit(0), table).write.parquet(str(tmp_path / "changes"))
    stream = read_files(spark, str(tmp_path / "changes"), spark.createDataFrame([], CHANGE).schema)
    got = drain_totals(stream, str(tmp_path / "target"), "month")
    assert rows(got) == rows(X.booking_totals(table, "month"), *got.columns)


def test_job_follows_the_valid_version(spark, air, rows, tmp_path):
    store = str(tmp_path)
    assert jobs.run(spark, "totals", store)[0].endswith("v=0")  # no orders yet
    publish(spark, store, {"orders": air["orders"]})
    for changed in (None, air["orders"].withColumn("order_status", F.when(F.col("order_status") == P.ACTIVE, P.COMPLETED)
                                                   .otherwise(F.col("order_status")))):
        if changed is not None:
            publish(spark, store, {"orders": changed})
        want = rows(X.booking_totals(changed if changed is not None else air["orders"]), "period", "order_status", "n")
        for _ in range(2):  # a second run finds nothing to do
            path = jobs.run(spark, "totals", store)[0]
            assert rows(spark.read.parquet(path), "period", "order_status", "n") == want
