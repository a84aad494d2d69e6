"""Data-quality rules: clean tables pass, planted faults are counted."""

from datetime import date

from pyspark.sql import functions as F

from tarmaq.plans import quality as Q
from tarmaq.schemas import TABLES

AS_OF = "2026-02-01 00:00:00"


def bad(df):
    return {(r.table_name, r.rule): r.bad_rows for r in df.collect() if r.bad_rows}


def test_clean_tables_pass(air):
    assert bad(Q.audit(air)) == {}


def test_planted_faults(air, spark):
    orders = air["orders"]
    broken = dict(air)
    broken["orders"] = orders.unionByName(
        orders.limit(1).withColumn("flight_id", F.lit("F9999"))
        .withColumn("reg_customer_email", F.lit("m001@example.org"))
        .withColumn("guest_email", F.lit("g001@example.org"))
        .withColumn("order_status", F.lit("Lost")))
    broken["route"] = air["route"].unionByName(spark.createDataFrame(
        [(900, "TLV", "TLV", 0)], air["route"].schema))
    broken["pilot"] = air["pilot"].unionByName(air["attendant"].limit(1))
    broken["cabin_class"] = air["cabin_class"].filter("not (plane_id = 'P0001' and "
                                                      "class_type = 'Business')")
    found = bad(Q.audit(broken))
    assert found == {
        ("orders", "unique(order_id)"): 1, ("orders", "domain(order_status)"): 1,
        ("orders", "exactly_one(guest_email,reg_customer_email)"): 1,
        ("orders", "fk(flight_id->flight)"): 1,
        ("route", "positive_duration"): 1, ("route", "endpoints_differ"): 1,
        ("manager+pilot+attendant", "disjoint(employee_id)"): 1,
        ("plane", "large_needs_business"): 1,
        ("seat", "fk(plane_id,class_type->cabin_class)"): 4 * 32,
        ("pricing", "fk(plane_id,class_type->cabin_class)"): 4}


def test_reject_sets(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None)], "k int, fk string")
    parent = spark.createDataFrame([("a",)], "pk string")
    assert rows(Q.duplicate_keys(df, ["k"])) == [(1, 2)]
    assert rows(Q.orphans(df, ["fk"], parent, ["pk"]), "k") == [(2,)]


def test_contact_rules(spark):
    df = spark.createDataFrame([
        ("03-555 12", "1990-01-01", "123456789", "x", "7"),
        ("+972", "1899-12-31", "12345678", " ", "0"),
        ("", "2026-02-02", "12345678a", None, "-1"),
        (None, "31/12/1990", None, "y", "a"),
        ("5", "2026-02-01", "000000000", "z", "12")],
        "phone string, born string, staff string, city string, street string")
    rules = Q.contact_rules(AS_OF, phones=("phone",), days=("born",), staff_ids=("staff",),
                            needed=("city",), positive=("street",))
    assert bad(Q.check_rules(df, rules, "t")) == {
        ("t", "phone(phone)"): 3, ("t", "day(born)"): 3, ("t", "staff_id(staff)"): 3,
        ("t", "required(city)"): 2, ("t", "positive(street)"): 3}


def test_null_passes_a_check_but_not_a_not_null(spark):
    df = spark.createDataFrame([(None,), (1,), (-1,)], "v int")
    rules = {"positive": F.col("v") > 0} | Q.required("v")
    assert bad(Q.check_rules(df, rules, "t")) == {("t", "positive"): 1, ("t", "not_null(v)"): 1}


def test_every_table_is_declared(air):
    assert set(air) == set(TABLES) and len(TABLES) == 16
    assert air["plane"].schema["purchase_date"].dataType.typeName() == "date"
    assert isinstance(air["plane"].first().purchase_date, date)


def test_foreign_keys_both_ways(spark, rows):
    one = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (None, 5)], "k int, n int")
    other = spark.createDataFrame([(1,), (4,), (4,), (None,)], "p int")
    assert rows(Q.check_fk_both(one, ["k"], other, ["p"], "one", "other", "n")) == [
        ("one", "fk(k->other)", 1), ("other", "fk(p->one)", 2)]
    assert rows(Q.check_fk_both(one, ["k"], other, ["p"], "one", "other")) == [
        ("one", "fk(k->other)", 1), ("other", "fk(p->one)", 2)]
    assert rows(Q.check_fk(one, ["k"], other, ["p"], "one", "other", "n")) == [("one", "fk(k->other)", 1)]
    assert rows(Q.check_fk_both(one.limit(0), ["k"], other.limit(0), ["p"], "one", "other")) == [
        ("one", "fk(k->other)", 0), ("other", "fk(p->one)", 0)]
