"""Column functions."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tarmaq.functions import scalars as S


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column.alias("x")).collect()[0].x


def test_time(spark):
    assert one(spark, S.takeoff("d", "t"), d="2025-08-05", t="07:30:00") == datetime(
        2025, 8, 5, 7, 30)
    ts = S.moment("2025-08-31 23:59:59")
    assert one(spark, S.month_text(S.month_start(ts))) == "2025-08"
    assert one(spark, S.day_text(S.plus_minutes(ts, 1))) == "2025-09-01"
    assert one(spark, S.clock_text(S.plus_hours(ts, -36))) == "11:59:59"
    assert one(spark, S.moment_text(ts)) == "2025-08-31 23:59:59"


def test_days(spark):
    for text, want in (("2024-02-29", date(2024, 2, 29)), ("2023-02-29", None), ("x", None),
                       ("2024-2-9", date(2024, 2, 9)), (" 2024-02-09 ", date(2024, 2, 9))):
        assert one(spark, S.parse_day("t"), t=text) == want


def test_numbers(spark):
    def pct(n, d, digits=2):
        got = one(spark, S.percent(F.lit(n), F.lit(d), digits))
        return None if got is None else str(got)
    assert pct(1, 3) == "33.33" and pct(1, 800) == "0.13" and pct(3, 0) is None
    assert pct(1, 16, 1) == "6.3"
    assert str(one(spark, S.hours_of(F.lit(590)))) == "9.83"


def test_text(spark):
    assert one(spark, S.clean_email("e"), e="  Ab@C.Org ") == "ab@c.org"
    assert one(spark, S.clean_code("e"), e=" f1001 ") == "F1001"
    assert one(spark, S.clean_phone("p"), p=" 03 - 12 3 ") == "03-123"
    assert one(spark, S.route_label("a", "b"), a="X", b="Y") == "X → Y"
    assert one(spark, S.route_label("a", F.lit(None)), a="X") is None
    assert one(spark, S.route_path("a", F.lit(None)), a="X") == "X"
    assert one(spark, S.route_path(F.lit(None), F.lit(None))) == ""


def test_names(spark):
    for full, first, last in (("Ann", "Ann", ""), ("Ann Lee", "Ann", "Lee"),
                              ("  Ann  van  Lee ", "Ann", "van Lee")):
        assert one(spark, S.first_name("n"), n=full) == first
        assert one(spark, S.last_name("n"), n=full) == last


def test_seats(spark):
    assert one(spark, S.seat_label(F.lit(12), F.lit(3))) == "12C"
    assert one(spark, S.seat_label(F.lit(1), F.lit(26))) == "1Z"
    assert one(spark, S.seat_label(F.lit(1), F.lit(27))) == "1-27"
    assert one(spark, S.seat_row(S.seat_code(F.lit(4), F.lit(5)))) == 4
    assert one(spark, S.seat_column("c"), c="4-5") == 5
    df = spark.createDataFrame([(10, 1), (2, 27), (2, 3), (2, 3)], "r int, c int")
    assert df.agg(S.seat_list("r", "c").alias("x")).collect()[0].x == "2C, 2-27, 10A"
    ranked = spark.createDataFrame([("Economy",), ("Business",), ("Other",)], "c string")
    assert [r.c for r in ranked.orderBy(S.class_rank("c")).collect()] == [
        "Business", "Economy", "Other"]
