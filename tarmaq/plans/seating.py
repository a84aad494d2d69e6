"""Cabin layouts and the seats generated from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmaq.functions.scalars import class_rank
from tarmaq.operators.relations import not_existing


def start_rows(cabins: DataFrame, rank: Column | None = None) -> DataFrame:
    """First and last row of each cabin: numbering runs on over a plane's cabins.

    A plane has a handful of cabins, so the window groups are tiny.
    """
    order = class_rank("class_type") if rank is None else rank
    before = (Window.partitionBy("plane_id").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.lit(1) + F.coalesce(F.sum("rows_num").over(before), F.lit(0))
    return (cabins.withColumn("start_row", start.cast("int"))
            .withColumn("end_row", (F.col("start_row") + F.col("rows_num") - 1).cast("int")))


def _with_seats(started: DataFrame) -> DataFrame:
    """Cabins of one seat or more; sequence() would count down for the others."""
    return started.filter((F.col("rows_num") > 0) & (F.col("columns_num") > 0))


def seat_grid(started: DataFrame) -> DataFrame:
    """Every (row, column) of every cabin, by exploding two sequences."""
    rows = _with_seats(started).select("plane_id", "class_type", "columns_num",
                          F.explode(F.sequence("start_row", "end_row")).alias("s_row"))
    return rows.select("plane_id", "class_type", "s_row",
                       F.explode(F.sequence(F.lit(1), F.col("columns_num"))).alias("s_column"))


def seats_from_layout(flights: DataFrame, cabins: DataFrame, existing: DataFrame | None = None,
                      rank: Column | None = None) -> DataFrame:
    """Free seats of every flight from its plane's cabins, less those that exist.

    The flights meet the few cabin rows first and are exploded afterwards, so
    the shuffle carries flights, not seats.
    """
    cabined = (flights.select("flight_id", "plane_id")
               .join(_with_seats(start_rows(cabins, rank)), "plane_id"))
    rows = cabined.select("flight_id", "plane_id", "class_type", "columns_num",
                          F.explode(F.sequence("start_row", "end_row")).alias("s_row"))
    seats = rows.select("flight_id", "s_row",
                        F.explode(F.sequence(F.lit(1), F.col("columns_num"))).alias("s_column"),
                        "plane_id", "class_type", F.lit(None).cast("string").alias("order_id"))
    if existing is None:
        return seats
    return not_existing(seats, existing, ["flight_id", "s_row", "s_column"])


def rebuild_seats(seats: DataFrame, flights: DataFrame, cabins: DataFrame, rank: Column | None = None) -> DataFrame:
    """Replace all seats of the given flights; a plane without Economy makes none."""
    economy = cabins.filter(F.col("class_type") == "Economy").select("plane_id").distinct()
    sound = flights.join(economy, "plane_id", "left_semi")
    others = not_existing(seats, sound, ["flight_id"])
    return others.unionByName(seats_from_layout(sound, cabins, rank=rank).select(*seats.columns))
