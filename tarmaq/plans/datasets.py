"""Derived datasets: the look-ups of a booking site as whole-table frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmaq import params as P
from tarmaq.functions.predicates import all_of, equals, on_day
from tarmaq.functions.scalars import (clock_text, day_text, money, moment, plus_hours,
                                      plus_minutes, seat_list)
from tarmaq.operators.relations import distinct_union, lookup_default


def with_landing(flights: DataFrame, minutes: str = "flight_duration") -> DataFrame:
    """Add landing instant, date and time."""
    landing = plus_minutes("takeoff_ts", F.col(minutes))
    return (flights.withColumn("landing_ts", landing)
            .withColumns({"landing_date": day_text("landing_ts"),
                          "landing_time": clock_text("landing_ts")}))


def from_price(flights: DataFrame, prices: DataFrame, class_type: str = "Economy",
               keys: tuple[str, ...] = ("flight_id", "plane_id")) -> DataFrame:
    """Lowest price of a class per flight; NULL when the flight has none."""
    lowest = (prices.filter(F.col("class_type") == class_type)
              .groupBy(*keys).agg(F.min("price").alias("from_price")))
    return flights.join(lowest, list(keys), "left")


def flight_search(flights: DataFrame, prices: DataFrame, date: str | None = None,
                  origin: str | None = None, destination: str | None = None,
                  class_type: str = "Economy",
                  keys: tuple[str, ...] = ("flight_id", "plane_id")) -> DataFrame:
    """Bookable flights (already joined to their route) with landing and lowest price."""
    wanted = flights.filter(all_of(
        equals("flight_status", P.SCHEDULED),
        on_day("takeoff_ts", date),
        equals("origin_airport", origin),
        equals("destination_airport", destination)))
    return from_price(with_landing(wanted), prices, class_type, keys)


def flight_listing(flights: DataFrame, as_of: str, flight_id: str | None = None,
                   status: str | None = None, date: str | None = None,
                   n: int = P.LISTING_ROWS) -> DataFrame:
    """The newest n flights with their landing and a 72-hour cancel flag."""
    wanted = flights.filter(all_of(
        equals("flight_id", flight_id), equals("flight_status", status),
        on_day("takeoff_ts", date)))
    newest = wanted.orderBy(F.desc("takeoff_ts"), F.asc("flight_id")).limit(n)
    return with_landing(newest).withColumn(
        "can_cancel", F.col("takeoff_ts") >= plus_hours(moment(as_of), P.FLIGHT_CANCEL_HOURS))


def free_seats(seats: DataFrame, free: Column | None = None) -> DataFrame:
    """Free seats per flight and class (only where there are any)."""
    is_free = F.col("order_id").isNull() if free is None else free
    return (seats.filter(is_free).groupBy("flight_id", "class_type")
            .agg(F.count(F.lit(1)).alias("available")))


def cabin_offer(flights: DataFrame, cabins: DataFrame, prices: DataFrame,
                seats: DataFrame | None = None,
                keys: tuple[str, ...] = ("flight_id", "plane_id", "class_type")) -> DataFrame:
    """Per flight and cabin: layout, price (or NULL) and free seats (or 0).

    Without ``seats``, the prices (unique by ``keys``) say how many are available.
    """
    offer = (flights.select("flight_id", "plane_id").join(cabins, "plane_id")
             .join(prices, list(keys), "left"))
    if seats is None:
        return offer.withColumn("available", F.coalesce("available", F.lit(0)))
    return lookup_default(offer, free_seats(seats), ["flight_id", "class_type"],
                          {"available": 0})


def seat_map(seats: DataFrame, class_type: str | None = None) -> DataFrame:
    """Every seat with a taken flag."""
    return (seats.filter(all_of(equals("class_type", class_type)))
            .select("flight_id", "class_type", "s_row", "s_column",
                    F.col("order_id").isNotNull().alias("is_taken")))


def order_totals(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Total price per order, 0 when it holds nothing. Lines fold before the join."""
    summed = lines.groupBy("order_id").agg(F.sum("price").alias("total"))
    return lookup_default(orders, summed, ["order_id"], {}).withColumn(
        "total", F.coalesce(money("total"), money(F.lit(0))))


def order_lines(seats: DataFrame, prices: DataFrame) -> DataFrame:
    """Held seats with their class price, NULL where the class has none."""
    return (seats.filter(F.col("order_id").isNotNull())
            .join(prices, ["flight_id", "plane_id", "class_type"], "left"))


def order_summary(orders: DataFrame, flights: DataFrame, lines: DataFrame) -> DataFrame:
    """Per order: flight, route, landing, seat list and total.

    ``lines``: order_id, s_row, s_column, price. One aggregate makes list and
    total, and only orders (not lines) meet the flights.
    """
    held = lines.groupBy("order_id").agg(seat_list("s_row", "s_column").alias("seats"),
                                         F.sum("price").alias("total"))
    return (with_landing(orders.join(flights, "flight_id"))
            .join(held, "order_id", "left")
            .withColumns({"seats": F.coalesce("seats", F.lit("")),
                          "total": F.coalesce(money("total"), money(F.lit(0)))}))


def purchase_history(orders: DataFrame, lines: DataFrame, owner: str,
                     status: str | None = None, n: int = P.HISTORY_ROWS) -> DataFrame:
    """The newest n orders of every owner with seat count and total.

    The rank filter is applied per map task first (a window group limit), so an
    owner with a third of all orders sends at most n rows per task. Only the
    surviving orders meet their lines.
    """
    shown = orders.filter(all_of(~F.col("order_status").isin(P.PENDING),
                                 equals("order_status", status)))
    newest = Window.partitionBy(owner).orderBy(F.desc("date_of_purchase"), F.asc("order_id"))
    recent = (shown.withColumn("position", F.row_number().over(newest))
              .filter(F.col("position") <= n))
    summed = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("seats_count"),
                                           F.sum("price").alias("total"))
    return (recent.join(summed, "order_id", "left")
            .withColumns({"seats_count": F.coalesce("seats_count", F.lit(0)),
                          "total": F.coalesce(money("total"), money(F.lit(0)))}))


def contact_list(people: DataFrame, phones: DataFrame, key: str, phone: str) -> DataFrame:
    """Every person with the sorted list of distinct phones ('' when none)."""
    listed = phones.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_set(phone)), ", ").alias("phones"))
    return people.join(listed, key, "left").withColumn("phones", F.coalesce("phones", F.lit("")))


def route_endpoints(routes: DataFrame) -> DataFrame:
    return distinct_union([(routes, "origin_airport"), (routes, "destination_airport")],
                          "airport")
