"""Management reports. Money and ratios stay DECIMAL and are rounded last.

Facts are always folded to their grouping keys before they meet another big
table, so a hot flight, order or plane shrinks map-side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmaq import params as P
from tarmaq.functions.scalars import (flag, hours_of, moment, month_start, month_text, percent,
                                      route_label, route_path)


def is_kept(status: Column) -> Column:
    return ~status.isin(*P.VOID_ORDER)


def seat_tally(seats: DataFrame, orders: DataFrame) -> DataFrame:
    """Per flight: all seats, and the seats held by an order that still stands.

    Only held seats meet the orders; free seats (a NULL order) are counted
    without a join, so NULL never becomes a hot join key.
    """
    held = (seats.filter(F.col("order_id").isNotNull())
            .groupBy("flight_id", "order_id").agg(F.count(F.lit(1)).alias("n"))
            .join(orders.filter(is_kept(F.col("order_status"))).select("order_id"), "order_id")
            .groupBy("flight_id").agg(F.sum("n").alias("kept")))
    total = seats.groupBy("flight_id").agg(F.count(F.lit(1)).alias("seats"))
    return (total.join(held, "flight_id", "left")
            .withColumn("kept", F.coalesce("kept", F.lit(0))))


def occupancy_by_flight(flights: DataFrame, tally: DataFrame,
                        statuses: tuple[str, ...] = (P.COMPLETED,)) -> DataFrame:
    chosen = flights.filter(F.col("flight_status").isin(*statuses)).select("flight_id")
    return (tally.join(chosen, "flight_id")
            .select("flight_id", "seats", "kept",
                    percent(F.col("kept"), F.col("seats")).alias("occupancy_pct")))


def average_occupancy(flights: DataFrame, tally: DataFrame) -> DataFrame:
    """Unweighted mean over completed flights of the share of kept seats."""
    chosen = flights.filter(F.col("flight_status") == P.COMPLETED).select("flight_id")
    share = ((F.col("kept") * 100).cast("decimal(18,0)")
             / F.col("seats").cast("decimal(18,0)")).cast("decimal(20,12)")
    return (tally.join(chosen, "flight_id")
            .agg(F.round(F.sum(share) / F.count(F.lit(1)), 2).alias("avg_seat_occupancy_pct")))


def priced_lines(seats: DataFrame, orders: DataFrame, flights: DataFrame, planes: DataFrame,
                 prices: DataFrame) -> DataFrame:
    """Held seats as money: one row per order, flight and class."""
    counted = (seats.filter(F.col("order_id").isNotNull())
               .groupBy("order_id", "flight_id", "class_type")
               .agg(F.count(F.lit(1)).alias("seat_cnt")))
    return (counted
            .join(orders.select("order_id", "order_status"), "order_id")
            .join(flights.select("flight_id", "plane_id", "flight_status"), "flight_id")
            .join(prices, ["flight_id", "plane_id", "class_type"])
            .join(planes.select("plane_id", "plane_size", "plane_manufacturer"), "plane_id")
            .withColumn("amount", F.col("price") * F.col("seat_cnt")))


def earned(amount: Column, order_status: Column, fee=P.CANCEL_FEE) -> Column:
    """Full price when kept, the fee when the customer cancelled, else nothing."""
    return (F.when(is_kept(order_status), amount * F.lit(1).cast("decimal(3,2)"))
            .when(order_status == P.BY_CUSTOMER, amount * F.lit(fee).cast("decimal(3,2)"))
            .otherwise(F.lit(0).cast("decimal(3,2)")))


def revenue_by_class(lines: DataFrame, fee=P.CANCEL_FEE,
                     keys=("plane_size", "plane_manufacturer", "class_type")) -> DataFrame:
    """Revenue of lines (flight_status, order_status, amount and the keys)."""
    counted = lines.filter(F.col("flight_status").isin(P.SCHEDULED, P.COMPLETED, P.FULL))
    return (counted.groupBy(*keys)
            .agg(F.round(F.sum(earned(F.col("amount"), F.col("order_status"), fee)), 2)
                 .alias("total_revenue")))


def order_line_fact(seats: DataFrame, prices: DataFrame) -> DataFrame:
    """Immutable sale lines, taken while the seats are still held.

    Cancelling releases the seats; this fact keeps what was sold, so the
    cancellation fee can still be reported afterwards.
    """
    return (seats.filter(F.col("order_id").isNotNull())
            .groupBy("order_id", "flight_id", "plane_id", "class_type")
            .agg(F.count(F.lit(1)).alias("seat_cnt"))
            .join(prices, ["flight_id", "plane_id", "class_type"])
            .withColumn("amount", F.col("price") * F.col("seat_cnt")))


def fact_lines(fact: DataFrame, orders: DataFrame, flights: DataFrame,
               planes: DataFrame) -> DataFrame:
    """The sale fact with today's order and flight states."""
    return (fact.select("order_id", "flight_id", "plane_id", "class_type", "amount")
            .join(orders.select("order_id", "order_status"), "order_id")
            .join(flights.select("flight_id", "flight_status"), "flight_id")
            .join(planes.select("plane_id", "plane_size", "plane_manufacturer"), "plane_id"))


def sales(seats: DataFrame, orders: DataFrame, prices: DataFrame) -> DataFrame:
    """Every seat with its order's status and its price: (flight_id, class_type, order_id, order_status, price).

    Made once, and stored by flight it serves occupancy and revenue without a
    shuffle by flight. A free seat has no order and no status, a seat of a class
    without a price none.
    """
    held = (seats.filter(F.col("order_id").isNotNull())
            .join(orders.select("order_id", "order_status"), "order_id", "left"))
    free = seats.filter(F.col("order_id").isNull()).withColumn("order_status", F.lit(None).cast("string"))
    return (held.unionByName(free).join(prices, ["flight_id", "plane_id", "class_type"], "left")
            .select("flight_id", "class_type", "order_id", "order_status", "price"))


def sale_tally(sold: DataFrame) -> DataFrame:
    """Per flight: all seats, those of a standing order, and the share of these."""
    kept = F.col("order_id").isNotNull() & is_kept(F.col("order_status"))
    return (sold.groupBy("flight_id")
            .agg(F.count(F.lit(1)).alias("seats"), F.sum(flag(F.coalesce(kept, F.lit(False)))).alias("kept"))
            .withColumn("occupancy_pct", percent(F.col("kept"), F.col("seats"))))


def sale_lines(sold: DataFrame, flights: DataFrame, planes: DataFrame) -> DataFrame:
    """Held and priced seats as money, for the revenue report."""
    held = sold.filter(F.col("order_status").isNotNull() & F.col("price").isNotNull())
    return (held.withColumnRenamed("price", "amount")
            .join(flights.select("flight_id", "plane_id", "flight_status"), "flight_id")
            .join(planes.select("plane_id", "plane_size", "plane_manufacturer"), "plane_id"))


def staff_hours(people: DataFrame, links: DataFrame, flown: DataFrame,
                long_minutes: int = P.REPORT_LONG_MINUTES) -> DataFrame:
    """Long and short hours per employee; idle staff shows 0.

    ``links`` (employee_id, flight_id) ; ``flown`` (flight_id, minutes) holds
    completed flights only.
    """
    minutes = F.col("minutes")
    worked = (links.select("employee_id", "flight_id").join(flown, "flight_id")
              .groupBy("employee_id")
              .agg(F.sum(F.when(minutes > long_minutes, minutes).otherwise(0)).alias("long"),
                   F.sum(F.when(minutes <= long_minutes, minutes).otherwise(0)).alias("short")))
    hours = people.select("employee_id").join(worked, "employee_id", "left").select(
        "employee_id",
        hours_of(F.coalesce("long", F.lit(0))).alias("long_flight_hours"),
        hours_of(F.coalesce("short", F.lit(0))).alias("short_flight_hours"))
    return hours.withColumn("total_hours",
                            F.col("long_flight_hours") + F.col("short_flight_hours"))


def completed_minutes(flights: DataFrame, routes: DataFrame) -> DataFrame:
    return (flights.filter(F.col("flight_status") == P.COMPLETED)
            .join(routes, "route_id")
            .select("flight_id", F.col("flight_duration").alias("minutes")))


def cancel_rate_by_month(orders: DataFrame, exclude: tuple[str, ...] = (P.PENDING,)) -> DataFrame:
    """Share of each purchase month's orders that the customer cancelled."""
    counted = orders
    if exclude:
        counted = counted.filter(F.col("date_of_purchase").isNotNull()
                                 & ~F.col("order_status").isin(*exclude))
    cancelled = flag(F.col("order_status") == P.BY_CUSTOMER)
    return (counted.groupBy(month_start("date_of_purchase").alias("month"))
            .agg(F.count(F.lit(1)).alias("orders"), F.sum(cancelled).alias("cancelled"))
            .select(month_text("month").alias("purchase_month"), "orders",
                    percent(F.col("cancelled"), F.col("orders"))
                    .alias("customer_cancellation_rate")))


def route_months(flights: DataFrame, routes: DataFrame, occupancy: DataFrame | None, as_of: str) -> DataFrame:
    """Flights before ``as_of`` per plane, month (its first day) and route, from one fold.

    flown, cancelled, ``days`` with a flown flight (bit d - 1 for day d) and the
    best occupancy of a flown flight. ``occupancy``: flight_id, occupancy_pct;
    None if the flights have the column. A route that is not known has no airports.
    """
    flown = F.col("flight_status").isin(*P.FLOWN_FLIGHT)
    past = _past(flights, as_of)
    if occupancy is not None:
        past = past.join(occupancy.select("flight_id", "occupancy_pct"), "flight_id", "left")
    day_bit = F.expr("shiftleft(1, dayofmonth(takeoff_ts) - 1)")
    folded = (past.groupBy("plane_id", month_start("takeoff_ts").alias("month"), "route_id")
              .agg(F.sum(flag(flown)).alias("flown"),
                   F.sum(flag(F.col("flight_status") == P.CANCELLED)).alias("cancelled"),
                   F.max(F.when(flown, F.col("occupancy_pct"))).alias("best"),
                   F.bit_or(F.when(flown, day_bit).otherwise(0)).alias("days")))
    # Folded by route first, so a route with a third of all flights joins as a few rows.
    return (folded.join(routes.select("route_id", "origin_airport", "destination_airport"), "route_id", "left")
            .groupBy("plane_id", "month", "origin_airport", "destination_airport")
            .agg(F.sum("flown").alias("flown"), F.sum("cancelled").alias("cancelled"),
                 F.max("best").alias("best"), F.bit_or("days").alias("days")))


def _route_rank() -> Column:
    """The smallest is the dominant route; NULL for routes that are not known or were not flown.

    Ties: higher occupancy (none at all last), then origin and destination.
    """
    rank = F.struct((-F.col("flown")).alias("flown"),
                    F.coalesce(-F.col("best"), F.lit(1)).alias("best"),
                    "origin_airport", "destination_airport")
    known = F.col("origin_airport").isNotNull() | F.col("destination_airport").isNotNull()
    return F.when(known & (F.col("flown") > 0), rank)


def dominant_route(per_route: DataFrame) -> DataFrame:
    """The route flown most per plane and month, an aggregate that folds map-side."""
    return (per_route.groupBy("plane_id", "month").agg(F.min(_route_rank()).alias("top")).filter("top IS NOT NULL")
            .select("plane_id", "month", (-F.col("top.flown")).alias("route_flights"),
                    F.col("top.origin_airport").alias("origin_airport"),
                    F.col("top.destination_airport").alias("destination_airport")))


def fleet_monthly(flights: DataFrame, routes: DataFrame, occupancy: DataFrame | None, as_of: str,
                  period_days: int = P.UTILISATION_DAYS) -> DataFrame:
    """Per plane and month: flown, cancelled, days in use and the dominant route.

    Everything comes from one fold of the flights (see ``route_months``).
    """
    return (route_months(flights, routes, occupancy, as_of).groupBy("plane_id", "month")
            .agg(F.sum("flown").alias("completed_flights"), F.sum("cancelled").alias("cancelled_flights"),
                 F.bit_count(F.bit_or("days")).alias("flown_days"), F.min(_route_rank()).alias("top"))
            .filter(F.col("completed_flights") > 0)
            .select("plane_id", month_text("month").alias("month"), "completed_flights", "cancelled_flights",
                    percent(F.col("flown_days"), F.lit(period_days)).alias("utilization_pct"),
                    route_path("top.origin_airport", "top.destination_airport")
                    .alias("dominant_origin_destination")))


def with_occupancy(lines: DataFrame, kept: Column) -> DataFrame:
    """Seat lines with the share of their flight's lines that are kept (a window over one flight's seats)."""
    flight = Window.partitionBy("flight_id")
    return lines.withColumn("occupancy_pct", percent(F.sum(flag(kept)).over(flight),
                                                     F.count(F.lit(1)).over(flight), 6))


def completed_by_month(flights: DataFrame, as_of: str | None = None) -> DataFrame:
    done = flights.filter(F.col("flight_status") == P.COMPLETED)
    done = _past(done, as_of) if as_of else done
    return (done.groupBy(month_start("takeoff_ts").alias("month"))
            .agg(F.count(F.lit(1)).alias("flights_completed"))
            .withColumn("month", month_text("month")))


def top_routes(completed: DataFrame, n: int = P.TOP_ROUTES) -> DataFrame:
    """The n busiest routes of completed flights (origin_airport, destination_airport, flights)."""
    return (completed.groupBy("origin_airport", "destination_airport")
            .agg(F.sum("flights").alias("flights_completed"))
            .select(route_label("origin_airport", "destination_airport").alias("route"),
                    "flights_completed")
            .orderBy(F.desc("flights_completed"), F.asc("route")).limit(n))


def completed_per_route(flights: DataFrame, routes: DataFrame,
                        as_of: str | None = None) -> DataFrame:
    done = flights.filter(F.col("flight_status") == P.COMPLETED)
    done = _past(done, as_of) if as_of else done
    return (done.groupBy("route_id").agg(F.count(F.lit(1)).alias("flights"))
            .join(routes, "route_id")
            .select("origin_airport", "destination_airport", "flights"))


def flights_by_hour(flights: DataFrame, as_of: str,
                    statuses: tuple[str, ...] = P.FLOWN_FLIGHT) -> DataFrame:
    return (_past(flights, as_of).filter(F.col("flight_status").isin(*statuses))
            .groupBy(F.hour("takeoff_ts").alias("takeoff_hour"))
            .agg(F.count(F.lit(1)).alias("flights_count")))


def kpi_counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kpi"), "n")
            for name, df in tables.items()]
    merged = rows[0]
    for row in rows[1:]:
        merged = merged.unionByName(row)
    return merged


def seats_per_flight(flights: DataFrame, seats: DataFrame, keep: list[str]) -> DataFrame:
    """Seats created for every flight, 0 when there are none."""
    made = seats.groupBy("flight_id").agg(F.count(F.lit(1)).alias("seats_created"))
    return (flights.select(*keep).join(made, "flight_id", "left")
            .withColumn("seats_created", F.coalesce("seats_created", F.lit(0))))


def occupancy_counts(seats: DataFrame, key: str, taken: Column) -> DataFrame:
    """Total, occupied and occupied % (one decimal) per key."""
    return (seats.groupBy(key)
            .agg(F.count(F.lit(1)).alias("total"), F.sum(flag(taken)).alias("occupied"))
            .withColumn("occ_percent", percent(F.col("occupied"), F.col("total"), 1)))


def max_of_sums(df: DataFrame, key: str, value: str) -> DataFrame:
    """Largest group sum and largest group size."""
    return (df.groupBy(key).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
            .agg(F.max("s").alias("max_sum"), F.max("n").alias("max_rows")))


def _past(flights: DataFrame, as_of: str) -> DataFrame:
    return flights.filter(F.col("takeoff_ts") < moment(as_of))
