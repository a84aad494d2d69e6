"""Management reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmaq import params as P
from tarmaq.bindings import query
from tarmaq.bindings.views import (AS_OF, BOOKING, EVENTS_AS_OF, FLIGHT, SEATLINE, TALLY, bookings,
                                   events, flights, seat_lines, tally)
from tarmaq.functions.scalars import month_text, percent
from tarmaq.plans import reports as R
from tarmaq.session import run_dir
from tarmaq.sources.scans import scan
from tarmaq.sources.sinks import write_report

CENTS = "CAST((20000 * {n} + {d}) // (2 * {d}) AS DOUBLE) / 100"


def _pct(n: str, d: str) -> str:
    """100 * n / d rounded half up to cents, in exact integer arithmetic."""
    return CENTS.format(n=n, d=d)


@query("occupancy_by_trip", f"""
WITH {FLIGHT}, {SEATLINE}, {TALLY}
SELECT t.flight_id, t.seats, t.kept, {_pct('t.kept', 't.seats')} AS occupancy_pct
FROM tally t JOIN flight f USING (flight_id) WHERE f.flight_status = 'Completed'""")
def occupancy_by_trip(spark, sf):
    return R.occupancy_by_flight(flights(spark, sf, P.COMPLETED), tally(seat_lines(spark, sf)))


@query("avg_occupancy", f"""
WITH {FLIGHT}, {SEATLINE}, {TALLY}
SELECT round(avg(100.0::DOUBLE * kept / seats), 2) AS avg_seat_occupancy_pct
FROM tally JOIN flight USING (flight_id) WHERE flight_status = 'Completed'""")
def avg_occupancy(spark, sf):
    return R.average_occupancy(flights(spark, sf, P.COMPLETED), tally(seat_lines(spark, sf)))


@query("occupancy_counts", f"""
WITH {SEATLINE}, c AS (
  SELECT suppkey, count(*) AS total, count(*) FILTER (WHERE order_status = 'Active') AS occupied
  FROM seatline GROUP BY suppkey)
SELECT suppkey, total, occupied,
       CAST((2000 * occupied + total) // (2 * total) AS DOUBLE) / 10 AS occ_percent FROM c""")
def occupancy_counts(spark, sf):
    return R.occupancy_counts(seat_lines(spark, sf), "suppkey", F.col("order_status") == P.ACTIVE)


@query("lines_per_trip", f"""
WITH {FLIGHT}
SELECT f.flight_id, f.owner, count(l_orderkey) AS seats_created
FROM flight f LEFT JOIN lineitem ON l_orderkey = f.flight_id GROUP BY f.flight_id, f.owner""")
def lines_per_trip(spark, sf):
    return R.seats_per_flight(flights(spark, sf), seat_lines(spark, sf), ["flight_id", "owner"])


@query("agg_of_agg", """
SELECT CAST(max(s) AS BIGINT) AS max_sum, max(n) AS max_rows
FROM (SELECT p_brand, sum(p_size) AS s, count(*) AS n FROM part GROUP BY p_brand)""")
def agg_of_agg(spark, sf):
    return R.max_of_sums(scan(spark, sf, "part", ["p_brand", "p_size"]), "p_brand", "p_size")


@query("kpi_counts", """
SELECT 'planes' AS kpi, count(*) AS n FROM supplier
UNION ALL SELECT 'routes', count(*) FROM nation
UNION ALL SELECT 'flights', count(*) FROM orders""")
def kpi_counts(spark, sf):
    return R.kpi_counts({"planes": scan(spark, sf, "supplier"),
                         "routes": scan(spark, sf, "nation"),
                         "flights": scan(spark, sf, "orders")})


def _revenue_lines(spark, sf):
    """Lines folded per part, class and fate before they meet the parts."""
    kept_flights = flights(spark, sf).select(
        "flight_id", F.when(F.col("priority") == "1-URGENT", P.CANCELLED)
        .otherwise(F.col("flight_status")).alias("flight_status"))
    parts = scan(spark, sf, "part", ["p_partkey", "p_type", "p_brand"]).select(
        F.col("p_partkey").alias("partkey"), F.col("p_type").alias("plane_size"),
        F.col("p_brand").alias("plane_manufacturer"))
    keys = ["partkey", "class_type", "order_status", "flight_status"]
    return (seat_lines(spark, sf).join(kept_flights, "flight_id")
            .groupBy(*keys).agg(F.sum("price").alias("amount")).join(parts, "partkey"))


@query("revenue_by_class", f"""
WITH {FLIGHT}, {SEATLINE}
SELECT p_type AS plane_size, p_brand AS plane_manufacturer, class_type,
       CAST(round(sum(price * CASE order_status WHEN 'Active' THEN 1.00::DECIMAL(3,2)
            WHEN 'Cancelled by customer' THEN 0.05::DECIMAL(3,2)
            ELSE 0.00::DECIMAL(3,2) END), 2) AS DOUBLE) AS total_revenue
FROM seatline JOIN flight USING (flight_id) JOIN part ON p_partkey = partkey
WHERE priority <> '1-URGENT'
GROUP BY p_type, p_brand, class_type""")
def revenue_by_class(spark, sf):
    return R.revenue_by_class(_revenue_lines(spark, sf))


@query("revenue_by_class_fact", f"""
WITH {FLIGHT}, {SEATLINE}, fact AS (
  SELECT partkey, class_type, flight_id, order_status, sum(price) AS amount, count(*) AS seat_cnt
  FROM seatline GROUP BY ALL)
SELECT p_type AS plane_size, p_brand AS plane_manufacturer, class_type,
       CAST(round(sum(CASE WHEN order_status = 'Active' THEN amount * 1.00::DECIMAL(3,2)
                           ELSE 0 END), 2) AS DOUBLE) AS kept_revenue,
       CAST(round(sum(CASE WHEN order_status = 'Cancelled by customer'
                           THEN amount * 0.05::DECIMAL(3,2) ELSE 0 END), 2) AS DOUBLE)
         AS fee_revenue,
       CAST(sum(seat_cnt) AS BIGINT) AS seats_sold
FROM fact JOIN flight USING (flight_id) JOIN part ON p_partkey = partkey
GROUP BY p_type, p_brand, class_type""")
def revenue_by_class_fact(spark, sf):
    """Over every sale line, kept or released: kept money and fees side by side.

    Every flight's lines count here (none is cancelled), so they need no join
    with the flights beyond checking that the flight exists.
    """
    known = flights(spark, sf).select("flight_id")
    parts = scan(spark, sf, "part", ["p_partkey", "p_type", "p_brand"])
    fact = (seat_lines(spark, sf).join(known, "flight_id", "left_semi")
            .groupBy("partkey", "class_type", "order_status")
            .agg(F.sum("price").alias("amount"), F.count(F.lit(1)).alias("seat_cnt"))
            .join(parts, F.col("partkey") == F.col("p_partkey")))
    money_of = R.earned(F.col("amount"), F.col("order_status"))
    kept = R.is_kept(F.col("order_status"))
    zero = F.lit(0).cast("decimal(18,2)")
    return (fact.groupBy(F.col("p_type").alias("plane_size"),
                         F.col("p_brand").alias("plane_manufacturer"), "class_type")
            .agg(F.round(F.sum(F.when(kept, money_of).otherwise(zero)), 2).alias("kept_revenue"),
                 F.round(F.sum(F.when(kept, zero).otherwise(money_of)), 2).alias("fee_revenue"),
                 F.sum("seat_cnt").alias("seats_sold")))


@query("staff_hours", f"""
WITH {FLIGHT}, people AS (
  SELECT 'C' || c_custkey AS employee_id FROM customer
  UNION ALL SELECT 'S' || s_suppkey FROM supplier),
links AS (
  SELECT 'C' || o_custkey AS employee_id, o_orderkey AS flight_id FROM orders
  UNION ALL SELECT DISTINCT 'S' || l_suppkey, l_orderkey FROM lineitem),
worked AS (
  SELECT employee_id, CAST(sum(CASE WHEN minutes > 360 THEN minutes ELSE 0 END) AS BIGINT) AS lg,
         CAST(sum(CASE WHEN minutes <= 360 THEN minutes ELSE 0 END) AS BIGINT) AS sh
  FROM links JOIN flight USING (flight_id) WHERE flight_status = 'Completed'
  GROUP BY employee_id)
SELECT employee_id,
       CAST((200 * coalesce(lg, 0) + 60) // 120 AS DOUBLE) / 100 AS long_flight_hours,
       CAST((200 * coalesce(sh, 0) + 60) // 120 AS DOUBLE) / 100 AS short_flight_hours,
       CAST((200 * coalesce(lg, 0) + 60) // 120 + (200 * coalesce(sh, 0) + 60) // 120 AS DOUBLE)
         / 100 AS total_hours
FROM people LEFT JOIN worked USING (employee_id)""")
def staff_hours(spark, sf):
    def ident(letter, column):
        return F.concat(F.lit(letter), F.col(column)).alias("employee_id")
    people = (scan(spark, sf, "customer", ["c_custkey"]).select(ident("C", "c_custkey"))
              .unionByName(scan(spark, sf, "supplier", ["s_suppkey"])
                           .select(ident("S", "s_suppkey"))))
    pilots = flights(spark, sf).select(ident("C", "owner"), "flight_id")
    attendants = (seat_lines(spark, sf).select("suppkey", "flight_id").distinct()
                  .select(ident("S", "suppkey"), "flight_id"))
    flown = flights(spark, sf, P.COMPLETED).select("flight_id", "minutes")
    return R.staff_hours(people, pilots.unionByName(attendants), flown)


def _rate(where: str) -> str:
    return f"""
WITH {BOOKING}, m AS (
  SELECT strftime(date_of_purchase, '%Y-%m') AS purchase_month, count(*) AS orders,
         count(*) FILTER (WHERE order_status = 'Cancelled by customer') AS cancelled
  FROM booking {where} GROUP BY 1)
SELECT purchase_month, orders, {_pct('cancelled', 'orders')} AS customer_cancellation_rate FROM m"""


@query("cancel_rate_by_month", _rate("WHERE order_status <> 'Pending'"))
def cancel_rate_by_month(spark, sf):
    return R.cancel_rate_by_month(bookings(spark, sf))


@query("cancel_rate_by_month_all", _rate(""))
def cancel_rate_by_month_all(spark, sf):
    return R.cancel_rate_by_month(bookings(spark, sf), exclude=())


@query("completed_by_month", f"""
WITH {FLIGHT}
SELECT strftime(takeoff_ts, '%Y-%m') AS month, count(*) AS flights_completed
FROM flight WHERE flight_status = 'Completed' AND takeoff_ts < TIMESTAMP '{AS_OF}'
GROUP BY 1""")
def completed_by_month(spark, sf):
    return R.completed_by_month(flights(spark, sf, P.COMPLETED), AS_OF)


@query("report_sink", f"""
WITH {FLIGHT}
SELECT strftime(takeoff_ts, '%Y-%m') AS month, count(*) AS flights_completed
FROM flight WHERE flight_status = 'Completed' AND takeoff_ts < TIMESTAMP '{AS_OF}'
GROUP BY 1""")
def report_sink(spark, sf):
    """A report kept for display, as it is read back."""
    report = R.completed_by_month(flights(spark, sf, P.COMPLETED), AS_OF)
    return spark.read.schema(report.schema).parquet(write_report(report, run_dir(spark, "reports"), "completed_by_month"))


@query("top_routes", """
SELECT n1.n_name || ' → ' || n2.n_name AS route, count(*) AS flights_completed
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON n1.n_nationkey = c_nationkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation n2 ON n2.n_nationkey = s_nationkey
WHERE o_orderstatus = 'F'
GROUP BY 1 ORDER BY flights_completed DESC, route ASC LIMIT 5""")
def top_routes(spark, sf):
    """Legs are folded to (order, supplier nation) before they meet the orders."""
    legs = (scan(spark, sf, "lineitem", ["l_orderkey", "l_suppkey"])
            .join(scan(spark, sf, "supplier", ["s_suppkey", "s_nationkey"]),
                  F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("l_orderkey", "s_nationkey").agg(F.count(F.lit(1)).alias("legs")))
    done = (scan(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
            .filter(F.col("o_orderstatus") == "F")
            .join(scan(spark, sf, "customer", ["c_custkey", "c_nationkey"]),
                  F.col("o_custkey") == F.col("c_custkey"))
            .select("o_orderkey", "c_nationkey"))
    pairs = (done.join(legs, F.col("o_orderkey") == F.col("l_orderkey"))
             .groupBy("c_nationkey", "s_nationkey").agg(F.sum("legs").alias("flights")))
    nation = scan(spark, sf, "nation", ["n_nationkey", "n_name"])
    origin = nation.select(F.col("n_nationkey").alias("c_nationkey"),
                           F.col("n_name").alias("origin_airport"))
    destination = nation.select(F.col("n_nationkey").alias("s_nationkey"),
                                F.col("n_name").alias("destination_airport"))
    return R.top_routes(pairs.join(origin, "c_nationkey").join(destination, "s_nationkey"))


@query("trips_by_hour", f"""
SELECT hour(ts) AS takeoff_hour, count(*) AS flights_count FROM events
WHERE event_type IN ('purchase', 'view') AND ts < TIMESTAMP '{EVENTS_AS_OF}' GROUP BY 1""")
def trips_by_hour(spark, sf):
    status = (F.when(F.col("event_type") == "purchase", P.COMPLETED)
              .when(F.col("event_type") == "view", P.FULL).otherwise(P.CANCELLED))
    flown = events(spark, sf, "purchase", "view").select(F.col("ts").alias("takeoff_ts"),
                                     status.alias("flight_status"))
    return R.flights_by_hour(flown, EVENTS_AS_OF)


def _fleet(spark, sf):
    lines = R.with_occupancy(seat_lines(spark, sf), F.col("order_status") == P.ACTIVE)
    status = F.when(F.col("order_status") == P.BY_SYSTEM, P.CANCELLED).otherwise(P.COMPLETED)
    trips = lines.select("flight_id", F.col("suppkey").alias("plane_id"),
                         F.col("partkey").alias("route_id"), F.col("shipped").alias("takeoff_ts"),
                         status.alias("flight_status"), "occupancy_pct")
    routes = scan(spark, sf, "part", ["p_partkey", "p_brand", "p_type"]).select(
        F.col("p_partkey").alias("route_id"), F.col("p_brand").alias("origin_airport"),
        F.col("p_type").alias("destination_airport"))
    return trips, routes, None


FLEET = f"""{SEATLINE}, {TALLY}, past AS (
  SELECT flight_id, suppkey AS plane_id, partkey, shipped, strftime(shipped, '%Y-%m') AS month,
         order_status <> 'Cancelled by system' AS flown
  FROM seatline WHERE shipped < TIMESTAMP '{AS_OF}'),
per_route AS (
  SELECT plane_id, month, p_brand, p_type, count(*) AS n,
         max((200000000 * kept + seats) // (2 * seats)) AS best
  FROM past JOIN part ON p_partkey = partkey LEFT JOIN tally USING (flight_id)
  WHERE flown GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY plane_id, month
                               ORDER BY n DESC, best DESC, p_brand, p_type) AS rn
  FROM per_route)"""


@query("fleet_monthly_utilisation", f"""
WITH {FLEET}, monthly AS (
  SELECT plane_id, month, count(*) FILTER (WHERE flown) AS completed_flights,
         count(*) FILTER (WHERE NOT flown) AS cancelled_flights,
         count(DISTINCT CASE WHEN flown THEN CAST(shipped AS DATE) END) AS flown_days
  FROM past GROUP BY plane_id, month)
SELECT m.plane_id, m.month, completed_flights, cancelled_flights,
       {_pct('flown_days', '30')} AS utilization_pct,
       p_brand || ' -> ' || p_type AS dominant_origin_destination
FROM monthly m LEFT JOIN ranked r ON r.plane_id = m.plane_id AND r.month = m.month AND rn = 1
WHERE completed_flights > 0""")
def fleet_monthly_utilisation(spark, sf):
    return R.fleet_monthly(*_fleet(spark, sf), AS_OF)


@query("dominant_route", f"""
WITH {FLEET}
SELECT plane_id, month, n AS route_flights, p_brand AS origin_airport,
       p_type AS destination_airport
FROM ranked WHERE rn = 1""")
def dominant_route(spark, sf):
    return (R.dominant_route(R.route_months(*_fleet(spark, sf), AS_OF))
            .withColumn("month", month_text("month")))
