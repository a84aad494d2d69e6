"""The star-schema tables as a booking store: operators that take whole tables.

    seat    = lineitem rows of a flight (its order); free when returned by the system (A)
    order   = (order, line number) with the best state of its rows
    plane   = part; a flight's plane is its key modulo 200
    price   = the lowest of a flight and class
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmaq import params as P
from tarmaq.bindings import query
from tarmaq.bindings.states import CLAIMS
from tarmaq.bindings.views import AS_OF, EVENTS_END, FLIGHT, HOLD_TTL, events, flights, seat_requests
from tarmaq.functions.scalars import money, plus_minutes
from tarmaq.plans import datasets as D
from tarmaq.plans import flows
from tarmaq.plans import reports as R
from tarmaq.plans import transitions as X
from tarmaq.plans.claims import SEAT
from tarmaq.session import run_dir
from tarmaq.sources.scans import scan
from tarmaq.sources.sinks import colocate

PLANES = 200


def _store(spark, sf):
    lines = scan(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag",
                                         "l_extendedprice"])
    order_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    plane = (F.col("l_orderkey") % PLANES).alias("plane_id")
    seat = lines.select(F.col("l_orderkey").alias("flight_id"), F.col("l_linenumber").alias("s_row"), plane,
                        F.col("l_linestatus").alias("class_type"),
                        F.when(F.col("l_returnflag") != "A", order_id).alias("order_id"))
    best = F.min(F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2))
    orders = lines.groupBy(order_id.alias("order_id")).agg(
        F.when(best == 0, P.ACTIVE).when(best == 1, P.BY_CUSTOMER).otherwise(P.BY_SYSTEM).alias("order_status"))
    prices = lines.groupBy(F.col("l_orderkey").alias("flight_id"), plane, F.col("l_linestatus").alias("class_type")) \
        .agg(F.min(money("l_extendedprice")).alias("price"))
    planes = scan(spark, sf, "part", ["p_partkey", "p_type", "p_brand"]).select(
        F.col("p_partkey").alias("plane_id"), F.col("p_type").alias("plane_size"),
        F.col("p_brand").alias("plane_manufacturer"))
    flown = flights(spark, sf).withColumn("plane_id", F.col("flight_id") % PLANES)
    return seat, orders, flown, planes, prices


STORE = f"""{FLIGHT}, seat AS (
  SELECT l_orderkey AS flight_id, l_linestatus AS class_type,
         CASE WHEN l_returnflag <> 'A' THEN l_orderkey * 10 + l_linenumber END AS order_id FROM lineitem),
ordered AS (
  SELECT l_orderkey * 10 + l_linenumber AS order_id,
         CASE WHEN bool_or(l_returnflag = 'N') THEN 'Active' WHEN bool_or(l_returnflag = 'R')
              THEN 'Cancelled by customer' ELSE 'Cancelled by system' END AS order_status
  FROM lineitem GROUP BY 1),
price AS (
  SELECT l_orderkey AS flight_id, l_linestatus AS class_type,
         min(CAST(l_extendedprice AS DECIMAL(18,2))) AS price FROM lineitem GROUP BY ALL)"""

REVENUE = f"""
WITH {STORE}
SELECT p_type AS plane_size, p_brand AS plane_manufacturer, class_type,
       CAST(round(sum(price * CASE order_status WHEN 'Active' THEN 1.00::DECIMAL(3,2)
            WHEN 'Cancelled by customer' THEN 0.05::DECIMAL(3,2) ELSE 0.00::DECIMAL(3,2) END), 2) AS DOUBLE)
         AS total_revenue
FROM seat JOIN ordered USING (order_id) JOIN price USING (flight_id, class_type)
JOIN flight USING (flight_id) JOIN part ON p_partkey = flight_id % {PLANES}
GROUP BY p_type, p_brand, class_type"""


@query("store_revenue", REVENUE)
def store_revenue(spark, sf):
    return R.revenue_by_class(R.priced_lines(*_store(spark, sf)))


@query("store_revenue_from_fact", REVENUE)
def store_revenue_from_fact(spark, sf):
    """The same report on the fact that is kept before seats are released."""
    seat, orders, flown, planes, prices = _store(spark, sf)
    return R.revenue_by_class(R.fact_lines(R.order_line_fact(seat, prices), orders, flown, planes))


@query("store_seat_tally", f"""
WITH {STORE}
SELECT flight_id, count(*) AS seats, count(*) FILTER (WHERE order_status = 'Active') AS kept
FROM seat LEFT JOIN ordered USING (order_id) GROUP BY flight_id""")
def store_seat_tally(spark, sf):
    seat, orders, *_ = _store(spark, sf)
    return R.seat_tally(seat, orders).select("flight_id", "seats", "kept")


@query("route_endpoints", "SELECT p_brand AS airport FROM part UNION SELECT p_type FROM part")
def route_endpoints(spark, sf):
    return D.route_endpoints(scan(spark, sf, "part", ["p_brand", "p_type"])
                             .toDF("origin_airport", "destination_airport"))


@query("completed_per_route", f"""
WITH {FLIGHT}
SELECT c_mktsegment AS origin_airport, c_name AS destination_airport, count(*) AS flights
FROM flight JOIN customer ON c_custkey = owner WHERE flight_status = 'Completed'
GROUP BY owner, c_mktsegment, c_name""")
def completed_per_route(spark, sf):
    routes = scan(spark, sf, "customer", ["c_custkey", "c_mktsegment", "c_name"]).toDF(
        "route_id", "origin_airport", "destination_airport")
    return R.completed_per_route(flights(spark, sf).withColumnRenamed("owner", "route_id"), routes)


@query("expire_holds_seats", f"""
SELECT event_id AS seat_id,
       CASE WHEN event_type = 'view' AND ts < TIMESTAMP '{EVENTS_END}' - to_minutes({HOLD_TTL}) THEN NULL
            ELSE event_id END AS order_id
FROM events""")
def expire_holds_seats(spark, sf):
    """Every event holds a seat; views are unpaid. Their seats are freed, the others stay."""
    status = F.when(F.col("event_type") == "view", P.PENDING).otherwise(P.ACTIVE)
    orders = events(spark, sf).select(F.col("event_id").alias("order_id"), F.col("ts").alias("date_of_purchase"),
                                      status.alias("order_status"))
    seats = events(spark, sf).select(F.col("event_id").alias("seat_id"), F.col("event_id").alias("order_id"))
    return X.expire_holds(orders, seats, EVENTS_END, HOLD_TTL)[1]


def _by_flight(spark, sf):
    """Sales and flights in buckets by flight."""
    seat, orders, flown, planes, prices = _store(spark, sf)
    kept = colocate({"sales": R.sales(seat, orders, prices), "flown": flown.select("flight_id", "plane_id", "flight_status")},
                    run_dir(spark, "by_flight"), "flight_id", 32)
    return kept["sales"], kept["flown"], planes


@query("revenue_by_flight_store", REVENUE)
def revenue_by_flight_store(spark, sf):
    """The same report from sales that are stored by flight."""
    return R.revenue_by_class(R.sale_lines(*_by_flight(spark, sf)))


@query("occupancy_by_flight_store", f"""
WITH {STORE}, counted AS (
  SELECT flight_id, count(*) AS seats, count(*) FILTER (WHERE order_status NOT LIKE 'Cancelled%') AS kept
  FROM seat LEFT JOIN ordered USING (order_id) GROUP BY flight_id)
SELECT flight_id, seats, kept, flight_status FROM counted JOIN flight USING (flight_id)""")
def occupancy_by_flight_store(spark, sf):
    sold, flown, _ = _by_flight(spark, sf)
    return R.sale_tally(sold).join(flown, "flight_id").select("flight_id", "seats", "kept", "flight_status")


# --- whole flows --------------------------------------------------------------

@query("book_flow", CLAIMS.replace("SELECT order_id, flight_id, 2::BIGINT AS seats, accepted FROM walk WHERE rn > 0", """,
done AS (
  SELECT order_id, w.flight_id, ts, accepted,
         CASE WHEN NOT accepted THEN 'Cancelled by system' WHEN order_id % 3 = 0 THEN 'Active' ELSE 'Pending' END AS status
  FROM walk w JOIN events ON event_id = order_id WHERE rn > 0)
SELECT order_id, flight_id, status AS order_status, CASE WHEN accepted THEN 2 ELSE 0 END::BIGINT AS seats_held,
       strftime(ts + CASE WHEN status = 'Active' THEN INTERVAL 5 MINUTE ELSE INTERVAL 0 MINUTE END,
                '%Y-%m-%d %H:%M:%S.%f') AS date_of_purchase
FROM done
UNION ALL SELECT event_id, user_id, 'Active', 0, strftime(ts + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S.%f')
FROM events WHERE event_type = 'view' AND event_id % 4 = 0"""))
def book_flow(spark, sf):
    """Views are standing unpaid orders, clicks ask for two seats each; some are paid in time, some too late."""
    clicks, views = events(spark, sf, "click"), events(spark, sf, "view")
    owner = [F.concat(F.lit("u"), F.col("user_id")).alias("guest_email"), F.lit(None).cast("string").alias("reg_customer_email")]
    standing = views.select(F.col("event_id").alias("order_id"), F.col("user_id").alias("flight_id"), *owner,
                            F.col("ts").alias("date_of_purchase"), F.lit(P.PENDING).alias("order_status"))
    asked = seat_requests(clicks)
    requests = asked.join(clicks.select(F.col("event_id").alias("order_id"), *owner), "order_id")
    seats = asked.select(*SEAT).distinct().withColumn("order_id", F.lit(None).cast("bigint"))

    def paid(df, n, rest):  # every n-th in time, the next one too late
        kind = F.col("event_id") % n
        return df.filter(kind <= 1).select(F.col("event_id").alias("order_id"), plus_minutes(
            "ts", F.when(kind == 0, rest).otherwise(30)).alias("paid_at"))

    after = flows.book({"orders": standing, "seat": seats}, requests, paid(clicks, 3, 5).unionByName(paid(views, 4, 10)),
                       EVENTS_END)
    held = after["seat"].filter("order_id IS NOT NULL").groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    return (after["orders"].join(held, "order_id", "left")
            .select("order_id", "flight_id", "order_status", F.coalesce("n", F.lit(0)).alias("seats_held"), "date_of_purchase"))


@query("cancel_flow", f"""
WITH {FLIGHT}, price AS (
  SELECT l_orderkey AS flight_id, l_linestatus AS class_type, min(CAST(l_extendedprice AS DECIMAL(10,2))) AS price
  FROM lineitem GROUP BY ALL),
sale AS (
  SELECT l_orderkey * 10 + l_linenumber AS order_id, l_orderkey AS flight_id, sum(price) AS total,
         CASE WHEN bool_or(l_returnflag = 'N') THEN 'Active' WHEN bool_or(l_returnflag = 'R') THEN 'Pending'
              ELSE 'Completed' END AS order_status
  FROM lineitem JOIN price ON flight_id = l_orderkey AND class_type = l_linestatus GROUP BY l_orderkey, l_linenumber),
ask AS (
  SELECT sale.*, takeoff_ts, sale.flight_id % 3 <> 0 AS mine FROM sale JOIN flight USING (flight_id)
  WHERE priority = '1-URGENT'),
decided AS (
  SELECT order_id, total, order_status,
         CASE WHEN NOT mine THEN 'not_found' WHEN order_status <> 'Active' THEN 'not_active'
              WHEN takeoff_ts > TIMESTAMP '{AS_OF}' + INTERVAL 36 HOUR THEN 'accepted' ELSE 'too_late' END AS decision
  FROM ask),
charged AS (SELECT *, round(total * 0.05::DECIMAL(3,2), 2) AS due FROM decided)
SELECT order_id, decision, CAST(CASE WHEN decision = 'not_found' THEN 0 ELSE total END AS DOUBLE) AS total,
       CAST(CASE WHEN decision = 'accepted' THEN due ELSE 0 END AS DOUBLE) AS fee,
       CAST(CASE WHEN decision = 'accepted' THEN total - due ELSE 0 END AS DOUBLE) AS refund,
       CASE WHEN decision = 'accepted' THEN 'Cancelled by customer' ELSE order_status END AS order_status
FROM charged""")
def cancel_flow(spark, sf):
    """The orders of urgent flights are cancelled by their owners; for every third flight by somebody else."""
    lines = scan(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_extendedprice"])
    order_id = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_id")
    plane = (F.col("l_orderkey") % PLANES).alias("plane_id")
    best = F.min(F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2))
    orders = lines.groupBy(F.col("l_orderkey").alias("flight_id"), order_id).agg(
        F.when(best == 0, P.ACTIVE).when(best == 1, P.PENDING).otherwise(P.COMPLETED).alias("order_status")).withColumns({
            "guest_email": F.concat(F.lit("o"), F.col("flight_id"), F.lit("@example.org")),
            "reg_customer_email": F.lit(None).cast("string")})
    t = {"flight": flights(spark, sf), "orders": orders,
         "seat": lines.select(F.col("l_orderkey").alias("flight_id"), F.col("l_linenumber").alias("s_row"), plane,
                              F.col("l_linestatus").alias("class_type"), order_id),
         "pricing": lines.groupBy(F.col("l_orderkey").alias("flight_id"), plane, F.col("l_linestatus").alias("class_type"))
         .agg(F.min(F.col("l_extendedprice").cast("decimal(10,2)")).alias("price"))}
    urgent = t["flight"].filter(F.col("priority") == "1-URGENT").select("flight_id")
    named = F.when(F.col("flight_id") % 3 != 0, F.concat(F.lit(" "), F.upper("guest_email"))).otherwise("other@example.org")
    asks = orders.join(urgent, "flight_id", "left_semi").select("order_id", named.alias("email"))
    after = flows.cancel_orders(t, asks, AS_OF)
    return after["decisions"].join(after["orders"].select("order_id", "order_status"), "order_id").select(
        "order_id", "decision", "total", "fee", "refund", "order_status")
