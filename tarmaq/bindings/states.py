"""Batch state transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmaq import params as P
from tarmaq.bindings import query
from tarmaq.bindings.views import (AS_OF, BOOKING, EVENTS_END, FLIGHT, HOLD_TTL, SEATLINE, TALLY,
                                   bookings, events, flights, seat_lines, seat_requests, tally)
from tarmaq.operators import relations as J
from tarmaq.operators.sessions import follow_sessions, lapsed, no_sessions, sessions
from tarmaq.plans import claims, scoped, totals
from tarmaq.plans import transitions as X
from tarmaq.plans.datasets import order_totals
from tarmaq.functions.scalars import moment
from tarmaq.session import measured, run_dir
from tarmaq.sources import buckets
from tarmaq.sources.scans import scan


@query("refresh_status", f"""
WITH {FLIGHT}, n AS (
  SELECT flight_status AS old_status,
         CASE WHEN flight_status IN ('Scheduled', 'Full') AND takeoff_ts < TIMESTAMP '{AS_OF}'
              THEN 'Completed' ELSE flight_status END AS new_status FROM flight)
SELECT old_status, new_status, count(*) AS n,
       count(*) FILTER (WHERE old_status <> new_status) AS changed
FROM n GROUP BY old_status, new_status""")
def refresh_status(spark, sf):
    """Counted in the same pass: the old status rides along with the new one."""
    before = flights(spark, sf).withColumn("old_status", F.col("flight_status"))
    return (X.refresh_status(before, AS_OF).groupBy("old_status", "flight_status")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("old_status", F.col("flight_status").alias("new_status"), "n",
                    F.when(F.col("old_status") != F.col("flight_status"), F.col("n"))
                    .otherwise(0).alias("changed")))


@query("status_changes", f"""
WITH {BOOKING}, after AS (
  SELECT order_status AS old_status,
         CASE WHEN order_status = 'Active' AND date_of_purchase > TIMESTAMP '{AS_OF}' + INTERVAL 36 HOUR
              THEN 'Cancelled by customer' ELSE order_status END AS new_status FROM booking)
SELECT old_status, new_status, count(*) AS n, count(*) FILTER (WHERE old_status <> new_status) AS changed
FROM after GROUP BY old_status, new_status""")
def status_changes(spark, sf):
    """Bookings before and after all that may be cancelled are."""
    orders = bookings(spark, sf)
    timed = orders.withColumn("takeoff_ts", F.col("date_of_purchase")).withColumn("total", F.lit(0))
    seats = orders.select("order_id").limit(0)
    after, _ = X.apply_customer_cancel(orders, seats, X.cancel_decisions(timed, AS_OF))
    return X.status_changes(orders, after, "order_id", "order_status")


@query("expire_holds", f"""
SELECT event_id, user_id FROM events v
WHERE event_type = 'view' AND ts < TIMESTAMP '{EVENTS_END}' - to_minutes({HOLD_TTL})
  AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase'
                  AND p.user_id = v.user_id AND p.ts >= v.ts
                  AND p.ts <= v.ts + to_minutes({HOLD_TTL}))""")
def expire_holds(spark, sf):
    holds = lapsed(events(spark, sf, "view"), events(spark, sf, "purchase"), "user_id", "ts",
                   HOLD_TTL)
    orders = holds.select("event_id", "user_id", F.col("ts").alias("date_of_purchase"),
                          F.when(F.col("paid"), P.ACTIVE).otherwise(P.PENDING)
                          .alias("order_status"))
    return orders.filter(X.is_expired(EVENTS_END, HOLD_TTL)).select("event_id", "user_id")


@query("claim_single", """
SELECT user_id AS flight_id, event_id % 10 + 1 AS s_row, event_id % 4 + 1 AS s_column,
       arg_min(event_id, (ts, event_id)) AS order_id
FROM events WHERE event_type = 'click' GROUP BY ALL""")
def claim_single(spark, sf):
    asked = events(spark, sf, "click").select(
        F.col("user_id").alias("flight_id"), (F.col("event_id") % 10 + 1).alias("s_row"),
        (F.col("event_id") % 4 + 1).alias("s_column"), F.col("event_id").alias("order_id"),
        F.col("ts").alias("requested_ts"))
    return claims.claim_single(asked, ["requested_ts", "order_id"]).drop("requested_ts")


# One step per request of a flight, in order, with the list of taken seats.
CLAIMS = """
WITH RECURSIVE r AS (
  SELECT event_id, user_id AS flight_id, event_id % 20 AS a, (event_id // 20) % 20 AS b,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type = 'click'),
walk AS (
  SELECT flight_id, 0::BIGINT AS rn, []::BIGINT[] AS taken, NULL::BIGINT AS order_id,
         false AS accepted
  FROM (SELECT DISTINCT flight_id FROM r)
  UNION ALL
  SELECT r.flight_id, r.rn,
         CASE WHEN a <> b AND NOT list_contains(taken, a) AND NOT list_contains(taken, b)
              THEN list_concat(taken, [a, b]) ELSE taken END,
         r.event_id, a <> b AND NOT list_contains(taken, a) AND NOT list_contains(taken, b)
  FROM walk w JOIN r ON r.flight_id = w.flight_id AND r.rn = w.rn + 1)
SELECT order_id, flight_id, 2::BIGINT AS seats, accepted FROM walk WHERE rn > 0"""


@query("claim_all_or_nothing", CLAIMS)
def claim_all_or_nothing(spark, sf):
    return claims.claim_all_or_nothing(seat_requests(events(spark, sf, "click")))


@query("confirm_payment", f"""
WITH hold AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1),
paid AS (SELECT h.user_id, min(p.ts) AS paid_at FROM hold h JOIN events p
         ON p.user_id = h.user_id AND p.event_type = 'purchase' AND p.ts >= h.ts
         AND p.ts <= h.ts + to_minutes({HOLD_TTL}) GROUP BY 1)
SELECT h.user_id AS order_id,
       CASE WHEN paid_at IS NULL THEN 'Pending' ELSE 'Active' END AS order_status,
       strftime(coalesce(paid_at, ts), '%Y-%m-%d %H:%M:%S.%f') AS date_of_purchase
FROM hold h LEFT JOIN paid p ON p.user_id = h.user_id""")
def confirm_payment(spark, sf):
    """A user's last view is the pending order; all purchases are payments."""
    return X.confirm_payment(*_holds_and_payments(spark, sf), HOLD_TTL)[0].select(
        "order_id", "order_status", "date_of_purchase")


def _holds_and_payments(spark, sf):
    holds = (events(spark, sf, "view").groupBy(F.col("user_id").alias("order_id"))
             .agg(F.max("ts").alias("date_of_purchase")).withColumn("order_status", F.lit(P.PENDING)))
    return holds, events(spark, sf, "purchase").select(F.col("user_id").alias("order_id"),
                                                       F.col("ts").alias("paid_at"))


@query("rejected_payments", f"""
WITH hold AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1),
ranked AS (
  SELECT p.user_id, p.ts, h.ts IS NOT NULL AND p.ts >= h.ts
           AND p.ts <= h.ts + to_minutes({HOLD_TTL}) AS in_time
  FROM events p LEFT JOIN hold h USING (user_id) WHERE event_type = 'purchase')
SELECT user_id AS order_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS paid_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, in_time ORDER BY ts) AS n FROM ranked)
WHERE NOT (in_time AND n = 1)""")
def rejected_payments(spark, sf):
    return X.confirm_payment(*_holds_and_payments(spark, sf), HOLD_TTL)[1]


@query("cancel_decisions", f"""
WITH {BOOKING}, {SEATLINE}, t AS (
  SELECT flight_id AS order_id, sum(price) AS total FROM seatline
  WHERE order_status = 'Active' GROUP BY 1),
d AS (
  SELECT b.order_id, coalesce(total, 0)::DECIMAL(18,2) AS total,
         CASE WHEN order_status <> 'Active' THEN 'not_active'
              WHEN date_of_purchase > TIMESTAMP '{AS_OF}' + INTERVAL 36 HOUR THEN 'accepted'
              ELSE 'too_late' END AS decision
  FROM booking b LEFT JOIN t USING (order_id)),
c AS (SELECT *, CASE WHEN decision = 'accepted'
                     THEN round(total * 0.05::DECIMAL(3,2), 2) ELSE 0 END AS fee FROM d)
SELECT order_id, CAST(total AS DOUBLE) AS total, decision, CAST(fee AS DOUBLE) AS fee,
       CAST(CASE WHEN decision = 'accepted' THEN total - fee ELSE 0 END AS DOUBLE) AS refund
FROM c""")
def cancel_decisions(spark, sf):
    held = (seat_lines(spark, sf, P.ACTIVE)
            .select(F.col("flight_id").alias("order_id"), "price"))
    orders = bookings(spark, sf).withColumnRenamed("date_of_purchase", "takeoff_ts")
    return X.cancel_decisions(order_totals(orders, held), AS_OF).select(
        "order_id", "total", "decision", "fee", "refund")


FOLDED = f"""
WITH {BOOKING}, after AS (
  SELECT date_of_purchase, CASE WHEN order_status = 'Active' AND date_of_purchase > TIMESTAMP '{AS_OF}' + INTERVAL 36 HOUR
                                THEN 'Cancelled by customer' ELSE order_status END AS order_status FROM booking)"""


def _cancelled(spark, sf):
    """The bookings, and what changes when all that may be cancelled are."""
    orders = bookings(spark, sf)
    decided = X.cancel_decisions(orders.select(
        "order_id", "order_status", F.col("date_of_purchase").alias("takeoff_ts"), F.lit(0).alias("total")), AS_OF)
    accepted = decided.filter(F.col("decision") == "accepted").select("order_id")
    touched = orders.join(accepted, "order_id", "left_semi")
    return orders, touched.select("order_id", F.col("date_of_purchase").alias("old_date"),
                                  F.col("order_status").alias("old_status"), F.col("date_of_purchase").alias("new_date"),
                                  F.lit(P.BY_CUSTOMER).alias("new_status"))


@query("bookings_by_status", f"""{FOLDED}
SELECT strftime(date_trunc('month', date_of_purchase), '%Y-%m-%d %H:%M:%S.%f') AS period, order_status, count(*) AS n
FROM after GROUP BY ALL""")
def bookings_by_status(spark, sf):
    """Totals by month before the cancellations, with the cancelled bookings moved."""
    orders, changes = _cancelled(spark, sf)
    return totals.fold(totals.booking_totals(orders, "month"), totals.signed(changes, "month"))


@query("cancel_rate_from_totals", f"""{FOLDED}
SELECT strftime(date_of_purchase, '%Y-%m') AS purchase_month, count(*) AS orders,
       CAST(round(100 * CAST(count(*) FILTER (WHERE order_status = 'Cancelled by customer') AS DECIMAL(18,6))
                  / count(*), 2) AS DOUBLE) AS customer_cancellation_rate
FROM after WHERE order_status <> 'Pending' GROUP BY 1""")
def cancel_rate_from_totals(spark, sf):
    """The cancellation report after the cancellations, read from daily totals."""
    orders, changes = _cancelled(spark, sf)
    return totals.cancel_rate(totals.fold(totals.booking_totals(orders), totals.signed(changes)))


CANCELLED_DAYS = "2000-01-24", "2000-01-30"


def _requests(urgent):
    return urgent.select("flight_id", (F.col("owner") + F.when(F.col("flight_id") % 3 == 0, 1).otherwise(0))
                         .alias("manager_id"))


def _cascade(spark, sf):
    """Urgent orders ask for their flight to be cancelled; every third asks for another's."""
    trips = flights(spark, sf).withColumn("manager_id", F.col("owner"))
    asks = _requests(trips.filter(F.col("priority") == "1-URGENT"))
    decided = X.flight_cancel_decisions(asks, trips, AS_OF)
    # the first status in this order decides; as numbers, so that the fold needs no sort
    rank = F.min(F.when(F.col("order_status") == P.ACTIVE, 0)
                 .when(F.col("order_status") == P.BY_CUSTOMER, 1).otherwise(2))
    status = F.when(rank == 0, P.ACTIVE).when(rank == 1, P.PENDING).otherwise(P.COMPLETED)
    orders = (seat_lines(spark, sf).groupBy("flight_id", "s_row")
              .agg(status.alias("order_status"), F.sum("price").alias("total"))
              .withColumn("order_id", F.col("flight_id") * 10 + F.col("s_row")))
    return trips, decided, orders


CASCADE = f"""{FLIGHT}, {SEATLINE}, gone AS (
  SELECT flight_id FROM flight
  WHERE priority = '1-URGENT' AND flight_id % 3 <> 0 AND flight_status IN ('Scheduled', 'Full')
    AND takeoff_ts >= TIMESTAMP '{AS_OF}' + INTERVAL 72 HOUR),
sale AS (
  SELECT flight_id * 10 + s_row AS order_id, flight_id, sum(price) AS total,
         CASE min(order_status) WHEN 'Active' THEN 'Active'
              WHEN 'Cancelled by customer' THEN 'Pending' ELSE 'Completed' END AS order_status
  FROM seatline GROUP BY flight_id, s_row)"""


@query("trip_cancel_cascade", f"""
WITH {CASCADE}
SELECT order_id, flight_id,
       CASE WHEN flight_id IN (SELECT flight_id FROM gone) AND order_status IN ('Active', 'Pending')
            THEN 'Cancelled by system' ELSE order_status END AS order_status,
       CASE WHEN flight_id IN (SELECT flight_id FROM gone) THEN NULL ELSE order_id END AS seat_order
FROM sale""")
def trip_cancel_cascade(spark, sf):
    _, decided, orders = _cascade(spark, sf)
    return X.void_sales(X.cancelled_flights(decided), orders).select(
        "order_id", "flight_id", "order_status", "seat_order")


@query("scoped_cancellation", f"""
WITH {CASCADE}, week AS (SELECT flight_id FROM gone JOIN flight USING (flight_id)
                       WHERE CAST(takeoff_ts AS DATE) BETWEEN DATE '{CANCELLED_DAYS[0]}' AND DATE '{CANCELLED_DAYS[1]}')
SELECT order_id, flight_id,
       CASE WHEN flight_id IN (SELECT flight_id FROM week) AND order_status IN ('Active', 'Pending')
            THEN 'Cancelled by system' ELSE order_status END AS order_status
FROM sale""")
def scoped_cancellation(spark, sf):
    """The requests for one week's flights, in a store of buckets: only their buckets are written anew."""
    trips, _, orders = _cascade(spark, sf)
    store = run_dir(spark, "store")
    tables = {"flight": trips, "orders": orders.drop("total"), "seat": orders.select("flight_id", "s_row", "order_id")}
    buckets.create(spark, store, tables, "flight_id", 64)
    schemas = {name: df.schema for name, df in tables.items()}
    week = scoped.read(spark, store, schemas=schemas)["flight"].filter(
        (F.col("priority") == "1-URGENT") & (F.to_date("takeoff_ts").between(*CANCELLED_DAYS)))
    asks = _requests(week)

    def change(t):
        decided = X.flight_cancel_decisions(asks, t["flight"], AS_OF)
        flown, voided, freed = X.cancel_flights(X.cancelled_flights(decided), t["flight"], t["orders"], t["seat"])
        return {"flight": flown, "orders": voided, "seat": freed}

    scoped.apply(spark, store, asks.select("flight_id"), change, schemas=schemas)
    return scoped.read(spark, store, schemas=schemas)["orders"].select("order_id", "flight_id", "order_status")


@query("trip_cancel_refunds", f"""
WITH {CASCADE}
SELECT g.flight_id, count(order_id) AS refunded_orders,
       CAST(coalesce(sum(total), 0) AS DOUBLE) AS total_refunded
FROM gone g LEFT JOIN sale s ON s.flight_id = g.flight_id AND order_status = 'Active'
GROUP BY g.flight_id""")
def trip_cancel_refunds(spark, sf):
    _, decided, orders = _cascade(spark, sf)
    return X.flight_cancel_refunds(X.cancelled_flights(decided), orders,
                                   orders.select("order_id", "total"))


@query("upsert_latest", """
SELECT coalesce(s_suppkey, c_custkey) AS key, coalesce(s_name, c_name) AS name,
       CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS balance
FROM customer FULL JOIN supplier ON s_suppkey = c_custkey""")
def upsert_latest(spark, sf):
    old = scan(spark, sf, "customer", ["c_custkey", "c_name", "c_acctbal"]).toDF(
        "key", "name", "balance")
    new = scan(spark, sf, "supplier", ["s_suppkey", "s_name", "s_acctbal"]).toDF(
        "key", "name", "balance")
    return J.upsert(old, new, ["key"])


@query("assign_codes", """
WITH n AS (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey)
                                   AS VARCHAR) AS t FROM orders)
SELECT o_orderkey, CASE WHEN length(t) < 5 THEN lpad(t, 5, '0') ELSE t END AS code FROM n""")
def assign_codes(spark, sf):
    orders = scan(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    return X.assign_codes(orders, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("null_orphans", """
SELECT CASE WHEN o_orderkey IS NULL THEN NULL ELSE l_orderkey END AS order_id,
       l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'""")
def null_orphans(spark, sf):
    lines = scan(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    done = flights(spark, sf, P.COMPLETED)
    return J.null_orphans(lines.withColumnRenamed("l_orderkey", "order_id"), done, "order_id",
                          "flight_id")


@query("derive_full_status", f"""
WITH {FLIGHT}, {SEATLINE}, {TALLY}
SELECT flight_id, CASE WHEN flight_status = 'Scheduled' AND kept = seats THEN 'Full'
                       ELSE flight_status END AS flight_status
FROM flight LEFT JOIN tally USING (flight_id)""")
def derive_full_status(spark, sf):
    return X.derive_full(flights(spark, sf).select("flight_id", "flight_status"),
                         tally(seat_lines(spark, sf)))


@query("derive_order_completed", f"""
WITH {FLIGHT}
SELECT l_orderkey * 10 + l_linenumber AS order_id,
       CASE WHEN min(l_returnflag) = 'N' AND (any_value(flight_status) = 'Completed'
                 OR any_value(takeoff_ts) < TIMESTAMP '{AS_OF}') THEN 'Completed'
            WHEN min(l_returnflag) = 'N' THEN 'Active' ELSE 'Cancelled by customer'
       END AS order_status
FROM lineitem JOIN flight ON flight_id = l_orderkey GROUP BY l_orderkey, l_linenumber""")
def derive_order_completed(spark, sf):
    """Sales are (order, line); one is active when none of its lines was returned."""
    sales = (scan(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"])
             .groupBy(F.col("l_orderkey").alias("flight_id"), "l_linenumber")
             .agg(F.when(F.max(F.when(F.col("l_returnflag") < "N", 1).otherwise(0)) == 1, P.BY_CUSTOMER)
                  .when(F.max(F.when(F.col("l_returnflag") == "N", 1).otherwise(0)) == 1, P.ACTIVE)
                  .otherwise(P.BY_CUSTOMER).alias("order_status"))
             .withColumn("order_id", F.col("flight_id") * 10 + F.col("l_linenumber")))
    refreshed = X.refresh_status(flights(spark, sf), AS_OF)
    return X.derive_order_completed(sales, refreshed).select("order_id", "order_status")


SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
                                         + INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS opens
           FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts
             ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(max(ts) + INTERVAL 60 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
       count(*) AS requests
FROM s GROUP BY user_id, n"""


@query("sessionize", SESSIONS)
def sessionize(spark, sf):
    return sessions(events(spark, sf), "user_id", "ts", P.SESSION_IDLE_MINUTES)


@query("sessionize_by_version", SESSIONS)
def sessionize_by_version(spark, sf):
    """Three versions of the events, each going on with the sessions that the one before left open."""
    seen = events(spark, sf).select("user_id", "ts")
    open_, closed, since = no_sessions(seen, "user_id", "ts"), None, None
    for until in ("2024-01-11 00:00:00", "2024-01-20 12:00:00", EVENTS_END):
        part = seen.filter(F.col("ts") < moment(until))
        part = part if since is None else part.filter(F.col("ts") >= moment(since))
        done, open_ = follow_sessions(open_, part, "user_id", "ts", P.SESSION_IDLE_MINUTES, until)
        open_, since = measured(open_, "open_sessions"), until
        closed = done if closed is None else closed.unionByName(done)
    ends = F.col("last_ts") + F.make_dt_interval(mins=F.lit(P.SESSION_IDLE_MINUTES))
    return closed.unionByName(open_.select("user_id", "session_start", ends.alias("session_end"), "requests"))
