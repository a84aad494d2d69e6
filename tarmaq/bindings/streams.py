"""Streaming twins over the events file."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmaq import params as P
from tarmaq.bindings import query
from tarmaq.bindings.states import CLAIMS, SESSIONS
from tarmaq.bindings.views import EVENT_SCHEMA, HOLD_TTL, events, seat_requests
from tarmaq.plans.claims import SEAT
from tarmaq.session import run_dir
from tarmaq.sources.scans import scan
from tarmaq.streaming import CLOSING, drain, open_files, read_files
from tarmaq.streaming.claims import drain_claims
from tarmaq.streaming.holds import lapsed_holds
from tarmaq.streaming.timers import lapsed_at_limit
from tarmaq.streaming.totals import drain_totals
from tarmaq.streaming.windows import stream_sessions, tumbling_counts

FILES = "events*.parquet"


def _closing(spark):
    """One closing row for each kind of event that a query watermarks."""
    return spark.createDataFrame([(-1, CLOSING, -1, kind, None) for kind in ("view", "purchase")],
                                 EVENT_SCHEMA)


def _stream(spark, sf, target):
    return open_files(spark, sf, EVENT_SCHEMA, target, FILES)


def _of(stream, kind):
    return stream.filter(F.col("event_type") == kind)


@query("stream_tumbling_counts", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, event_type,
       count(*) AS n
FROM events GROUP BY ALL""")
def stream_tumbling_counts(spark, sf):
    target = run_dir(spark, "tumbling")
    return drain(tumbling_counts(_stream(spark, sf, target), "ts", "1 day", ["event_type"]), target,
                 _closing(spark))


LAPSED = f"""
SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS held_at FROM events v
WHERE event_type = 'view'
  AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase'
                  AND p.user_id = v.user_id AND p.ts >= v.ts
                  AND p.ts <= v.ts + to_minutes({HOLD_TTL}))"""


@query("stream_expire_holds", LAPSED)
def stream_expire_holds(spark, sf):
    target = run_dir(spark, "holds")
    stream = _stream(spark, sf, target)
    return drain(lapsed_holds(_of(stream, "view"), _of(stream, "purchase"), "user_id", "event_id", "ts",
                              HOLD_TTL), target, _closing(spark))


@query("stream_hold_timers", LAPSED)
def stream_hold_timers(spark, sf):
    """The same holds, each emitted at its own limit."""
    target = run_dir(spark, "timers")
    stream = _stream(spark, sf, target)
    return drain(lapsed_at_limit(_of(stream, "view"), _of(stream, "purchase"), "user_id", "event_id", "ts", HOLD_TTL),
                 target, _closing(spark))


@query("stream_sessions", SESSIONS)
def stream_session_windows(spark, sf):
    target = run_dir(spark, "sessions")
    return drain(stream_sessions(_stream(spark, sf, target), "user_id", "ts", P.SESSION_IDLE_MINUTES),
                 target, _closing(spark))


@query("stream_claims", CLAIMS)
def stream_claims(spark, sf):
    requests = seat_requests(_of(read_files(spark, sf, EVENT_SCHEMA, FILES), "click"))
    seats = (seat_requests(events(spark, sf, "click")).select(*SEAT).distinct()
             .withColumn("order_id", F.lit(None).cast("bigint")))
    return drain_claims(requests, seats, run_dir(spark, "claims"))


@query("stream_bookings_by_status", """
SELECT strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S.%f') AS period,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'Cancelled by customer' ELSE 'Active' END AS order_status, count(*) AS n
FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL
UNION ALL SELECT strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S.%f'), 'Pending', count(*)
FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL""")
def stream_bookings_by_status(spark, sf):
    """Every order is booked as pending; all but those in P are paid, and the urgent ones of these cancelled."""
    schema = scan(spark, sf, "orders").schema
    orders = read_files(spark, sf, schema, "orders*.parquet")
    paid, urgent = F.col("o_orderstatus") != "P", F.col("o_orderpriority") == "1-URGENT"

    def change(old, new, when):
        return F.when(when, F.struct(F.col("o_orderdate").alias("old_date"), F.lit(old).cast("string").alias("old_status"),
                                     F.col("o_orderdate").alias("new_date"), F.lit(new).alias("new_status")))

    steps = F.array_compact(F.array(change(None, P.PENDING, F.lit(True)), change(P.PENDING, P.ACTIVE, paid),
                                    change(P.ACTIVE, P.BY_CUSTOMER, paid & urgent)))
    return drain_totals(orders.select(F.inline(steps)), run_dir(spark, "totals"))
