"""Idle-gap sessions and lapsed holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmaq.functions.scalars import moment, plus_minutes
from tarmaq.operators.running import SLICE, SLICE_SECONDS, upto, with_slice

SLOT = "_slot"


def sessions(events: DataFrame, user: str, ts: str, idle_minutes: int,
             slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """One row per session: a session goes on while gaps are at most ``idle``.

    Equal to a session window whose end is the last event plus the idle time,
    but a hot user is spread over time slices. Events are read once: a slice is
    cut into parts where a gap is too long, and a part is one row from then on.
    Parts of neighbouring slices are joined if the gap between them is not too
    long. A user has no more of them than slices times the gaps that fit into one.
    """
    return _ended(_joined(_parts(events, user, ts, idle_minutes, slice_seconds), user, idle_minutes), user, idle_minutes)


OPEN = ["session_start", "last_ts", "requests"]


def follow_sessions(open_: DataFrame, events: DataFrame, user: str, ts: str, idle_minutes: int, until: str,
                    slice_seconds: int = SLICE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Go on with open sessions: (sessions that are closed now, sessions that are still open).

    ``open_``: user, session_start, last_ts, requests - what the run before left
    (see ``no_sessions``). ``events``: those since then and before ``until``, which
    closes all sessions that no later event can extend. So a day costs its own
    events and the sessions of the evening before, and the closed sessions of all
    runs are those of one run over everything.
    """
    before = open_.select(user, F.col("session_start").alias("_first"), F.col("last_ts").alias("_last"),
                          F.col("requests").alias("_n"))
    parts = before.unionByName(_parts(events, user, ts, idle_minutes, slice_seconds).select(user, "_first", "_last", "_n"))
    sessions_ = _joined(parts, user, idle_minutes).withColumnRenamed("_end", "last_ts")
    over = plus_minutes("last_ts", idle_minutes) < moment(until)
    return (_ended(sessions_.filter(over).withColumnRenamed("last_ts", "_end"), user, idle_minutes),
            sessions_.filter(~over).select(user, *OPEN))


def no_sessions(events: DataFrame, user: str, ts: str) -> DataFrame:
    """An empty table of open sessions."""
    return (events.select(user, F.col(ts).alias("session_start"), F.col(ts).alias("last_ts"),
                          F.lit(0).cast("bigint").alias("requests")).limit(0))


def _ended(sessions_: DataFrame, user: str, idle_minutes: int) -> DataFrame:
    return sessions_.select(user, "session_start", plus_minutes("_end", idle_minutes).alias("session_end"), "requests")


def _parts(events: DataFrame, user: str, ts: str, idle_minutes: int, slice_seconds: int) -> DataFrame:
    """Events of a user and slice without a gap that is too long: user, _first, _last, _n."""
    here = F.col(ts)
    seen = with_slice(events.select(user, ts), ts, slice_seconds).filter(F.col(user).isNotNull() & here.isNotNull())
    previous = F.lag(ts).over(Window.partitionBy(user, SLICE).orderBy(here))
    gap = F.coalesce((here > plus_minutes(previous, idle_minutes)).cast("int"), F.lit(0))
    return (seen.withColumn("_gap", gap).withColumn("_part", F.sum("_gap").over(upto([user], here)))
            .groupBy(user, SLICE, "_part")
            .agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n")))


def _joined(parts: DataFrame, user: str, idle_minutes: int) -> DataFrame:
    """(user, session_start, _end, requests) from parts (user, _first, _last, _n) that do not overlap."""
    line = Window.partitionBy(user).orderBy("_first")
    opens = F.coalesce(F.col("_first") > plus_minutes(F.lag("_last").over(line), idle_minutes), F.lit(True))
    started = (parts.withColumn("_opening", F.when(opens, F.col("_first")))
               .withColumn("session_start", F.max("_opening").over(
                   line.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    return (started.groupBy(user, "session_start")
            .agg(F.max("_last").alias("_end"), F.sum("_n").alias("requests")))


def with_slot(df: DataFrame, ts: str, minutes: int) -> DataFrame:
    """Add the start of the fixed time slot the row falls into."""
    return df.withColumn(SLOT, F.window(F.col(ts), f"{minutes} minutes")["start"])


def lapsed(holds: DataFrame, payments: DataFrame, user: str, ts: str,
           ttl_minutes: int) -> DataFrame:
    """Flag ``paid`` on every hold: same user, payment within [ts, ts + ttl].

    Time is cut into slots as wide as the limit. A payment that counts lies in
    the hold's own slot (then the latest payment there is not before the hold)
    or in the next one (then the earliest payment there is within the limit).
    So two timestamps per (user, slot) decide every hold; no pairs are formed.
    """
    paid = with_slot(payments.select(user, ts), ts, ttl_minutes)
    bounds = paid.groupBy(user, SLOT).agg(F.max(ts).alias("_last"), F.min(ts).alias("_first"))
    nothing = F.lit(None).cast(payments.schema[ts].dataType)
    sides = bounds.select(user, F.inline(F.array(
        F.struct(F.col(SLOT), F.col("_last"), nothing.alias("_first")),
        F.struct(plus_minutes(SLOT, -ttl_minutes).alias(SLOT), nothing.alias("_last"),
                 F.col("_first")))))
    decisive = sides.groupBy(user, SLOT).agg(F.max("_last").alias("_last"),
                                             F.min("_first").alias("_first"))
    in_time = (F.coalesce(F.col("_last") >= F.col(ts), F.lit(False))
               | F.coalesce(F.col("_first") <= plus_minutes(ts, ttl_minutes), F.lit(False)))
    return (with_slot(holds, ts, ttl_minutes).join(decisive, [user, SLOT], "left")
            .withColumn("paid", in_time).drop(SLOT, "_last", "_first"))
