"""Holds that lapse: the streaming twin of the batch expiry rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmaq.streaming import event_time


def lapsed_holds(holds: DataFrame, payments: DataFrame, user: str, hold_id: str, ts: str,
                 ttl_minutes: int, delay: str = "1 hour") -> DataFrame:
    """Holds for which no payment arrives in [ts, ts + ttl], once that is certain.

    As in the batch rule, time is cut into slots as wide as the limit and the
    payments of a user around a slot are folded to two timestamps: the last one
    in the slot and the first one in the next. That is one row of state per
    user and window of two slots, and each hold meets at most that one row, so
    neither side forms pairs. The watermark closes the windows and drops the
    state.
    """
    limit = F.expr(f"INTERVAL {ttl_minutes} MINUTES")
    both_slots = (f"{2 * ttl_minutes} minutes", f"{ttl_minutes} minutes")

    # The window carries the event time from here on; the plain copy is for comparing.
    plain = holds.select(hold_id, user, ts, F.col(ts).cast("timestamp").alias("_held_at"))
    held = (event_time(plain, ts, delay).withColumn("_around", F.window(ts, *both_slots))
            .filter(F.col("_held_at") < F.col("_around.start") + limit).drop(ts))
    paid_at, next_slot = F.col("_paid_at"), F.col("_around.start") + limit
    paid = (event_time(payments.select(F.col(user).alias("_payer"), F.col(ts).alias("_paid_at")),
                       "_paid_at", delay)
            .withColumn("_around", F.window("_paid_at", *both_slots))
            .groupBy("_payer", "_around")
            .agg(F.max(F.when(paid_at < next_slot, paid_at)).alias("_last"),
                 F.min(F.when(paid_at >= next_slot, paid_at)).alias("_first"))
            .withColumnRenamed("_around", "_window"))
    met = held.join(paid, (F.col(user) == F.col("_payer")) & (F.col("_around") == F.col("_window")),
                    "left_outer")
    in_time = (F.coalesce(F.col("_last") >= F.col("_held_at"), F.lit(False))
               | F.coalesce(F.col("_first") <= F.col("_held_at") + limit, F.lit(False)))
    return met.filter(~in_time).select(
        hold_id, user, F.col("_held_at").cast("timestamp_ntz").alias("held_at"))
