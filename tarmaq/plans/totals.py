"""Bookings per period and status, kept up to date by signed changes.

Totals are rows (period, order_status, n). When orders change, what they counted
as before is taken out (-1) and what they count as now is put in (+1); the sums
are folded into the kept totals. So an update costs the changed orders and the
totals, which have a row per period and status, and not the order table. Reports
by month, day or hour read the totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmaq import params as P
from tarmaq.functions.scalars import month_text, percent

KEYS = ["period", "order_status"]
BEFORE = {"date_of_purchase": "old_date", "order_status": "old_status"}
AFTER = {"date_of_purchase": "new_date", "order_status": "new_status"}


def period_of(ts: str, unit: str) -> Column:
    """Start of the month, day or hour."""
    return F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")


def booking_totals(orders: DataFrame, unit: str = "day") -> DataFrame:
    """The full count: (period, order_status, n). Orders without a date have a NULL period."""
    return (orders.groupBy(period_of("date_of_purchase", unit).alias("period"), "order_status")
            .agg(F.count(F.lit(1)).alias("n")))


def order_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What two versions of the orders differ in: (order_id, old_date, old_status, new_date, new_status).

    An order that is new has no old status, one that is gone no new one. Versions
    that are bucketed by order_id alike are compared without a shuffle.
    """
    old = before.select("order_id", *[F.col(c).alias(n) for c, n in BEFORE.items()], F.lit(True).alias("_was"))
    new = after.select("order_id", *[F.col(c).alias(n) for c, n in AFTER.items()], F.lit(True).alias("_is"))
    same = (F.col("_was").eqNullSafe(F.col("_is")) & F.col("old_date").eqNullSafe(F.col("new_date"))
            & F.col("old_status").eqNullSafe(F.col("new_status")))
    return old.join(new, "order_id", "full").filter(~same).drop("_was", "_is")


def signed(changes: DataFrame, unit: str = "day") -> DataFrame:
    """The sums of a change set: (period, order_status, n); what cancels out is left out.

    ``changes``: old_date, old_status, new_date, new_status; a NULL status stands
    for no order. Rows are summed per map task, however many there are of a status.
    """
    rows = changes.select(F.inline(F.array(
        F.struct(period_of("old_date", unit).alias("period"), F.col("old_status").alias("order_status"), F.lit(-1).alias("n")),
        F.struct(period_of("new_date", unit).alias("period"), F.col("new_status").alias("order_status"), F.lit(1).alias("n")))))
    return _summed(rows.filter(F.col("order_status").isNotNull()))


def fold(totals: DataFrame, deltas: DataFrame) -> DataFrame:
    """The totals after the changes; periods and statuses without bookings go."""
    return _summed(totals.select(*KEYS, "n").unionByName(deltas.select(*KEYS, "n")))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n")).filter(F.col("n") != 0)


def cancel_rate(totals: DataFrame, exclude: tuple[str, ...] = (P.PENDING,)) -> DataFrame:
    """The cancellation report by purchase month, read from totals of any unit."""
    counted = totals.filter(F.col("period").isNotNull() & ~F.col("order_status").isin(*exclude)) if exclude else totals
    cancelled = F.when(F.col("order_status") == P.BY_CUSTOMER, F.col("n")).otherwise(0)
    return (counted.groupBy(F.trunc(F.to_date("period"), "MM").alias("month"))
            .agg(F.sum("n").alias("orders"), F.sum(cancelled).alias("cancelled"))
            .select(month_text("month").alias("purchase_month"), "orders",
                    percent(F.col("cancelled"), F.col("orders")).alias("customer_cancellation_rate")))
