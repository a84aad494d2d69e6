"""State changes as whole-table rewrites.

Each takes the tables and an ``as_of`` and returns the tables as they are
afterwards, to be written as a new version directory. Nothing is updated in
place, so a failed job leaves the previous version untouched.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmaq import params as P
from tarmaq.functions.scalars import flag, money, moment, plus_hours, plus_minutes
from tarmaq.operators.numbering import numbered
from tarmaq.operators.relations import clear, release


def refresh_status(flights: DataFrame, as_of: str) -> DataFrame:
    """Open flights whose departure has passed become Completed."""
    gone = F.col("flight_status").isin(*P.OPEN_FLIGHT) & (F.col("takeoff_ts") < moment(as_of))
    return flights.withColumn("flight_status",
                              F.when(gone, P.COMPLETED).otherwise(F.col("flight_status")))


def is_expired(as_of: str, ttl_minutes: int = P.HOLD_MINUTES) -> Column:
    """Unpaid and strictly older than the limit."""
    stale = ((F.col("order_status") == P.PENDING)
             & (F.col("date_of_purchase") < plus_minutes(moment(as_of), -ttl_minutes)))
    return F.coalesce(stale, F.lit(False))


def expire_holds(orders: DataFrame, seats: DataFrame, as_of: str,
                 ttl_minutes: int = P.HOLD_MINUTES) -> tuple[DataFrame, DataFrame]:
    """Drop expired orders and free their seats."""
    expired = is_expired(as_of, ttl_minutes)
    return (orders.filter(~expired),
            release(seats, orders.filter(expired).select("order_id"), "order_id"))


def confirm_payment(orders: DataFrame, payments: DataFrame,
                    ttl_minutes: int | None = P.HOLD_MINUTES) -> tuple[DataFrame, DataFrame]:
    """Pending orders with a payment in time become Active at the time of the first one.

    A payment counts from the moment of the hold until it lapses (None: holds do
    not lapse). Second result: payments that confirmed nothing, because there
    was no such pending order, the time was wrong, or another payment had done
    it - a repeated payment too, row by row.
    """
    columns = payments.columns
    due = (orders.filter(F.col("order_status") == P.PENDING)
           .select("order_id", F.col("date_of_purchase").alias("_held")))
    in_time = F.col("paid_at") >= F.col("_held")
    if ttl_minutes is not None:
        in_time &= F.col("paid_at") <= plus_minutes("_held", ttl_minutes)
    others = [c for c in columns if c not in ("order_id", "paid_at")]
    first = (payments.join(due, "order_id").filter(in_time).groupBy("order_id")
             .agg(F.min(F.struct("paid_at", *others)).alias("_first")))
    matched = (orders.join(first.select("order_id", F.col("_first.paid_at").alias("_paid")),
                           "order_id", "left")
               .withColumn("_pays", (F.col("order_status") == P.PENDING)
                           & F.col("_paid").isNotNull()))
    confirmed = (matched.withColumns({
        "date_of_purchase": F.when(F.col("_pays"), F.col("_paid"))
        .otherwise(F.col("date_of_purchase")),
        "order_status": F.when(F.col("_pays"), P.ACTIVE).otherwise(F.col("order_status"))})
        .select(*orders.columns))
    # Equal payments are counted, less the one that confirmed the order.
    used = first.select("order_id", "_first.*", F.lit(1).alias("_used"))
    same = reduce(and_, [F.col(f"p.{c}").eqNullSafe(F.col(f"u.{c}")) for c in columns])
    left = (payments.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).alias("p")
            .join(used.alias("u"), same, "left")
            .select(*[F.col(f"p.{c}") for c in columns],
                    (F.col("_n") - F.coalesce("_used", F.lit(0))).cast("int").alias("_n")))
    rejected = (left.filter(F.col("_n") > 0)
                .select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_k"))
                .drop("_k"))
    return confirmed, rejected


def cancel_decisions(orders: DataFrame, as_of: str, hours: int = P.CUSTOMER_CANCEL_HOURS,
                     fee=P.CANCEL_FEE) -> DataFrame:
    """Decide a batch of customer cancellations.

    ``orders`` carries order_status, takeoff_ts and total. The refund is the
    total less the fee, so both always add up to what was paid.
    """
    in_time = F.col("takeoff_ts") > plus_hours(moment(as_of), hours)
    decision = (F.when(F.col("order_status") != P.ACTIVE, "not_active")
                .when(in_time, "accepted").otherwise("too_late"))
    charged = F.round(money("total") * F.lit(fee).cast("decimal(3,2)"), 2)
    accepted = F.col("decision") == "accepted"
    return orders.withColumn("decision", decision).withColumns({
        "fee": money(F.when(accepted, charged).otherwise(0)),
        "refund": money(F.when(accepted, F.col("total") - charged).otherwise(0))})


def apply_customer_cancel(orders: DataFrame, seats: DataFrame,
                          decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    accepted = decisions.filter(F.col("decision") == "accepted").select("order_id").distinct()
    marked = orders.join(accepted.withColumn("_hit", F.lit(True)), "order_id", "left")
    changed = marked.withColumn("order_status", F.when(F.col("_hit"), P.BY_CUSTOMER)
                                .otherwise(F.col("order_status"))).select(*orders.columns)
    return changed, release(seats, accepted, "order_id")


def flight_cancel_decisions(requests: DataFrame, flights: DataFrame, as_of: str,
                            hours: int = P.FLIGHT_CANCEL_HOURS) -> DataFrame:
    """Only the assigned manager may cancel an open flight, 72 hours ahead or more.

    Several requests for one flight are one: any of them may be the manager's.
    """
    asked = requests.select("flight_id", F.col("manager_id").alias("_asks")).distinct()
    decided = (asked.join(flights, "flight_id", "left")
               .withColumn("decision",
                           F.when(F.col("flight_status").isNull(), "not_found")
                           .when(F.col("_asks") != F.col("manager_id"), "not_manager")
                           .when(~F.col("flight_status").isin(*P.OPEN_FLIGHT), "not_open")
                           .when(F.col("takeoff_ts") < plus_hours(moment(as_of), hours),
                                 "too_late")
                           .otherwise("accepted")))
    return decided.select("flight_id", F.col("_asks").alias("manager_id"), "decision")


def cancelled_flights(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("decision") == "accepted").select("flight_id").distinct()


def flight_cancel_refunds(cancelled: DataFrame, orders: DataFrame,
                          totals: DataFrame) -> DataFrame:
    """Per cancelled flight: how many paid orders are refunded, and how much.

    ``totals`` (order_id, total); orders that hold no priced seat refund 0.
    """
    paid = (orders.filter(F.col("order_status") == P.ACTIVE)
            .join(cancelled, "flight_id", "left_semi")
            .select("order_id", "flight_id").join(totals, "order_id", "left"))
    summed = paid.groupBy("flight_id").agg(F.count(F.lit(1)).alias("refunded_orders"),
                                           F.sum(F.coalesce("total", money(F.lit(0))))
                                           .alias("total_refunded"))
    return (cancelled.join(summed, "flight_id", "left")
            .withColumns({"refunded_orders": F.coalesce("refunded_orders", F.lit(0)),
                          "total_refunded": F.coalesce(money("total_refunded"),
                                                       money(F.lit(0)))}))


def cancel_flights(cancelled: DataFrame, flights: DataFrame, orders: DataFrame,
                   seats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cascade: flight cancelled, paid and pending orders void, seats free."""
    hit = cancelled.withColumn("_hit", F.lit(True))
    new_flights = (flights.join(hit, "flight_id", "left")
                   .withColumn("flight_status", F.when(F.col("_hit"), P.CANCELLED)
                               .otherwise(F.col("flight_status"))).select(*flights.columns))
    voided = F.col("_hit") & F.col("order_status").isin(P.ACTIVE, P.PENDING)
    new_orders = (orders.join(hit, "flight_id", "left")
                  .withColumn("order_status", F.when(voided, P.BY_SYSTEM)
                              .otherwise(F.col("order_status"))).select(*orders.columns))
    return new_flights, new_orders, clear(seats, cancelled, "flight_id", "order_id")


def void_sales(cancelled: DataFrame, sales: DataFrame) -> DataFrame:
    """The cascade for rows that hold an order with its seat: flight_id, order_id, order_status.

    One join changes both: paid and pending orders are void, and ``seat_order``
    is the order that holds the seat afterwards, NULL on a cancelled flight.
    """
    hit = F.col("_hit").isNotNull()
    return (sales.join(cancelled.select("flight_id").distinct().withColumn("_hit", F.lit(True)), "flight_id", "left")
            .withColumn("seat_order", F.when(~hit, F.col("order_id")))
            .withColumn("order_status", F.when(hit & F.col("order_status").isin(P.ACTIVE, P.PENDING), P.BY_SYSTEM)
                        .otherwise(F.col("order_status")))
            .select(*sales.columns, "seat_order"))


def derive_full(flights: DataFrame, tally: DataFrame, held: str = "kept",
                count_empty: bool = False) -> DataFrame:
    """Scheduled flights without a free seat become Full.

    A flight that has no seats at all counts as full only when asked for.
    """
    joined = flights.join(tally.select("flight_id", "seats", F.col(held).alias("_held")),
                          "flight_id", "left")
    full = F.coalesce(F.col("_held") == F.col("seats"), F.lit(count_empty))
    change = (F.col("flight_status") == P.SCHEDULED) & full
    return joined.withColumn("flight_status", F.when(change, P.FULL)
                             .otherwise(F.col("flight_status"))).select(*flights.columns)


def derive_order_completed(orders: DataFrame, flights: DataFrame) -> DataFrame:
    """Active orders of completed flights become Completed."""
    done = (flights.filter(F.col("flight_status") == P.COMPLETED)
            .select("flight_id", F.lit(True).alias("_done")))
    change = (F.col("order_status") == P.ACTIVE) & F.coalesce("_done", F.lit(False))
    return (orders.join(done, "flight_id", "left")
            .withColumn("order_status", F.when(change, P.COMPLETED)
                        .otherwise(F.col("order_status"))).select(*orders.columns))


def assign_codes(df: DataFrame, order: list[str], width: int = P.ORDER_CODE_WIDTH,
                 name: str = "code", existing: DataFrame | None = None) -> DataFrame:
    """Unique zero-padded codes; they grow wider when the numbers do.

    Numbers go on after the highest of the ``existing`` codes (a frame with the
    codes in its first column; those that are no numbers do not count).
    """
    number = F.col("_number")
    if existing is not None:
        code = F.col(existing.columns[0])
        digits = F.when(code.rlike("^[0-9]+$"), code.cast("bigint"))
        number = number + existing.agg(F.coalesce(F.max(digits), F.lit(0)).alias("m")).scalar()
    text = number.cast("string")
    padded = F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))
    return numbered(df, order, "_number").withColumn(name, padded).drop("_number")


def status_changes(before: DataFrame, after: DataFrame, key: str, status: str) -> DataFrame:
    """How many rows went from which status to which."""
    old = before.select(key, F.col(status).alias("old_status"))
    new = after.select(key, F.col(status).alias("new_status"))
    return (old.join(new, key).groupBy("old_status", "new_status")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(flag(F.col("old_status") != F.col("new_status"))).alias("changed")))
