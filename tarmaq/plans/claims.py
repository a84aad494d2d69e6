"""Seat claims: first come, first served, all seats of an order or none.

A request is a set of seats of one flight. In request order, an order gets its
seats when all of them are still free; otherwise it gets none and blocks
nobody. Flights do not touch each other, so the rule is one fold per flight over
its orders in time - but a popular flight may have any number of orders.

Of the orders that want the very same seats only the earliest can get them: if
it does not, one of the seats is gone for good. So orders are reduced to the
first of each seat set, per map task already, and what is folded in a task is
bounded by the different sets that fit into a plane, not by the demand. The
fold runs inside the JVM and holds one flight's sets. A flight with more than
``FOLD`` of them is first thinned by rounds of set operations, spread over its
seats: a set that is first for each of its seats is accepted, what wants a seat
of an accepted one is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmaq.session import cut_lineage

SEAT = ["flight_id", "s_row", "s_column"]
#: Different seat sets of one flight that are folded in one task.
FOLD = 20_000


def claim_single(requests: DataFrame, order: list[str]) -> DataFrame:
    """One-seat requests: the earliest request per seat wins."""
    rest = [c for c in requests.columns if c not in SEAT]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return requests.groupBy(*SEAT).agg(first.alias("_win")).select(*SEAT, "_win.*")


def seat_code() -> Column:
    """A seat of a plane as one number."""
    return F.shiftleft(F.col("s_row").cast("bigint"), 32).bitwiseOR(F.col("s_column").cast("bigint"))


def claim_all_or_nothing(requests: DataFrame, seats: DataFrame | None = None, fold: int = FOLD) -> DataFrame:
    """Decide every order: (order_id, flight_id, seats, accepted).

    ``requests``: order_id, flight_id, s_row, s_column, requested_ts, a row per
    seat. ``seats``: the seat table; only free, existing seats can be claimed
    (None: every seat exists and is free). If both have a class_type, the seat
    must be of the class that was asked for. If the seats have a free_from
    (NULL: always), a request before that moment does not get the seat.
    """
    classed = seats is not None and "class_type" in requests.columns and "class_type" in seats.columns
    wants = (requests.groupBy("order_id", *SEAT)
             .agg(F.count(F.lit(1)).alias("_times"), F.min("requested_ts").alias("_ts"),
                  *([F.min("class_type").alias("_class"),
                     F.max("class_type").alias("_class2")] if classed else [])))
    if seats is None:
        wants = wants.withColumn("_free", F.lit(True))
    else:
        timed = "free_from" in seats.columns
        since = F.col("free_from") if timed else F.lit(None).cast(requests.schema["requested_ts"].dataType)
        free = (seats.filter(F.col("order_id").isNull())
                .select(*SEAT, since.alias("_since"),
                        *(["class_type"] if classed else [])).dropDuplicates(SEAT))
        fits = F.col("_since").isNull() | (F.col("_ts") >= F.col("_since"))
        if classed:
            fits &= (F.col("_class") == F.col("class_type")) & (F.col("_class2") == F.col("_class"))
        wants = (wants.join(free.withColumn("_hit", F.lit(True)), SEAT, "left")
                 .withColumn("_free", F.coalesce(F.col("_hit") & fits, F.lit(False))))
    # The same seat twice, or a seat that cannot be had, fails the whole order.
    orders = cut_lineage(wants.groupBy("order_id", "flight_id").agg(
        F.sum("_times").alias("seats"), F.min("_ts").alias("_ts"),
        F.sort_array(F.collect_list(seat_code())).alias("_set"),  # the seats of one order
        F.bool_and((F.col("_times") == 1) & F.coalesce("_free", F.lit(False))).alias("_sound")))
    sets = (orders.filter("_sound").groupBy("flight_id", "_set")
            .agg(F.min(F.struct("_ts", "order_id")).alias("_rank")))
    accepted, left = _thinned(sets, fold)
    accepted = accepted + [_folded(left)]
    won = accepted[0]
    for more in accepted[1:]:
        won = won.unionByName(more)
    return (orders.join(won.withColumn("_won", F.lit(True)), ["flight_id", "order_id"], "left")
            .select("order_id", "flight_id", "seats", F.coalesce("_won", F.lit(False)).alias("accepted")))


def _folded(sets: DataFrame) -> DataFrame:
    """(flight_id, order_id) of what each flight accepts of its sets, in the order of their ranks."""
    rank, taken = sets.schema["_rank"].dataType, "array<bigint>"
    winners = f"array<{rank['order_id'].dataType.simpleString()}>"
    nothing = F.struct(F.array().cast(taken).alias("taken"), F.array().cast(winners).alias("won"))

    def claim(state, one):
        after = F.struct(F.concat(state["taken"], one["_set"]).alias("taken"),
                         F.concat(state["won"], F.array(one["_rank"]["order_id"])).alias("won"))
        return F.when(F.arrays_overlap(state["taken"], one["_set"]), state).otherwise(after)

    in_order = F.array_sort(F.collect_list(F.struct("_rank", "_set")))
    return (sets.groupBy("flight_id").agg(in_order.alias("_asked"))
            .select("flight_id", F.explode(F.aggregate("_asked", nothing, claim)["won"]).alias("order_id")))


def _thinned(sets: DataFrame, fold: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds until no flight has more than ``fold`` undecided sets: what they accepted, and what is left.

    Usually there is nothing to do. A round decides at least the earliest set of
    every flight and all that want one of its seats, so a flight takes no more
    rounds than it has seats.
    """
    accepted: list[DataFrame] = []
    while True:
        sets = cut_lineage(sets)
        sizes = sets.groupBy("flight_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > fold)
        crowded = cut_lineage(sizes.select("flight_id"))
        if crowded.isEmpty():
            return accepted, sets
        decided = cut_lineage(_round(sets.join(crowded, "flight_id", "left_semi")))
        accepted.append(decided.filter("_won").select("flight_id", F.col("_rank.order_id").alias("order_id")))
        still = decided.filter(~F.col("_won") & ~F.col("_lost")).select(*sets.columns)
        sets = sets.join(crowded, "flight_id", "left_anti").unionByName(still)


def _round(sets: DataFrame) -> DataFrame:
    """Mark every set that is first for all its seats as won, and what wants a seat of those as lost.

    Groups are seats, folded per map task, or the seats of one set.
    """
    key = ["flight_id", "_rank"]
    wants = sets.select(*key, F.explode("_set").alias("_seat"))
    first = wants.groupBy("flight_id", "_seat").agg(F.min("_rank").alias("_first"))
    led = wants.join(first, ["flight_id", "_seat"]).groupBy(*key).agg(
        F.bool_and(F.col("_rank") == F.col("_first")).alias("_won"))
    marked = sets.join(led, key)
    taken = marked.filter("_won").select("flight_id", F.explode("_set").alias("_seat")).withColumn("_hit", F.lit(True))
    lost = (wants.join(taken, ["flight_id", "_seat"]).groupBy(*key).agg(F.any_value("_hit").alias("_lost")))
    return marked.join(lost, key, "left").withColumn("_lost", F.coalesce("_lost", F.lit(False)) & ~F.col("_won"))


def apply_claims(seats: DataFrame, requests: DataFrame, decided: DataFrame) -> DataFrame:
    """The seat table with the seats of accepted orders linked to them."""
    won = (requests.join(decided.filter("accepted").select("order_id"), "order_id")
           .select(*SEAT, F.col("order_id").alias("_order")))
    return (seats.join(won, SEAT, "left")
            .withColumn("order_id", F.coalesce("order_id", "_order")).select(*seats.columns))
