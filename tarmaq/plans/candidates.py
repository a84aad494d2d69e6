"""Free crew and planes for many new flights at once.

For every new flight and role: the least-loaded members that are fit and have no
open flight at that time. Nearly every member is free for nearly every flight,
so the free ones are never listed. Members are ranked by load instead, and time
is cut into windows:

* A window is two steps wide, and a flight belongs to the window that begins with
  its step. Steps come in a ladder of lengths; a flight takes the shortest one it
  fits into, so that its window contains it.
* In a window, the members that are free for the whole of it are ranks that are
  not among the busy ones. The k-th of them, found by counting busy ranks, is
  the window's *limit*: no flight there ever needs a member beyond it, as k
  better ones are free.
* Up to the limit, a member has free gaps: the whole window, or what its busy
  intervals leave of it. A flight fits a member when one gap contains it.

So a flight meets the few best members of its window, not the pool, and only
busy intervals of members within a limit are looked at closely. The first
``REACH`` ranks come first: a limit among them is the limit, whatever the other
members do. Windows whose limit lies beyond are looked at again with
``REACH_FACTOR`` times as many ranks, until all members are in. Busy ranks are
counted in blocks of ``BLOCK`` ranks, so that a window in which a third of all
members are busy is many groups, and only its first blocks are looked into.
Flights of one window, time and need share their candidates.

The rule is that of the conflict checks: intervals are half-open, touching ones
do not clash. Flights without times, or longer than the last step, have no
candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmaq import params as P
from tarmaq.functions.scalars import moment
from tarmaq.operators.numbering import numbered
from tarmaq.plans.scheduling import is_long
from tarmaq.session import measured

STEP_HOURS, STEP_FACTOR, STEPS = 6, 4, 7  # 6 hours, a day, 4 days .. 1,024 days
BLOCK = 128
REACH, REACH_FACTOR = 128, 16

POOL = ["role", "fit_only"]
WINDOW = [*POOL, "_step", "_window"]


def _seconds(ts: str) -> Column:
    return (F.col(ts) - moment("1970-01-01 00:00:00")).cast("interval second").cast("bigint")


def _lengths(step_hours: int) -> list[int]:
    return [step_hours * 3600 * STEP_FACTOR ** k for k in range(STEPS)]


def crew_demand(flights: DataFrame, rules: dict[str, dict[str, int]] = P.CREW_RULES,
                planes: int = 1) -> DataFrame:
    """What each flight needs: (flight_id, role, start_ts, end_ts, fit_only, seats).

    Long flights need fit members only: trained crew, a large plane. ``planes``
    are the planes to choose from (0: none are asked for).
    """
    long = F.coalesce(is_long(), F.lit(False))
    needs = [F.struct(F.lit(role).alias("role"), F.when(long, rules["long"][role]).otherwise(
        rules["short"][role]).alias("seats")) for role in rules["long"]]
    if planes:
        needs.append(F.struct(F.lit("plane").alias("role"), F.lit(planes).alias("seats")))
    return flights.select("flight_id", "start_ts", "end_ts", long.alias("fit_only"), F.inline(F.array(*needs)))


def ranked(pool: DataFrame) -> DataFrame:
    """Every member's place by load, then name, among all of its role and among the fit ones.

    (role, fit_only, member, load, rank from 0, size of the list)
    """
    lists = F.when(F.coalesce("fit", F.lit(False)), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    listed = numbered(pool.select("role", "member", "load", F.explode(lists).alias("fit_only")),
                      [*POOL, "load", "member"], "_number")
    first = listed.groupBy(*POOL).agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("size"))
    return (listed.join(first, POOL).withColumn("rank", F.col("_number") - F.col("_first"))
            .select(*POOL, "member", "load", "rank", "size"))


def loads(pool: DataFrame, busy: DataFrame) -> DataFrame:
    """``pool`` with load, the number of busy intervals of each member."""
    return (pool.join(busy.groupBy("role", "member").agg(F.count(F.lit(1)).alias("load")), ["role", "member"], "left")
            .withColumn("load", F.coalesce("load", F.lit(0))))


def _placed(demand: DataFrame, lengths: list[int]) -> DataFrame:
    """The flights with times, in the window of the shortest step they fit into."""
    timed = demand.select("flight_id", *POOL, "seats", _seconds("start_ts").alias("_s"), _seconds("end_ts").alias("_e"))
    lasts = F.col("_e") - F.col("_s")
    step = sum(((lasts > n).cast("int") for n in lengths[:-1]), F.lit(0))
    width = F.element_at(F.array(*[F.lit(n) for n in lengths]), F.col("_step") + 1)
    return (timed.filter((F.col("seats") > 0) & (lasts >= 0) & (lasts <= lengths[-1])).withColumn("_step", step)
            .withColumns({"_width": width}).withColumn("_window", F.floor(F.col("_s") / F.col("_width"))))


def _busy_in_windows(busy: DataFrame, members: DataFrame, needed: DataFrame, lengths: dict[int, int]) -> DataFrame:
    """Busy intervals of ranked members, in every window that is asked for: WINDOW, rank, _bs, _be.

    ``lengths``: the steps in use and their seconds.
    """
    intervals = busy.select("role", "member", _seconds("start_ts").alias("_bs"), _seconds("end_ts").alias("_be"))
    steps = F.array(*[F.struct(F.lit(k).alias("_step"), F.lit(n).alias("_width")) for k, n in lengths.items()])
    windows = F.sequence(F.floor(F.col("_bs") / F.col("_width")) - 1, F.floor(F.col("_be") / F.col("_width")))
    cut = (intervals.filter("_be >= _bs").join(members.select(*POOL, "member", "rank"), ["role", "member"])
           .select("*", F.inline(steps))
           .select(*POOL, "rank", "_bs", "_be", "_step", F.explode(windows).alias("_window")))
    return (cut.join(needed.select(*WINDOW), WINDOW, "left_semi").select(*WINDOW, "rank", "_bs", "_be"))


def _limits(needed: DataFrame, taken: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rank beyond which a window needs nobody: (WINDOW, _limit).

    ``taken``: distinct (WINDOW, rank) of busy members. With i busy ranks before a
    busy rank r, r - i ranks before it are free; that number never falls, so the
    k-th free rank is k - 1 plus the number of busy ranks with fewer than k free before.
    """
    block = [*WINDOW, "_block"]
    blocked = taken.withColumn("_block", F.floor(F.col("rank") / BLOCK))
    before = Window.partitionBy(*WINDOW).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = (blocked.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
              .select(*block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
              .join(needed.drop("_width"), WINDOW)
              .filter(F.col("_block") * BLOCK - F.col("_before") < F.col("k")))  # the k-th free one is not before
    own = F.row_number().over(Window.partitionBy(*block).orderBy("rank")) - 1
    free_before = F.col("rank") - F.col("_before") - own
    passed = (blocked.join(counts, block).withColumn("_free", free_before)
              .filter(F.col("_free") < F.col("k")).groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("_passed")))
    return (needed.join(passed, WINDOW, "left").join(sizes, POOL)
            .select(*WINDOW, "_width", F.least(F.col("k") - 1 + F.coalesce("_passed", F.lit(0)), F.col("size") - 1)
                    .alias("_limit")))


def _gaps(limits: DataFrame, taken: DataFrame, intervals: DataFrame) -> DataFrame:
    """Free gaps of the members within the limits: (WINDOW, rank, _gs, _ge)."""
    begin = F.col("_window") * F.col("_width")
    finish = begin + 2 * F.col("_width")
    whole = (limits.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_limit"))).alias("rank"))
             .join(taken, [*WINDOW, "rank"], "left_anti")
             .select(*WINDOW, "rank", begin.alias("_gs"), finish.alias("_ge")))
    near = (intervals.join(limits, WINDOW).filter(F.col("rank") <= F.col("_limit")))
    one = Window.partitionBy(*WINDOW, "rank").orderBy("_bs", "_be").rowsBetween(Window.unboundedPreceding, -1)
    ahead = near.select(*WINDOW, "rank", F.greatest(begin, F.coalesce(F.max("_be").over(one), begin)).alias("_gs"),
                        F.col("_bs").alias("_ge"))
    after = (near.groupBy(*WINDOW, "rank").agg(F.max("_be").alias("_gs"), F.max(finish).alias("_ge")))
    return whole.unionByName(ahead.unionByName(after).filter("_gs <= _ge"))


def shortlist(demand: DataFrame, pool: DataFrame, busy: DataFrame, step_hours: int = STEP_HOURS) -> DataFrame:
    """The ``seats`` least-loaded free members for every flight and role of ``demand``.

    ``demand``: flight_id, role, start_ts, end_ts, fit_only, seats (see ``crew_demand``).
    ``pool``: role, member, fit, load; ties of the load go by member. ``busy``: role,
    member, start_ts, end_ts, the times of open flights; intervals without times
    and members that are not in the pool are not looked at.

    Returns (flight_id, role, place from 1, member, load); fewer rows where fewer
    members are free. Flights are looked at one by one: two of them may get the
    same member for the same time.
    """
    lengths = _lengths(step_hours)
    members = measured(ranked(pool))
    sizes = members.groupBy(*POOL).agg(F.max("size").alias("size"))
    asked = _placed(demand, lengths)
    needed = measured(asked.groupBy(*WINDOW, "_width").agg(F.max("seats").cast("bigint").alias("k")))
    used = {r["_step"]: r["_width"] for r in needed.select("_step", "_width").distinct().collect()}  # STEPS rows at most
    most = members.agg(F.max("size")).first()[0] or 0
    gaps, open_, reach = None, needed, REACH
    while True:
        near = measured(members.filter(F.col("rank") < reach))
        intervals = measured(_busy_in_windows(busy, near, open_, used or {0: lengths[0]}))
        taken = intervals.select(*WINDOW, "rank").distinct()
        limits = measured(_limits(open_, taken, sizes))  # a row per window, read many times
        # a limit beyond the ranks looked at is not known yet
        known = limits if reach >= most else limits.filter(F.col("_limit") < reach)
        found = _gaps(known, taken, intervals)
        gaps = found if gaps is None else gaps.unionByName(found)
        if reach >= most:
            break
        beyond = limits.filter(F.col("_limit") >= reach)
        if beyond.isEmpty():
            break
        open_ = measured(open_.join(beyond.select(*WINDOW), WINDOW, "left_semi"))
        reach *= REACH_FACTOR
    slot = [*WINDOW, "_s", "_e"]
    best = Window.partitionBy(*slot).orderBy("rank")
    # A gap is left by each of two touching intervals, so a moment can lie in two gaps of a member.
    fits = (asked.groupBy(*slot).agg(F.max("seats").alias("_most")).join(gaps, WINDOW)
            .filter((F.col("_gs") <= F.col("_s")) & (F.col("_e") <= F.col("_ge")))
            .select(*slot, "_most", "rank").distinct()
            .withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= F.col("_most"))
            .join(members.drop("size"), [*POOL, "rank"]).select(*slot, "rank", "member", "load"))
    # A flight that is asked for more than once has one list of candidates.
    place = F.dense_rank().over(Window.partitionBy("flight_id", *POOL).orderBy("rank"))
    return (asked.join(measured(fits), slot).withColumn("place", place).filter(F.col("place") <= F.col("seats"))
            .select("flight_id", "role", "fit_only", F.col("place").cast("bigint").alias("place"), "member", "load")
            .distinct().drop("fit_only"))
