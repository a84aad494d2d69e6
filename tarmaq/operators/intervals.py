"""Overlap tests on half-open intervals ``[start, end)``.

Two intervals clash when ``a.start < b.end and a.end > b.start``; touching ones
do not. All operators sweep over the end points in time order instead of
pairing rows, so their cost does not depend on how many pairs clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmaq.operators.running import SLICE, SLICE_SECONDS, carry, upto, with_slice, within


def clash_counts(candidates: DataFrame, busy: DataFrame, keys: list[str], start: str, end: str,
                 id_col: str, out: str = "clashes",
                 slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """How many busy intervals of the same key clash with each candidate."""
    asked = _end_points(candidates, keys, start, end, id_col, measured=True, counted=False)
    taken = _end_points(busy.withColumn(id_col, F.lit(None).cast(
        candidates.schema[id_col].dataType)), keys, start, end, id_col,
        measured=False, counted=True)
    return _sweep(asked.unionByName(taken), keys, id_col, out, slice_seconds)


def self_clash_counts(df: DataFrame, keys: list[str], start: str, end: str, id_col: str,
                      out: str = "clashes", keep: tuple[str, ...] = (),
                      slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """How many other intervals of the same key clash with each interval.

    ``keep`` columns of the intervals ride along, which saves a join afterwards.
    """
    points = _end_points(df, keys, start, end, id_col, measured=True, counted=True, keep=keep)
    return _sweep(points, keys, id_col, out, slice_seconds, keep)


# Order of end points at one instant. Intervals end before others begin, so
# touching ones do not clash; an empty interval is asked before it is counted.
_ENDS, _EMPTY_ASKS, _EMPTY, _STARTS = range(4)


def _end_points(df: DataFrame, keys: list[str], start: str, end: str, id_col: str,
                measured: bool, counted: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per interval: what it adds to the running counts, and what to read.

    clashes = (busy starts before my end) - (busy ends up to my start), less 1
    for the interval itself when it is among the busy ones.
    """
    one, empty = int(counted), F.col(start) == F.col(end)

    def point(ts, place, starts, ends, reads_starts, reads_ends, own):
        columns = {"_place": place, "_starts": starts, "_ends": ends,
                   "_reads_starts": int(measured and reads_starts),
                   "_reads_ends": int(measured and reads_ends), "_own": own}
        return F.struct(F.col(ts).alias("_t"), *[F.lit(v).alias(n) for n, v in columns.items()])

    ordinary = F.array(point(start, _STARTS, one, 0, False, True, 0),
                       point(end, _ENDS, 0, one, True, False, one))
    instant = F.array(point(start, _EMPTY_ASKS, 0, 0, True, True, 0),
                      point(end, _EMPTY, one, one, False, False, 0))
    return df.select(*keys, *keep, F.col(id_col).alias("_id"),
                     F.inline(F.when(empty, instant).otherwise(ordinary)))


def _sweep(points: DataFrame, keys: list[str], id_col: str, out: str, slice_seconds: int,
           keep: tuple[str, ...] = ()) -> DataFrame:
    here = upto(keys, F.col("_t"), F.col("_place"))
    line = carry(with_slice(points, "_t", slice_seconds), keys,
                 {"_s": F.sum("_starts"), "_e": F.sum("_ends")},
                 {"_s0": F.sum("_s"), "_e0": F.sum("_e")},
                 local={"_s1": F.sum("_starts").over(here), "_e1": F.sum("_ends").over(here)})
    begun = F.coalesce("_s0", F.lit(0)) + F.col("_s1")
    over = F.coalesce("_e0", F.lit(0)) + F.col("_e1")
    reads = (F.col("_reads_starts") > 0) | (F.col("_reads_ends") > 0)
    seen = line.withColumn("_seen", F.col("_reads_starts") * (begun - F.col("_own"))
                           - F.col("_reads_ends") * over).filter(reads)
    return (seen.groupBy(*keys, F.col("_id").alias(id_col))
            .agg(F.sum("_seen").cast("bigint").alias(out),
                 *[F.any_value(c).alias(c) for c in keep]))


def clashes_with_earlier(df: DataFrame, keys: list[str], start: str, end: str, id_col: str,
                         out: str = "clashes",
                         slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Flag rows that begin while an earlier-starting interval is still open."""
    before = within(keys, F.col(start), F.col(end), F.col(id_col))
    line = carry(with_slice(df, start, slice_seconds), keys,
                 {"_m": F.max(end)}, {"_m0": F.max("_m")}, local={"_m1": F.max(end).over(before)})
    return (line.withColumn("_open", F.greatest("_m0", "_m1"))
            .withColumn(out, F.coalesce(F.col("_open") > F.col(start), F.lit(False)))
            .drop("_m0", "_m1", "_open", SLICE))


def first_clash(df: DataFrame, keys: list[str], start: str, end: str, id_col: str,
                out: str = "first_clash", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """The earliest-starting other interval that clashes with each row, or NULL.

    Ties go to the earlier end, then the smaller id. In that order the first
    interval still open at an instant is always a *peak*: its end exceeds every
    end before it. Peaks rise in time, so the one open at my start is the next
    peak end after my start. When that is the row itself, only the row right
    after it in order can be the first clash.
    """
    me = F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(id_col).alias("i"))
    own = (F.col(start), F.col(end), F.col("_me.i"))

    next_here = F.lead("_me").over(Window.partitionBy(*keys, SLICE).orderBy(*own))
    line = carry(with_slice(df.select(*keys, start, end, me.alias("_me")), start, slice_seconds), keys,
                 {"_m": F.max(end), "_f": F.min("_me")}, {"_m0": F.max("_m")}, {"_f0": F.min("_f")},
                 local={"_m1": F.max(end).over(within(keys, *own)), "_f1": next_here})
    walked = line.select(*keys, end, start, "_me", F.greatest("_m0", "_m1").alias("_before"),
                         F.coalesce("_f1", "_f0").alias("_next"))

    nothing = F.lit(None).cast(walked.schema["_me"].dataType)
    is_peak = F.col("_before").isNull() | (F.col(end) > F.col("_before"))
    points = walked.select(*keys, F.inline(F.array(
        F.struct(F.col(end).alias("_t"), F.lit(0).alias("_place"),
                 F.when(is_peak, F.col("_me")).alias("_peak"), nothing.alias("_row"),
                 nothing.alias("_next")),
        F.struct(F.col(start).alias("_t"), F.lit(1).alias("_place"), nothing.alias("_peak"),
                 F.col("_me").alias("_row"), F.col("_next").alias("_next")))))
    points = points.filter(F.col("_peak").isNotNull() | F.col("_row").isNotNull())
    # The next peak after a point is the lowest one: peaks rise in start and end.
    ahead = within(keys, F.col("_t").desc(), F.col("_place").desc())
    line = carry(with_slice(points, "_t", slice_seconds), keys,
                 {"_p": F.min("_peak")}, {}, {"_p0": F.min("_p")}, local={"_p1": F.min("_peak").over(ahead)})
    found = line.filter(F.col("_row").isNotNull()).withColumn("_open", F.coalesce("_p1", "_p0"))

    other = F.when(F.col("_open.i") == F.col("_row.i"), F.col("_next")).otherwise(F.col("_open"))
    return (found.withColumn("_other", other)
            .select(*keys, F.col("_row.i").alias(id_col), F.col("_row.s").alias(start),
                    F.col("_row.e").alias(end),
                    F.when(F.col("_other.s") < F.col("_row.e"), F.col("_other.i")).alias(out)))
