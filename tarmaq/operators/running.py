"""Running values over time that stay spread out when one key is hot.

A window partitioned by a key puts all rows of the key into one task, which
does not hold for a key with a third of the table. So every key is cut into
slices of a fixed length of time. Inside a slice an ordinary window runs; what
it needs from the slices before (or after) it is one small row per (key,
slice), carried across by a second window over those rows only. A key has no
more of them than the table's time span has slices.

There is one plan for every size and every key, and nothing is looked up in
advance. The busiest ``slice_seconds`` of a key are the most a window gathers;
take a shorter slice for data with sharper bursts.

Keys and timestamps are NOT NULL in the data model.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmaq.functions.scalars import moment

SLICE = "_slice"
SLICE_SECONDS = 3600


def with_slice(df: DataFrame, ts: str, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add the number of the time slice that the row falls into."""
    since = (F.col(ts) - moment("1970-01-01 00:00:00")).cast("interval second").cast("bigint")
    return df.withColumn(SLICE, F.floor(since / slice_seconds))


def carry(sliced: DataFrame, keys: list[str], totals: dict[str, Column],
          earlier: dict[str, Column], later: dict[str, Column] | None = None,
          local: dict[str, Column] | None = None) -> DataFrame:
    """The sliced rows with what the other slices of their key add up to.

    ``totals`` are aggregates within a slice; ``earlier`` and ``later`` are
    aggregates of the totals over the slices before and after. ``local`` are
    windows over (keys, slice); they come first, so that their sort serves the
    join as well.

    The rows are dealt out by (keys, slice) once, and both the totals and the
    rows read that exchange. Spark reuses it only if both ask for the same rows
    and columns: so NULLs, which the join would drop, go before, and the totals
    look at every column.
    """
    present = [F.col(c).isNotNull() for c in (*keys, SLICE)]
    rows = sliced.filter(reduce(and_, present)).repartition(*keys, SLICE)
    all_columns = F.max(F.xxhash64(*sliced.columns)).alias("_all")
    per_slice = (rows.groupBy(*keys, SLICE).agg(*[c.alias(n) for n, c in totals.items()], all_columns)
                 .filter(F.col("_all").isNotNull()))
    span = (Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(*span)
    after = Window.partitionBy(*keys).orderBy(F.desc(SLICE)).rowsBetween(*span)
    carried = per_slice.select(
        *keys, SLICE, *[c.over(before).alias(n) for n, c in earlier.items()],
        *[c.over(after).alias(n) for n, c in (later or {}).items()])
    return rows.withColumns(local or {}).join(carried, [*keys, SLICE])


def within(keys: list[str], *order: Column):
    """Rows of the slice before the current one, in the given order."""
    return (Window.partitionBy(*keys, SLICE).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, -1))


def upto(keys: list[str], *order: Column):
    return (Window.partitionBy(*keys, SLICE).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
