"""Dense numbering of a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmaq.session import cut_lineage

# Fixed value: the upper bits of a monotonic id are its partition.
RANGE_SHIFT = 33


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in the given (total) order.

    A distributed sort puts the rows into ordered ranges; a row's number is its
    position in its range plus the sizes of the ranges before it. The ranges
    come from a sample, so a reliable checkpoint fixes them before they are
    counted; after that nothing is shuffled again.
    """
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    fixed = cut_lineage(placed).withColumn("_range", F.shiftright("_place", RANGE_SHIFT))
    sizes = fixed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # One row per range: as many rows as there are shuffle partitions.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0))
                           .alias("_offset"))
    within = F.col("_place") - F.shiftleft("_range", RANGE_SHIFT)
    return (fixed.join(offsets, "_range")
            .withColumn(name, F.col("_offset") + within + F.lit(start))
            .drop("_range", "_offset", "_place"))
