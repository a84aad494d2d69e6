"""Totals that follow a stream of booking changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmaq.plans.totals import fold, signed
from tarmaq.sources.scans import versions

TOTALS = "period timestamp_ntz, order_status string, n bigint"


def drain_totals(changes: DataFrame, target: str, unit: str = "day", start: DataFrame | None = None) -> DataFrame:
    """Fold the changes that are there into the totals; the totals after them.

    ``changes``: old_date, old_status, new_date, new_status, a row per change of a
    booking (NULL status: not there). ``start``: totals to begin with. A batch reads
    the totals of the batch before it and writes its own next to them, so a batch
    that is run again replaces its own output, and its cost does not grow with
    the stream. A later run with the same ``target`` folder goes on.
    """
    spark = changes.sparkSession
    folder = f"{target}/totals"
    if not versions(spark, folder):
        first = start if start is not None else spark.createDataFrame([], TOTALS)
        first.select(F.col("period").cast("timestamp_ntz"), "order_status", F.col("n").cast("bigint")).write.mode(
            "overwrite").parquet(f"{folder}/v=0")

    def kept(session, before: int | None = None) -> DataFrame:
        known = [v for v in versions(session, folder) if before is None or v < before]
        return session.read.schema(TOTALS).parquet(f"{folder}/v={known[-1]}")

    def add(batch: DataFrame, epoch: int) -> None:
        version = epoch + 1  # the start is version 0
        (fold(kept(batch.sparkSession, version), signed(batch, unit))
         .write.mode("overwrite").parquet(f"{folder}/v={version}"))

    (changes.writeStream.foreachBatch(add).option("checkpointLocation", f"{target}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return kept(spark)
