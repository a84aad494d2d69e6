"""Structured Streaming twins of the time-driven rules.

Sources are file sources; ``drain`` runs a query over what is there and stops.
Output and state live in a ``target`` folder that the caller names: a later run
with the same target goes on where the last one stopped. Output goes to files,
never through the driver.

A watermark never passes the last event, so the end of a finished stream would
stay open. ``open_files`` therefore reads a second, empty folder along with the
data, and ``drain`` can put closing rows into it once all data have been read;
they lie so far ahead that every window before them closes, and they themselves
stay open and are never emitted.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Event time of closing rows.
CLOSING = datetime(2200, 1, 1)


def read_files(spark: SparkSession, folder: str, schema: T.StructType,
               pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def open_files(spark: SparkSession, folder: str, schema: T.StructType, target: str,
               pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of files that can be closed (see ``drain``)."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{target}/closing")
    return read_files(spark, folder, schema, pattern, files_per_trigger).unionByName(
        read_files(spark, f"{target}/closing", schema))


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarked event time; watermarks need a zoned timestamp."""
    return df.withColumn(ts, df[ts].cast("timestamp")).withWatermark(ts, delay)


def with_keyed_state(spark: SparkSession) -> SparkSession:
    """State that a keyed processor reads and writes entry by entry needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def drain(stream: DataFrame, target: str, closing: DataFrame | None = None) -> DataFrame:
    """Run an append-mode query over the available files; all its output so far.

    With ``closing`` rows (of the source's columns, at ``CLOSING``; one for each
    watermarked input), the stream is read to its end and closed.
    """
    spark = stream.sparkSession
    _run(stream, target)
    if closing is not None:
        folder = f"{target}/closing"
        if spark.read.schema(closing.schema).parquet(folder).isEmpty():
            closing.write.mode("append").parquet(folder)
        _run(stream, target)
    return spark.read.schema(stream.schema).parquet(f"{target}/out")


def _run(stream: DataFrame, target: str) -> None:
    (stream.writeStream.outputMode("append").format("parquet")
     .option("path", f"{target}/out").option("checkpointLocation", f"{target}/state")
     .trigger(availableNow=True).start().awaitTermination())
