"""Writing tables and reports."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tarmaq.operators.relations import not_existing
from tarmaq.schemas import TABLES
from tarmaq.sources.scans import MANIFEST, MANIFEST_SCHEMA, manifest, versions


def write_version(df: DataFrame, path: str) -> int:
    """Write the next version of a table; readers see it once it is complete."""
    known = versions(df.sparkSession, path)
    version = known[-1] + 1 if known else 1
    df.write.mode("overwrite").parquet(f"{path}/v={version}")
    return version


def publish(spark: SparkSession, folder: str, changed: dict[str, DataFrame]) -> dict[str, int]:
    """Write new versions of several tables, and then the manifest that makes them valid.

    Readers go by the newest complete manifest: until it is written they see the
    old versions of all tables, and a job that stops in between changes nothing.
    """
    root = folder.rstrip("/")
    before = {name: versions(spark, f"{root}/{name}") for name in TABLES}
    valid = {name: known[-1] for name, known in before.items() if known} | manifest(spark, root)
    if not versions(spark, f"{root}/{MANIFEST}"):  # what is there now stays valid until the end
        _write_manifest(spark, root, valid)
    fresh = {name: write_version(df, f"{root}/{name}") for name, df in changed.items()}
    _write_manifest(spark, root, valid | fresh)
    return fresh


def _write_manifest(spark: SparkSession, root: str, valid: dict[str, int]) -> None:
    rows = spark.createDataFrame(sorted(valid.items()), MANIFEST_SCHEMA)
    write_version(rows.coalesce(1), f"{root}/{MANIFEST}")  # a row per table


def append_new(df: DataFrame, existing: DataFrame, path: str, keys: list[str]) -> None:
    """Append only the rows whose key is not there yet, so a rerun adds nothing.

    Two writers could both find a key missing, so one at a time holds the table's
    lock file; the other one fails at once. A lock that a dead job has left names
    that job and is to be deleted by hand.
    """
    with exclusive(df.sparkSession, path):
        not_existing(df, existing, keys).write.mode("append").parquet(path)


@contextmanager
def exclusive(spark: SparkSession, path: str):
    """Hold the lock file of a table: it is created only if it is not there, in one step."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    lock = hadoop.Path(f"{path.rstrip('/')}._lock")
    fs = lock.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = fs.create(lock, False)
    except Py4JJavaError as error:
        if not fs.exists(lock):
            raise
        raise RuntimeError(f"another job writes {path}: {lock.toString()} is there") from error
    try:
        out.write(bytearray(spark.sparkContext.applicationId, "utf-8"))
        out.close()
        yield
    finally:
        fs.delete(lock, False)


def write_report(df: DataFrame, folder: str, name: str, fmt: str = "parquet") -> str:
    """Keep a report for display, in as many files as its last stage has tasks.

    Adaptive execution merges small partitions, so a small report is one file.
    """
    target = f"{folder.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(target)
    return target


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Store a fact bucketed by its join key.

    Tables bucketed alike (flights, orders, seats and prices by flight, say)
    join and aggregate on that key without a shuffle.
    """
    (df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)


def colocate(tables: dict[str, DataFrame], folder: str, key: str, buckets: int) -> dict[str, DataFrame]:
    """Store tables bucketed by one key into equally many buckets, and read them so.

    What joins or groups by that key then needs no shuffle. Table names are new
    ones of this session's catalog; the files lie under ``folder``.
    """
    run = uuid.uuid4().hex
    return {name: write_bucketed(df, f"{name}_{run}", f"{folder.rstrip('/')}/{name}", key, buckets)
            for name, df in tables.items()}
