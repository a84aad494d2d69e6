"""Reading tables. Columns are named, schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarmaq.schemas import TABLES, schema_of


def scan(spark: SparkSession, folder: str, table: str, columns: list[str] | None = None,
         schema: T.StructType | None = None) -> DataFrame:
    """One Parquet table, only the named columns."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(f"{folder.rstrip('/')}/{table}.parquet")
    return df.select(*columns) if columns else df


MANIFEST = "_manifest"
MANIFEST_SCHEMA = "name string, version int"


def scan_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The sixteen tables of a versioned store under ``folder``.

    The versions are those of the newest complete manifest, so tables that were
    changed together are read together; without a manifest, the newest ones.
    """
    root = folder.rstrip("/")
    valid = manifest(spark, root)
    return {name: scan_version(spark, f"{root}/{name}", schema_of(name), valid.get(name))
            for name in TABLES}


def manifest(spark: SparkSession, folder: str) -> dict[str, int]:
    """Versions by table (a row per table) of the newest complete manifest."""
    known = versions(spark, f"{folder}/{MANIFEST}")
    if not known:
        return {}
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/{MANIFEST}/v={known[-1]}")
    return {r["name"]: r["version"] for r in rows.collect()}


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a table, oldest first (a version without its
    success marker is an aborted write and is not listed)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[2:]) for n in names
                  if n.startswith("v=") and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")))


def scan_version(spark: SparkSession, path: str, schema: T.StructType,
                 version: int | None = None) -> DataFrame:
    """The newest (or the given) version of a table; empty when there is none."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v={version or known[-1]}")
