"""Tables in buckets by one key, rewritten bucket by bucket.

Every table of such a store is cut by the same key (the flight) into the same
number of buckets, so all that belongs to a flight lies in the bucket of that
number in every table. A change of some flights reads and writes their buckets
only; the others stay where they are:

    store/orders/v=1/_bucket=0 .. _bucket=63      all of them
    store/orders/v=2/_bucket=7                    one was written anew
    store/_buckets/v=2                            which version each bucket has

The manifest is written last, for all tables at once. Until then readers see the
old buckets, and a job that stops in between changes nothing. There is one
writer at a time; old versions stay readable for jobs that began before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmaq.sources.scans import versions
from tarmaq.sources.sinks import write_version

BUCKET = "_bucket"
MANIFEST = "_buckets"
#: A row per table and bucket that has rows; ``buckets`` is the number of all.
MANIFEST_SCHEMA = "name string, bucket int, version int, buckets int, key string"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def create(spark: SparkSession, store: str, tables: dict[str, DataFrame], key: str, buckets: int) -> None:
    """Write whole tables in buckets. A NULL key has a bucket like any other."""
    _publish(spark, store, tables, key, buckets, range(buckets))


def manifest(spark: SparkSession, store: str) -> list:
    """The rows of the newest complete manifest: as many as tables times buckets."""
    known = versions(spark, f"{store}/{MANIFEST}")
    if not known:
        return []
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{store}/{MANIFEST}/v={known[-1]}").collect()


def layout(spark: SparkSession, store: str) -> tuple[str, int]:
    """The key and the number of buckets of a store."""
    row = manifest(spark, store)[0]
    return row["key"], row["buckets"]


def read(spark: SparkSession, store: str, name: str, schema: T.StructType,
         only: list[int] | None = None) -> DataFrame:
    """A table as the manifest has it, or some buckets of it."""
    paths = [f"{store}/{name}/v={r['version']}/{BUCKET}={r['bucket']}" for r in manifest(spark, store)
             if r["name"] == name and (only is None or r["bucket"] in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def touched(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets in which some keys lie."""
    rows = keys.select(bucket_of(key, buckets).alias(BUCKET)).distinct().collect()  # no more than there are buckets
    return sorted(r[BUCKET] for r in rows)


def rewrite(spark: SparkSession, store: str, changed: dict[str, DataFrame], only: list[int]) -> None:
    """Put new rows in the place of some buckets of some tables, all at once."""
    key, buckets = layout(spark, store)
    _publish(spark, store, changed, key, buckets, only)


def _publish(spark: SparkSession, store: str, tables: dict[str, DataFrame], key: str, buckets: int, only) -> None:
    only = set(only)
    rows = [tuple(r) for r in manifest(spark, store) if r["name"] not in tables or r["bucket"] not in only]
    for name, df in tables.items():
        placed = df.withColumn(BUCKET, bucket_of(key, buckets))
        path = f"{store}/{name}"
        version = (versions(spark, path) or [0])[-1] + 1
        placed.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/v={version}")
        written = _written(spark, f"{path}/v={version}")
        if not only.issuperset(written):  # not in the manifest yet, so nothing has changed
            raise ValueError(f"{name} has rows outside the buckets that are rewritten")
        rows += [(name, bucket, version, buckets, key) for bucket in written]
    write_version(spark.createDataFrame(sorted(rows), MANIFEST_SCHEMA).coalesce(1), f"{store}/{MANIFEST}")


def _written(spark: SparkSession, path: str) -> list[int]:
    """The buckets of one version that have rows."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return [int(n.partition("=")[2]) for n in names if n.startswith(f"{BUCKET}=")]
