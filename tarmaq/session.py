"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. Joins are left to the optimizer:
# a side is broadcast only when its measured size is below Spark's own
# threshold, and a hot join key is split by the adaptive skew-join rule.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A busy user's streamed session is merged per map task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app: str = "tarmaq", master: str | None = None, **conf: str) -> SparkSession:
    builder = (SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               # a checkpoint goes when nothing refers to it any more
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a single-process session (``local[n]``: driver and
    executors are one machine, as in tests) gets a folder of its own; any other
    master must name one that every executor can reach.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = os.path.join(tempfile.gettempdir(), f"tarmaq-{spark.sparkContext.applicationId}")
    return named


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the shared folder. It goes when the application ends.

    All of an application's lie in one folder, named after it, so what a killed
    driver leaves is found and deleted as one.
    """
    context = spark.sparkContext
    own = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/run-{context.applicationId}")
    fs = own.getFileSystem(context._jsc.hadoopConfiguration())
    fs.mkdirs(own)
    fs.deleteOnExit(own)
    return f"{shared_dir(spark).rstrip('/')}/run-{context.applicationId}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def measured(df: DataFrame, purpose: str = "measured") -> DataFrame:
    """The rows as a table in the shared folder, whose size Spark knows when it plans.

    For a small side of a join on a key with few values: it is broadcast if it is
    below the threshold, before anything is shuffled by that key.
    """
    path = run_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
