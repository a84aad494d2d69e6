"""Joins, set operations and keyed rewrites.

No operator forces a broadcast: Spark broadcasts a side whose measured size is
below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise. The
probed side of a semi or anti join is reduced to its distinct keys first, so a
key that fills a third of it crosses the network once per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exists_in(candidates: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that have a match; a whole batch of existence probes at once."""
    found = candidates.join(reference.select(*keys).distinct(), keys, "left_semi")
    return found.select(*candidates.columns)


def not_existing(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates without a match; makes an insert repeatable."""
    fresh = candidates.join(existing.select(*keys).distinct(), keys, "left_anti")
    return fresh.select(*candidates.columns)


def lookup_default(facts: DataFrame, values: DataFrame, keys: list[str],
                   defaults: dict[str, object]) -> DataFrame:
    """Left join on a unique key, with a value for the misses."""
    joined = facts.join(values, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def distinct_union(frames: Sequence[tuple[DataFrame, str]], name: str) -> DataFrame:
    """The distinct values of several columns. Each side is reduced map-side."""
    parts = [df.select(F.col(column).alias(name)) for df, column in frames]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.distinct()


def coalesce_owner(df: DataFrame, first: str, second: str, name: str = "owner") -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(first), F.col(second)))


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Drop the child rows of every key in ``new`` and put the new set in place."""
    kept = not_existing(old, new, [key])
    return kept.unionByName(new.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Insert by key or overwrite; among rows of ``new`` the highest version wins.

    Only ``new`` is folded (map-side, so a key with many versions is not
    gathered; ties go to the greatest row); ``old`` just loses those keys.
    """
    values = [c for c in old.columns if c not in keys]
    order = [F.col(version)] if version else []
    latest = new.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order, *values)).alias("_row"))
    written = latest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in old.columns])
    return not_existing(old, written, keys).unionByName(written)


def null_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Set a reference to NULL where the parent row is gone."""
    alive = parent.select(F.col(pk).alias(fk), F.lit(True).alias("_hit")).distinct()
    return _rewrite_reference(child, alive, fk, keep_when_hit=True)


def release(child: DataFrame, gone: DataFrame, fk: str) -> DataFrame:
    """Set a reference to NULL where it points to one of the ``gone`` keys."""
    hit = gone.select(fk).distinct().withColumn("_hit", F.lit(True))
    return _rewrite_reference(child, hit, fk, keep_when_hit=False)


def clear(df: DataFrame, hits: DataFrame, key: str, column: str) -> DataFrame:
    """Set a column to NULL in the rows whose key is among the ``hits``."""
    marked = df.join(hits.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.withColumn(column, F.when(F.col("_hit").isNull(), F.col(column))).select(*df.columns)


def _rewrite_reference(child: DataFrame, hits: DataFrame, fk: str,
                       keep_when_hit: bool) -> DataFrame:
    # Rows without a reference skip the join: NULL would be one hot key.
    linked = child.filter(F.col(fk).isNotNull()).join(hits, fk, "left")
    keep = F.col("_hit").isNotNull() if keep_when_hit else F.col("_hit").isNull()
    rewritten = linked.withColumn(fk, F.when(keep, F.col(fk))).select(*child.columns)
    return child.filter(F.col(fk).isNull()).unionByName(rewritten)


def number_series(limit: DataFrame, column: str, name: str = "n") -> DataFrame:
    """1..limit, where the limit is the one value of a one-row frame; none below 1."""
    # sequence() counts down when the limit is lower than the start
    return limit.filter(F.col(column) >= 1).select(F.explode(F.sequence(F.lit(1), F.col(column).cast("int"))).alias(name))


def above(df: DataFrame, value: Column, threshold: DataFrame) -> DataFrame:
    """Rows whose value exceeds the one value of a one-row frame."""
    return df.filter(value > threshold.scalar())

