"""Semi and anti joins that drop probe rows before they are shuffled.

The keys of the small side become a bit map: a bit for every hash. It has a
fixed number of bits, whatever the keys, so it may be broadcast, as rows of 4 KB.
A probe row whose bit is not set has no match for certain. It is dropped (semi)
or kept (anti) where it is read; only the others are shuffled to the exact join.
A map that is too full for its keys lets more rows through and changes no result.

Spark has a rule of its own for this, for scans above
``spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold``
(10 GB) under inner and semi joins; these operators serve anti joins too and are
chosen by the caller, who knows that a probe is selective.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the map: 8 MB in 2,048 rows. At 5 million keys 7 % of all others pass.
BITS = 1 << 26
PART_BYTES = 4096  # a part of the map, as Spark's bitmap functions make them


def _place(keys: list[str], bits: int) -> Column:
    """The bit of a row's key, from 1 on; NULL if a key is."""
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return F.when(known, F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1)


def key_map(reference: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """The bit map of the keys: rows (_part, _bits), bits / 32,768 of them at most."""
    places = reference.select(_place(keys, bits).alias("_place")).filter("_place IS NOT NULL")
    return (places.groupBy(F.bitmap_bucket_number("_place").alias("_part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")))


def marked(probe: DataFrame, reference: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """``probe`` with ``_maybe``: false where the reference has no such key for certain.

    Probe and reference have the same types of keys, as equal values must hash alike.
    """
    types = [(probe.schema[k].dataType, reference.schema[k].dataType) for k in keys]
    if any(a != b for a, b in types):
        raise TypeError(f"keys of different types: {types}")
    rows = probe.withColumn("_place", _place(keys, bits)).withColumns({
        "_part": F.bitmap_bucket_number("_place"), "_bit": F.bitmap_bit_position("_place")})
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0
    # the map has a fixed size, so this broadcast does not grow with the data
    return (rows.join(F.broadcast(key_map(reference, keys, bits)), "_part", "left")
            .withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_part", "_place", "_bit", "_bits"))


def exists_selective(probe: DataFrame, reference: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """Probe rows that have a match, when few have."""
    maybe = marked(probe, reference, keys, bits).filter("_maybe").drop("_maybe")
    return maybe.join(reference.select(*keys).distinct(), keys, "left_semi").select(*probe.columns)


def missing_selective(probe: DataFrame, reference: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """Probe rows without a match, when most have none; a NULL key has none."""
    seen = marked(probe, reference, keys, bits)
    rest = seen.filter("_maybe").join(reference.select(*keys).distinct(), keys, "left_anti")
    return seen.filter("NOT _maybe").select(*probe.columns).unionByName(rest.select(*probe.columns))
