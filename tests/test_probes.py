"""Reduced probes against plain joins, and what they shuffle."""

import pytest
from pyspark.sql import functions as F

from tarmaq.operators import probes
from tarmaq.operators.relations import exists_in, not_existing


def shuffled(spark, df):
    """Rows written to exchanges while a plan runs."""
    for name in ("adaptive.enabled", "exchange.reuse"):
        spark.conf.set(f"spark.sql.{name}", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        todo, total = [plan], 0
        while todo:
            node = todo.pop()
            if node.nodeName() == "Exchange":
                total += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(k) for k in range(node.children().size())]
        return total
    finally:
        for name in ("adaptive.enabled", "exchange.reuse", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("bits", [64, 1 << 16, probes.BITS])
def test_same_rows_as_the_plain_joins(spark, rows, bits):
    probe = spark.range(3000).selectExpr("IF(id % 50 = 0, NULL, id % 700) AS a", "IF(id % 77 = 0, NULL, 'k' || id % 3) AS b", "id")
    reference = spark.range(90).selectExpr("IF(id % 9 = 0, NULL, id * 11) AS a", "'k' || id % 3 AS b", "7 AS id")
    for keys in (["a"], ["a", "b"]):
        assert rows(probes.exists_selective(probe, reference, keys, bits)) == rows(exists_in(probe, reference, keys))
        assert rows(probes.missing_selective(probe, reference, keys, bits)) == rows(not_existing(probe, reference, keys))


def test_empty_sides(spark, rows):
    probe, none = spark.range(5), spark.range(0)
    assert probes.exists_selective(probe, none, ["id"]).count() == 0 == probes.exists_selective(none, probe, ["id"]).count()
    assert rows(probes.missing_selective(probe, none, ["id"])) == rows(probe)


def test_keys_of_other_types_are_refused(spark):
    with pytest.raises(TypeError):
        probes.exists_selective(spark.range(5), spark.range(5).withColumn("id", F.col("id").cast("int")), ["id"])


def test_the_map_has_a_fixed_size(spark):
    some = probes.key_map(spark.range(200_000), ["id"], 1 << 17)
    assert some.count() == 4 and {len(r["_bits"]) for r in some.collect()} == {probes.PART_BYTES}


def test_a_selective_probe_shuffles_less(spark):
    probe, reference = spark.range(100_000), spark.range(0, 100_000, 1000)
    for reduced, plain in ((probes.exists_selective, exists_in), (probes.missing_selective, not_existing)):
        few, many = (shuffled(spark, f(probe, reference, ["id"])) for f in (reduced, plain))
        assert many >= 100_000 and few < 2000
