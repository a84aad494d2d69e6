"""Connected components of a graph that never leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmaq.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of the edges (a, b): equal labels, connected.

    Every round each node joins the first, in an order drawn anew, of all nodes
    within two steps (itself included), and edges are rewritten to what their
    ends joined. Two steps make one node of any star in a round; of chains a
    constant share of the nodes goes. Each round's tables are written to the
    shared folder. Loops and repeated edges do no harm; the label is one of the
    nodes.
    """
    edges = stored(edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct(), "edges")
    labels = edges.selectExpr("a AS node").union(edges.selectExpr("b AS node")).distinct() \
        .withColumn("label", F.col("node"))
    edges, turn = edges.filter("a != b"), 0
    while not edges.isEmpty():
        def order(column):
            return F.struct(F.xxhash64(F.lit(turn), column).alias("h"), column.alias("v"))  # noqa: B023

        ends = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(ends.groupBy("a").agg(F.min(order(F.col("b"))).alias("best"))
                      .select("a", F.least(F.col("best"), order(F.col("a"))).alias("best")), "near")
        joined = stored(ends.join(near.toDF("b", "best"), "b").groupBy("a").agg(F.min("best")["v"].alias("root"))
                        .withColumnRenamed("a", "node"), "roots")
        labels = stored(labels.join(joined.withColumnRenamed("node", "label"), "label", "left")
                        .select("node", F.coalesce("root", "label").alias("label")), "labels")
        left = joined.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = joined.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = stored(edges.join(left, "a").join(right, "b").filter("x != y")
                       .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        turn += 1
    return labels
