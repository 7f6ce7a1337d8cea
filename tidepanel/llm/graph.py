"""Connected components by contraction along a random order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import drop_staged, staged


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the smallest node of its component.

    In each round a node moves to the neighbour (or itself) that comes first in a hashed order, and edges follow their ends.
    Only nodes that come before some neighbour and all of its other ones are left, so a star takes two rounds and a chain
    loses about half of its nodes in each. Sides are reduced by partial aggregates; each round is written to the shared folder.
    """
    both = edges.select("a", "b").filter("a <> b")
    live = staged(spark, both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = staged(spark, live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    order = lambda c: F.struct(F.xxhash64(F.lit(5), F.col(c)).alias("h"), F.col(c).alias("node"))
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("u"), order("b").alias("v")).unionAll(live.select(F.col("b").alias("u"), order("a").alias("v")))
        nearest = ends.groupBy("u").agg(F.min("v").alias("v"))
        moves = nearest.select(F.col("u"), F.least(F.col("v"), order("u"))["node"].alias("to"))
        moves = staged(spark, moves, "moves")
        at_a = live.join(moves.withColumnsRenamed({"u": "a", "to": "new_a"}), "a")
        at_b = at_a.join(moves.withColumnsRenamed({"u": "b", "to": "new_b"}), "b")
        moved = at_b.filter("new_a <> new_b").select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct()
        followed = labels.join(moves.withColumnRenamed("u", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        old = (live, labels, moves)
        live, labels = staged(spark, moved, "edges"), staged(spark, followed, "labels")
        for table in old:
            drop_staged(spark, table)
    smallest = labels.groupBy("label").agg(F.min("node").alias("smallest"))
    return labels.join(smallest, "label").select("node", F.col("smallest").alias("label"))
