"""Connected components over a table of links, as a loop of DataFrame steps.

State: rows (node, root), each a link to a smaller node.  A round lets every node find its smallest root, links its
other roots to that one, and then moves rows whose root has itself found a smaller one.  Rounds grow with the logarithm
of a component's diameter; each is written to the shared folder, so a lost executor costs no more than one round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import discard, materialize


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b: long, not null); root is the smallest node of its component."""
    rows = materialize(spark, links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct())
    while True:
        found = materialize(spark, rows.groupBy("node").agg(F.min("root").alias("least"), F.collect_set("root").alias("roots")))
        others = found.where(F.size("roots") > 1).select(F.explode("roots").alias("node"), F.col("least").alias("root")).where("node <> root")
        linked = found.select("node", F.col("least").alias("root")).unionByName(others).distinct()
        # roots that have themselves a smaller root; usually few, and their exchange is one that Spark can split
        moved = materialize(spark, found.join(found.select(F.col("least").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("root"), F.col("least").alias("next")))
        if moved.isEmpty() and found.where(F.size("roots") > 1).isEmpty():
            break
        linked, before = materialize(spark, linked), rows
        rows = materialize(spark, linked.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")).where("node <> root").unionByName(moved.select(F.col("root").alias("node"), F.col("next").alias("root"))).distinct())
        discard(spark, before, found, moved, linked)
    roots = found.select(F.col("least").alias("node")).distinct().withColumn("root", F.col("node"))
    return found.select("node", F.col("least").alias("root")).unionByName(roots)
