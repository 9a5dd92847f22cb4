"""All relational queries by name, with their SQL, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import workloads
from loomwright.plans import q_engine, q_graph, q_ledger, q_session, q_streaming, q_workloads  # noqa: F401  they register their queries
from loomwright.plans.registry import ORACLES, QUERIES, query
from loomwright.session import table

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules clean, combined and breakdown of the tabular workflow, over lineitem with l_returnflag as the wildcard.

    Jobs of one rule are fused: instead of one small job for each flag, the rule runs once over rows that carry it."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice")
    cleaned = workloads.clean(lines, "l_quantity", "l_extendedprice")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    combined = cleaned.join(places.select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("region")), "l_suppkey").withColumnRenamed("l_returnflag", "source")
    by = combined.groupBy("region", "source").agg(F.count("*").alias("orders"), F.round(F.sum("l_quantity"), 4).alias("units"), F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("revenue"))
    return by


@query(
    """SELECT r_name AS region, l_returnflag AS source, count(*) AS orders, round(sum(l_quantity), 4) AS units, round(sum(l_quantity * l_extendedprice), 2) AS revenue
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY ALL"""
)
def entry_region_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, sf)
