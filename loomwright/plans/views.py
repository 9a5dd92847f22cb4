"""Ledger-shaped views over the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import table

TERMINAL = ["completed", "failed", "skipped", "cancelled"]


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderstatus") == "F", "failed").when(key % 2 == 0, "pending").otherwise("running")
    started = F.unix_timestamp("o_orderdate")
    return o.select(
        key.alias("id"),
        F.col("o_orderpriority").alias("rule_name"),
        status.alias("status"),
        (F.col("o_custkey") % 10).alias("run_id"),
        (F.col("o_custkey") % 50).alias("session_id"),
        F.when((F.col("o_orderstatus") == "O") & (key % 5 == 0), 1).otherwise(0).alias("cached"),
        started.alias("started_at"),
        F.when(F.col("o_orderstatus").isin("O", "F"), started + key % 600).alias("completed_at"),
        F.when(key % 3 == 0, F.concat(F.lit("logs/"), key.cast("string"), F.lit(".log"))).alias("log_path"),
        F.when(key % 4 != 0, F.concat(F.lit('{"customer":"'), F.col("o_custkey").cast("string"), F.lit('"}'))).alias("wildcards"),
    )


def job_history(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("run_id"),
        F.col("l_orderkey").alias("job_id"),
        F.concat("l_returnflag", "l_linestatus").alias("rule_name"),
        F.when(F.col("l_linenumber") % 7 != 0, (F.col("l_quantity") * 1000).cast("long")).alias("wall_time_ms"),
    )


def job_edges(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    p = table(spark, sf, "part").select(key.alias("to_job"), F.explode(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3"))).alias("from_job"))
    return p.where("from_job < to_job").select("from_job", "to_job").distinct()


def job_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"))


def chain_edges(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    return c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"]).select("conv_id", F.col("turn").alias("from_turn"), (F.col("turn") + 1).alias("to_turn"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.unix_timestamp(F.min("ts")).alias("started_at"), F.unix_timestamp(F.max("ts")).alias("heartbeat_at"))
    return e.select("id", (F.col("id") % 30000 + 1000).alias("pid"), "started_at", "heartbeat_at", F.when(F.col("id") % 3 == 0, "completed").otherwise("active").alias("status"))


def snapshot_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots of the jobs, ``before`` and ``after``."""
    j = jobs(spark, sf)
    hashed = F.sha2(F.col("id").cast("string"), 256)
    before = j.where("id % 10 <> 0").select(F.lit("before").alias("snapshot_name"), F.col("id").alias("job_id"), "rule_name", "status", F.when(F.col("id") % 13 != 0, hashed).alias("output_hashes"))
    status = F.when(F.col("id") % 7 == 0, "skipped").otherwise(F.col("status"))
    other = F.when(F.col("id") % 17 == 0, F.sha2(F.concat(F.lit("new"), F.col("id").cast("string")), 256)).otherwise(hashed)
    after = j.where("id % 11 <> 0").select(F.lit("after").alias("snapshot_name"), F.col("id").alias("job_id"), "rule_name", status.alias("status"), F.when(F.col("id") % 13 != 0, other).alias("output_hashes"))
    return before.unionByName(after)


EVENT_KINDS = {"signup": "job_queued", "click": "job_started", "view": "job_skipped", "purchase": "job_completed", "error": "job_failed"}


def engine_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kinds = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])
    return e.select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
        F.coalesce(F.element_at(kinds, F.col("event_type")), F.col("event_type")).alias("event"),
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.get_json_object("props", "$.k").alias("tag_k"),
        F.when(F.col("event_type") == "purchase", F.floor(F.col("value") * 10)).cast("long").alias("duration_ms"),
    )


#: The same views over DuckDB.
VIEWS = {
    "jobs": """SELECT o_orderkey AS id, o_orderpriority AS rule_name,
  CASE WHEN o_orderstatus = 'O' THEN 'completed' WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'running' END AS status,
  o_custkey % 10 AS run_id, o_custkey % 50 AS session_id,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS cached,
  CAST(floor(epoch(o_orderdate)) AS BIGINT) AS started_at,
  CASE WHEN o_orderstatus IN ('O', 'F') THEN CAST(floor(epoch(o_orderdate)) AS BIGINT) + o_orderkey % 600 END AS completed_at,
  CASE WHEN o_orderkey % 3 = 0 THEN 'logs/' || o_orderkey || '.log' END AS log_path,
  CASE WHEN o_orderkey % 4 <> 0 THEN '{"customer":"' || o_custkey || '"}' END AS wildcards FROM orders""",
    "job_history": """SELECT l_suppkey AS run_id, l_orderkey AS job_id, l_returnflag || l_linestatus AS rule_name,
  CASE WHEN l_linenumber % 7 <> 0 THEN CAST(trunc(l_quantity * 1000) AS BIGINT) END AS wall_time_ms FROM lineitem""",
    "job_edges": """SELECT DISTINCT from_job, to_job FROM (SELECT p_partkey // 2 AS from_job, p_partkey AS to_job FROM part
  UNION ALL SELECT p_partkey // 3, p_partkey FROM part) WHERE from_job < to_job""",
    "job_nodes": "SELECT p_partkey AS id FROM part",
    "chain_edges": """SELECT a.conv_id, a.turn AS from_turn, a.turn + 1 AS to_turn FROM conversations a JOIN conversations b
  ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "sessions": """SELECT user_id AS id, user_id % 30000 + 1000 AS pid, CAST(floor(epoch(min(ts))) AS BIGINT) AS started_at,
  CAST(floor(epoch(max(ts))) AS BIGINT) AS heartbeat_at, CASE WHEN user_id % 3 = 0 THEN 'completed' ELSE 'active' END AS status FROM events GROUP BY user_id""",
    "snapshot_jobs": """SELECT 'before' AS snapshot_name, id AS job_id, rule_name, status, CASE WHEN id % 13 <> 0 THEN sha256(CAST(id AS VARCHAR)) END AS output_hashes FROM jobs WHERE id % 10 <> 0
  UNION ALL SELECT 'after', id, rule_name, CASE WHEN id % 7 = 0 THEN 'skipped' ELSE status END,
  CASE WHEN id % 13 <> 0 THEN CASE WHEN id % 17 = 0 THEN sha256('new' || id) ELSE sha256(CAST(id AS VARCHAR)) END END FROM jobs WHERE id % 11 <> 0""",
    "engine_events": """SELECT event_id, epoch_us(ts) AS at_us,
  CASE event_type WHEN 'signup' THEN 'job_queued' WHEN 'click' THEN 'job_started' WHEN 'view' THEN 'job_skipped' WHEN 'purchase' THEN 'job_completed' WHEN 'error' THEN 'job_failed' ELSE event_type END AS event,
  'job-' || user_id AS job_id, json_extract_string(props, '$.k') AS tag_k,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 10) AS BIGINT) END AS duration_ms FROM events""",
}
