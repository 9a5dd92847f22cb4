"""Streaming transforms over the derived event view, as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.plans import views
from loomwright.plans.registry import query
from loomwright.streaming import events


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = views.engine_events(spark, sf)
    return e.select(F.col("event"), F.timestamp_micros("at_us").alias("ts"), F.col("event_id").alias("seq"), "job_id", F.create_map(F.lit("k"), F.col("tag_k")).alias("tags"), "duration_ms")


@query("SELECT seq, event, job_id FROM (SELECT event_id AS seq, event, job_id, tag_k FROM engine_events) WHERE event IN ('job_failed', 'job_started') AND tag_k = '11'", ("engine_events",))
def event_filter(spark: SparkSession, sf: str) -> DataFrame:
    return events.matching(_events(spark, sf), ["job_failed", "job_started"], {"k": "11"}).select("seq", "event", "job_id")


_FOLD = """WITH s AS (SELECT job_id, event_id, CASE event WHEN 'job_queued' THEN 'pending' WHEN 'job_started' THEN 'running' WHEN 'job_completed' THEN 'completed' WHEN 'job_failed' THEN 'failed' WHEN 'job_skipped' THEN 'skipped' END AS status FROM engine_events),
f AS (SELECT job_id, arg_max(status, (CASE WHEN status IN ('completed', 'failed', 'skipped') THEN 1000000000 ELSE 0 END) + event_id) AS status FROM s WHERE status IS NOT NULL GROUP BY job_id)"""


@query(f"{_FOLD} SELECT job_id, status FROM f", ("engine_events",))
def event_fold(spark: SparkSession, sf: str) -> DataFrame:
    return events.latest_status(_events(spark, sf))


@query(f"{_FOLD} SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("pending", "running", "completed", "failed", "skipped")) + " FROM f", ("engine_events",))
def event_counters(spark: SparkSession, sf: str) -> DataFrame:
    return events.counters(events.latest_status(_events(spark, sf)))


@query("SELECT CAST(at_us // 3600000000 AS BIGINT) AS hour, event, count(*) AS n FROM engine_events GROUP BY ALL", ("engine_events",))
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    found = events.tumbling(_events(spark, sf))
    return found.select(F.expr("unix_seconds(window.start) div 3600").alias("hour"), "event", "n")


@query(
    """WITH g AS (SELECT job_id, at_us, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY job_id ORDER BY at_us) < 21600000000 THEN 0 ELSE 1 END AS new FROM engine_events),
s AS (SELECT job_id, at_us, sum(new) OVER (PARTITION BY job_id ORDER BY at_us ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT job_id, min(at_us) AS start_us, count(*) AS n FROM s GROUP BY job_id, k""",
    ("engine_events",),
)
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    found = events.sessions(_events(spark, sf), "6 hours")
    return found.select("job_id", F.unix_micros("session_window.start").alias("start_us"), "n")
