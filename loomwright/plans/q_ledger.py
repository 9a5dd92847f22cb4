"""Ledger queries over the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import ledger
from loomwright.plans import views
from loomwright.plans.registry import query

_COUNTERS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ledger.STATUSES) + ", count(*) FILTER (WHERE cached = 1) AS cached"


@query(f"SELECT {_COUNTERS} FROM jobs", ("jobs",))
def ledger_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.status_counts(views.jobs(spark, sf))


@query(f"SELECT run_id, {_COUNTERS} FROM jobs GROUP BY run_id", ("jobs",))
def ledger_status_counts_run(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.status_counts(views.jobs(spark, sf), ["run_id"])


@query(
    """SELECT rule_name, count(*) AS total, count(*) FILTER (WHERE status IN ('completed', 'failed', 'skipped')) AS completed,
  count(*) FILTER (WHERE status = 'running') AS running FROM jobs GROUP BY rule_name""",
    ("jobs",),
)
def ledger_pipeline_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.pipeline_stats(views.jobs(spark, sf))


@query(
    """SELECT rule_name, count(*) AS total, count(*) FILTER (WHERE status IN ('completed', 'failed', 'skipped')) AS completed,
  count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'failed') AS failed,
  min(started_at) AS first_started_at,
  CAST(coalesce(sum(CASE WHEN status = 'completed' THEN (completed_at - started_at) * 1000 END) // nullif(count(*) FILTER (WHERE status = 'completed' AND completed_at IS NOT NULL), 0), 0) AS BIGINT) AS avg_wall_ms
  FROM jobs GROUP BY rule_name""",
    ("jobs",),
)
def ledger_pipeline_timing(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.pipeline_timing(views.jobs(spark, sf))


@query(
    """WITH s AS (SELECT run_id, rule_name, CAST(sum(wall_time_ms) AS BIGINT) AS total_ms, max(wall_time_ms) AS max_ms, count(*) AS jobs FROM job_history WHERE wall_time_ms IS NOT NULL GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY total_ms DESC, rule_name) AS INTEGER) AS rank FROM s)
SELECT * FROM r WHERE rank <= 3""",
    ("job_history",),
)
def ledger_slowest_rules(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.slowest_rules(views.job_history(spark, sf), 3)


@query("SELECT run_id, job_id, count(*) AS rows FROM job_history GROUP BY ALL HAVING count(*) > 1", ("job_history",))
def ledger_terminal_violations(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.terminal_violations(views.job_history(spark, sf))


@query(
    """WITH b AS (SELECT e.to_job AS id, string_agg(DISTINCT CAST(e.from_job AS VARCHAR), ',' ORDER BY e.from_job) AS blocked_by
  FROM (SELECT DISTINCT from_job, to_job FROM job_edges) e JOIN jobs u ON u.id = e.from_job WHERE u.status NOT IN ('completed', 'skipped') GROUP BY e.to_job)
SELECT j.id, j.rule_name, list_aggregate(list_sort(list_transform(string_split(blocked_by, ','), lambda x: CAST(x AS BIGINT))), 'string_agg', ',') AS blocked_by FROM jobs j LEFT JOIN b USING (id) WHERE j.status = 'pending'""".replace(" ORDER BY e.from_job", ""),
    ("jobs", "job_edges"),
)
def ledger_blockers(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.blockers(views.jobs(spark, sf), views.job_edges(spark, sf))


@query("SELECT j.id, j.session_id, s.pid FROM jobs j JOIN sessions s ON s.id = j.session_id WHERE j.status = 'running' AND s.status = 'active'", ("jobs", "sessions"))
def ledger_owner_pid(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.owner_pids(views.jobs(spark, sf), views.sessions(spark, sf))


@query("SELECT id, pid, started_at, heartbeat_at, status FROM sessions WHERE status = 'active' AND heartbeat_at < (SELECT max(heartbeat_at) FROM sessions) - 86400", ("sessions",))
def ledger_stale_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = views.sessions(spark, sf)
    now = s.agg(F.max("heartbeat_at")).first()[0]
    return ledger.stale_sessions(s, now, 86400)


@query(
    """WITH gone AS (SELECT id FROM sessions WHERE status = 'active' AND id % 2 = 0)
SELECT j.id, CASE WHEN g.id IS NOT NULL AND j.status = 'running' THEN 'pending' ELSE j.status END AS status,
  CASE WHEN NOT (g.id IS NOT NULL AND j.status = 'running') THEN j.session_id END AS session_id FROM jobs j LEFT JOIN gone g ON g.id = j.session_id""",
    ("jobs", "sessions"),
)
def ledger_reclaim(spark: SparkSession, sf: str) -> DataFrame:
    gone = views.sessions(spark, sf).where("status = 'active' and id % 2 = 0")
    return ledger.reclaimed(views.jobs(spark, sf).select("id", "status", "session_id"), gone)


@query("SELECT run_id, max(started_at) AS started_at, count(*) AS jobs FROM jobs GROUP BY run_id ORDER BY started_at DESC, run_id DESC LIMIT 1", ("jobs",))
def ledger_latest_run(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.latest_run(views.jobs(spark, sf))


@query("SELECT id, rule_name, status, log_path FROM jobs WHERE log_path IS NOT NULL AND rule_name = '1-URGENT' AND status = 'failed'", ("jobs",))
def ledger_logs_filter(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.with_logs(views.jobs(spark, sf), "1-URGENT", True).select("id", "rule_name", "status", "log_path").orderBy("id")


@query("SELECT id FROM jobs WHERE status IN ('running', 'pending') AND session_id = 7", ("jobs",))
def ledger_cancellable(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.cancellable(views.jobs(spark, sf), session=7).select("id")


@query("SELECT id, rule_name, coalesce(wildcards, '{}') AS wildcards, started_at FROM jobs WHERE status = 'running' AND run_id = 3", ("jobs",))
def ledger_running_detail(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.running_detail(views.jobs(spark, sf), 3)


@query("SELECT id, rule_name, status FROM jobs WHERE status = 'failed'", ("jobs",))
def ledger_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return views.jobs(spark, sf).where("status = 'failed'").select("id", "rule_name", "status")


@query("SELECT run_id, min(started_at) AS started_at, max(completed_at) AS completed_at, count(*) AS job_count, count(*) FILTER (WHERE status = 'completed') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed FROM jobs GROUP BY run_id", ("jobs",))
def ledger_runs(spark: SparkSession, sf: str) -> DataFrame:
    by = views.jobs(spark, sf).groupBy("run_id").agg(F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"), F.count("*").alias("job_count"), F.count_if(F.col("status") == "completed").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))
    return by.orderBy(F.desc("started_at"), "run_id")


@query("SELECT count(*) AS n FROM jobs", ("jobs",))
def ledger_count(spark: SparkSession, sf: str) -> DataFrame:
    return views.jobs(spark, sf).agg(F.count("*").alias("n"))


@query("SELECT rule_name, count(*) AS total, count(*) FILTER (WHERE status IN ('completed', 'failed', 'skipped')) AS done, round(count(*) FILTER (WHERE status IN ('completed', 'failed', 'skipped')) / count(*), 6) AS fraction FROM jobs GROUP BY rule_name", ("jobs",))
def progress_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.progress(views.jobs(spark, sf))


@query(
    "SELECT rule_name, " + ", ".join(f"count(*) FILTER (WHERE completed_at - started_at <= {b}) AS le_{b}" for b in ledger.BUCKETS) + ", count(*) AS count, CAST(sum(completed_at - started_at) AS BIGINT) AS sum FROM jobs WHERE completed_at IS NOT NULL GROUP BY rule_name",
    ("jobs",),
)
def metrics_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.duration_histogram(views.jobs(spark, sf))


@query(
    f"WITH c AS (SELECT {_COUNTERS} FROM jobs) SELECT pending, running, completed, failed, skipped, cancelled, cached AS cache_hits, completed - cached + failed AS cache_misses FROM c",
    ("jobs",),
)
def metrics_gauges(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.gauges(views.jobs(spark, sf))


@query(
    """WITH t AS (SELECT user_id % 1000 AS job, event_id AS seq, event_type, row_number() OVER (PARTITION BY user_id % 1000 ORDER BY event_id) AS n FROM events),
s AS (SELECT job, 0::BIGINT AS n, 'pending' AS status, 0 AS refused FROM (SELECT DISTINCT job FROM t)
  UNION ALL SELECT t.job, t.n,
    CASE WHEN event_type = 'click' AND status = 'pending' THEN 'running' WHEN event_type = 'purchase' AND status = 'running' THEN 'completed'
         WHEN event_type = 'error' AND status = 'running' THEN 'failed' WHEN event_type = 'view' AND status = 'pending' THEN 'skipped'
         WHEN event_type = 'signup' AND status IN ('pending', 'running') THEN 'cancelled' ELSE status END,
    CASE WHEN (event_type = 'click' AND status = 'pending') OR (event_type IN ('purchase', 'error') AND status = 'running') OR (event_type = 'view' AND status = 'pending')
         OR (event_type = 'signup' AND status IN ('pending', 'running')) THEN refused ELSE refused + 1 END
  FROM s JOIN t ON t.job = s.job AND t.n = s.n + 1)
SELECT job AS job_id, arg_max(status, n) AS status, arg_max(refused, n) AS refused FROM s GROUP BY job""",
    recursive=True,
)
def ledger_transitions(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("click", "claim", "purchase", "complete", "error", "fail", "view", "skip", "signup", "cancel")])
    e = views.table(spark, sf, "events").select((F.col("user_id") % 1000).alias("job_id"), F.col("event_id").alias("seq"), F.element_at(kind, F.col("event_type")).alias("event"), F.lit("w").alias("owner"))
    return ledger.status_fold(e).drop("owner")
