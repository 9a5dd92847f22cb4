"""Queries over the run ledger: status counts, rule statistics, blockers, sessions and filters.

Each takes the ledger's tables as DataFrames.  Per-job lookups of the usual kind (one query for each pending job) are
single joins here, and status folds are conditional aggregates in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUSES = ["pending", "running", "completed", "failed", "skipped", "cancelled"]
#: Statuses that let a downstream job go ahead.
SATISFIED = ["completed", "skipped"]


def status_counts(jobs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One counter for each status, and ``cached`` beside them (it overlaps completed)."""
    counters = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES] + [F.count_if(F.col("cached") == 1).alias("cached")]
    return (jobs.groupBy(*by) if by else jobs).agg(*counters)


def pipeline_stats(jobs: DataFrame) -> DataFrame:
    """By rule: total, done (completed, failed or skipped) and running."""
    return jobs.groupBy("rule_name").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("completed", "failed", "skipped")).alias("completed"), F.count_if(F.col("status") == "running").alias("running"))


def pipeline_timing(jobs: DataFrame) -> DataFrame:
    """Statistics by rule with the mean wall time of completed jobs (whole ms, 0 without any) and the first start."""
    timed = (F.col("status") == "completed") & F.col("started_at").isNotNull() & F.col("completed_at").isNotNull()
    total = F.sum(F.when(timed, (F.col("completed_at") - F.col("started_at")) * 1000))
    return (
        jobs.groupBy("rule_name")
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("status").isin("completed", "failed", "skipped")).alias("completed"),
            F.count_if(F.col("status") == "running").alias("running"),
            F.count_if(F.col("status") == "pending").alias("pending"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            total.alias("ms"),
            F.count_if(timed).alias("timed"),
            F.min("started_at").alias("first_started_at"),
        )
        .withColumn("avg_wall_ms", F.when(F.col("timed") > 0, F.expr("ms div timed")).otherwise(F.lit(0)).cast("long"))
        .drop("ms", "timed")
    )


def slowest_rules(history: DataFrame, limit: int = 10) -> DataFrame:
    """Rules by their total wall time, ties by name."""
    h = history.where("wall_time_ms is not null").groupBy("run_id", "rule_name").agg(F.sum("wall_time_ms").alias("total_ms"), F.max("wall_time_ms").alias("max_ms"), F.count("*").alias("jobs"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("total_ms"), "rule_name"))
    return h.withColumn("rank", rank).where(F.col("rank") <= limit)


def terminal_violations(history: DataFrame) -> DataFrame:
    """(run, job) pairs with more than one terminal row: exactly-once is broken for these."""
    return history.groupBy("run_id", "job_id").agg(F.count("*").alias("rows")).where("rows > 1")


def blockers(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending jobs and the upstream jobs that hold them up, as a sorted list (null: none)."""
    pending = jobs.where("status = 'pending'").select("id", "rule_name")
    unmet = edges.join(jobs.where(~F.col("status").isin(*SATISFIED)).select(F.col("id").alias("from_job")), "from_job")
    by = unmet.groupBy(F.col("to_job").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("from_job")), lambda x: x.cast("string")), ",").alias("blocked_by"))
    return pending.join(by, "id", "left")


def owner_pids(jobs: DataFrame, sessions: DataFrame) -> DataFrame:
    """The process of the active session that holds each running job."""
    active = sessions.where("status = 'active'").select(F.col("id").alias("session_id"), "pid")
    return jobs.where("status = 'running'").select("id", "session_id").join(active, "session_id")


def stale_sessions(sessions: DataFrame, now: int | Column, threshold: int) -> DataFrame:
    now = now if isinstance(now, Column) else F.lit(now)
    return sessions.where((F.col("status") == "active") & (F.col("heartbeat_at") < now - threshold))


def reclaimed(jobs: DataFrame, stale: DataFrame) -> DataFrame:
    """All jobs, with running ones of stale sessions back at pending and without an owner."""
    gone = stale.select(F.col("id").alias("session_id"), F.lit(True).alias("gone"))
    held = jobs.join(gone, "session_id", "left").withColumn("back", F.coalesce("gone", F.lit(False)) & (F.col("status") == "running"))
    return held.select(
        *[
            F.when(F.col("back"), F.lit("pending")).otherwise(F.col("status")).alias("status") if c == "status" else F.when(~F.col("back"), F.col("session_id")).alias("session_id") if c == "session_id" else F.col(c)
            for c in jobs.columns
        ]
    )


def latest_run(jobs: DataFrame) -> DataFrame:
    """The run whose jobs began last; ties by the larger id."""
    return jobs.groupBy("run_id").agg(F.max("started_at").alias("started_at"), F.count("*").alias("jobs")).orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def with_logs(jobs: DataFrame, rule: str | None = None, failed: bool = False) -> DataFrame:
    rows = jobs.where("log_path is not null")
    rows = rows if rule is None else rows.where(F.col("rule_name") == rule)
    return rows.where("status = 'failed'") if failed else rows


def cancellable(jobs: DataFrame, rule: str | None = None, session: int | None = None) -> DataFrame:
    rows = jobs.where(F.col("status").isin("running", "pending"))
    rows = rows if rule is None else rows.where(F.col("rule_name") == rule)
    return rows if session is None else rows.where(F.col("session_id") == session)


def running_detail(jobs: DataFrame, run: int | None = None) -> DataFrame:
    rows = jobs.where("status = 'running'")
    rows = rows if run is None else rows.where(F.col("run_id") == run)
    return rows.select("id", "rule_name", F.coalesce("wildcards", F.lit("{}")).alias("wildcards"), "started_at")


def progress(jobs: DataFrame) -> DataFrame:
    """The fraction of each rule's jobs that is done."""
    by = jobs.groupBy("rule_name").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("completed", "failed", "skipped")).alias("done"))
    return by.withColumn("fraction", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.round(F.col("done") / F.col("total"), 6)))


#: Upper bounds of the duration histogram, in seconds.
BUCKETS = [1, 5, 10, 30, 60, 120, 300, 600]


def duration_histogram(jobs: DataFrame) -> DataFrame:
    """Cumulative counts by bound, with the count and sum over all."""
    d = F.col("completed_at") - F.col("started_at")
    cells = [F.count_if(d <= b).alias(f"le_{b}") for b in BUCKETS]
    return jobs.where("completed_at is not null and started_at is not null").groupBy("rule_name").agg(*cells, F.count("*").alias("count"), F.sum(d).alias("sum"))


def gauges(jobs: DataFrame) -> DataFrame:
    """Jobs by status, cache hits, and misses (completed or failed without the cache)."""
    return status_counts(jobs).withColumn("cache_misses", F.col("completed") - F.col("cached") + F.col("failed")).withColumnRenamed("cached", "cache_hits")


def status_fold(transitions: DataFrame, by: str = "job_id", order: str = "seq") -> DataFrame:
    """The status after guarded transitions (event, owner): a claim needs pending, complete and fail need the owner of
    the claim, skip needs pending, cancel needs pending or running.  The fold runs over each job's own few events."""
    each = transitions.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "event", "owner"))).alias("events"))
    start = F.struct(F.lit("pending").alias("status"), F.lit(None).cast("string").alias("owner"), F.lit(0).alias("refused"))

    def step(s: Column, e: Column) -> Column:
        def to(status: str, owner: Column) -> Column:
            return F.struct(F.lit(status).alias("status"), owner.cast("string").alias("owner"), s["refused"].alias("refused"))

        mine = (s["status"] == "running") & s["owner"].eqNullSafe(e["owner"])
        open_ = s["status"].isin("pending", "running")
        return (
            F.when((e["event"] == "claim") & (s["status"] == "pending"), to("running", e["owner"]))
            .when((e["event"] == "complete") & mine, to("completed", s["owner"]))
            .when((e["event"] == "fail") & mine, to("failed", s["owner"]))
            .when((e["event"] == "skip") & (s["status"] == "pending"), to("skipped", s["owner"]))
            .when((e["event"] == "cancel") & open_, to("cancelled", s["owner"]))
            .otherwise(F.struct(s["status"].alias("status"), s["owner"].alias("owner"), (s["refused"] + 1).alias("refused")))
        )

    return each.select(by, F.aggregate("events", start, step).alias("s")).select(by, "s.status", "s.owner", "s.refused")
