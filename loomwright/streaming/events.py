"""The event stream: an NDJSON log followed by Structured Streaming, filters, folds and the bridge to the ledger.

The same transforms run on batches, so a replay and a live run agree."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One schema for every event; fields that an event doesn't have are null, unknown events pass through.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("executor", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("outputs", T.ArrayType(T.StringType())),
        T.StructField("error_message", T.StringType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("stderr_tail", T.StringType()),
        T.StructField("gate_id", T.StringType()),
        T.StructField("approved_by", T.StringType()),
        T.StructField("total_jobs", T.LongType()),
        T.StructField("to_run", T.LongType()),
        T.StructField("cached", T.LongType()),
        T.StructField("succeeded", T.LongType()),
        T.StructField("failed", T.LongType()),
        T.StructField("skipped", T.LongType()),
    ]
)
#: The status that each event leads to, and its place when two events of a job have the same time.
STATUS = {"job_queued": "pending", "job_started": "running", "job_completed": "completed", "job_failed": "failed", "job_skipped": "skipped"}


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events from text lines; lines that aren't JSON objects with an event go."""
    return lines.select(F.from_json(column, EVENT_SCHEMA).alias("e")).select("e.*").where("event is not null")


def follow(spark: SparkSession, folder: str, replay: bool = True, per_trigger: int | None = None) -> DataFrame:
    """The log folder as a stream; without ``replay`` only files that are written from now on count.  A file that turns
    up late counts by its own time, so nothing that is written after the start is lost."""
    reader = spark.readStream.format("text").option("latestFirst", "false")
    reader = reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)
    lines = reader.load(folder)
    if not replay:
        lines = lines.where(F.col("_metadata.file_modification_time") >= F.lit(datetime.now(timezone.utc)))
    return parsed(lines)


def matching(events: DataFrame, kinds: list[str] | None = None, tags: dict[str, str] | None = None) -> DataFrame:
    """Events of the given kinds that carry all the given tags; events without tags go where any is asked for."""
    keep = F.lit(True) if not kinds else F.col("event").isin(*kinds)
    for k, v in (tags or {}).items():
        keep = keep & F.coalesce(F.try_element_at("tags", F.lit(k)) == v, F.lit(False))
    return events.where(keep)


def _status(event: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair]), event)


def latest_status(events: DataFrame, order: str = "seq") -> DataFrame:
    """(job_id, status): terminal events win over others, then the later one; works on streams in update mode."""
    status = _status(F.col("event"))
    rank = F.struct(status.isin("completed", "failed", "skipped").alias("terminal"), F.col(order))
    return events.where(status.isNotNull() & F.col("job_id").isNotNull()).groupBy("job_id").agg(F.max_by(status, rank).alias("status"))


def counters(statuses: DataFrame) -> DataFrame:
    """Jobs by status, in one row."""
    return statuses.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "completed", "failed", "skipped")])


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each (job, event) once; state is dropped behind the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "event"])


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by window and event (a Spark built-in, not a feature of the log)."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts by job and session of activity (a Spark built-in)."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "job_id").agg(F.count("*").alias("n"))


def bridge(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str = "ledger"):
    """Starts the bridge: each micro-batch goes to ``sink`` with its number, so that a sink can skip one it has seen."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).queryName(name).outputMode("append").trigger(availableNow=True).start()


def ledger_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch's status changes under its number; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        changes = batch.where(_status(F.col("event")).isNotNull()).select("job_id", "seq", "event", _status(F.col("event")).alias("status"), "duration_ms")
        changes.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def folded_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The status of each job from the bridge's batches."""
    return latest_status(spark.read.parquet(path))
