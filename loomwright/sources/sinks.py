"""Sinks: atomic outputs, benchmark rows, event logs, and lock files."""

from __future__ import annotations

import posixpath
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.parsing import format_elapsed
from loomwright.sources import codecs


class OutsideError(ValueError):
    """A path that leads out of the folder that it has to stay in."""


def confined(root: str, path: str) -> str:
    """``root/path``; a path that is absolute, has a scheme, or leads out of ``root`` is an error."""
    clean = posixpath.normpath(path)
    if not path or path.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) or clean == ".." or clean.startswith("../"):
        raise OutsideError(f"{path!r} isn't inside {root}")
    return f"{root.rstrip('/')}/{clean}"


def commit(df: DataFrame, path: str, hint: str | None = None) -> None:
    """Writes beside ``path`` and moves into place, so that no reader sees half an output.  The old output is moved
    aside first and goes last, so a failure between the two renames loses nothing."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    codecs.write(df, staged, hint or codecs.detect(path, hint))
    jvm = spark._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    aside = jvm.org.apache.hadoop.fs.Path(f"{staged}.old")
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(source, target):
        raise OSError(f"can't move {staged} to {path}")
    fs.delete(aside, True)


def benchmark_rows(history: DataFrame) -> DataFrame:
    """s, h:m:s, max_rss and cpu_time of finished jobs (wall_ms, max_rss, cpu_s), for a tab-separated file."""
    seconds = F.floor(F.col("wall_ms") / 1000).cast("long")
    clock = F.format_string("%d:%02d:%02d", F.floor(seconds / 3600).cast("long"), F.floor(seconds % 3600 / 60).cast("long"), seconds % 60)
    return history.select("job_id", F.format_string("%.4f", F.col("wall_ms") / 1000).alias("s"), clock.alias("h:m:s"), "max_rss", F.format_string("%.2f", "cpu_s").alias("cpu_time"), format_elapsed(seconds).alias("elapsed"))


def event_lines(events: DataFrame) -> DataFrame:
    """Events as NDJSON lines; null fields are left out."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def append_events(events: DataFrame, folder: str) -> None:
    event_lines(events).write.mode("append").text(folder)


def write_lock(spark: SparkSession, rules: DataFrame, inputs: DataFrame, path: str) -> None:
    """The state to hold later runs against: (name, execution_hash, params_hash) and (path, hash)."""
    rules.select("name", "execution_hash", "params_hash").write.mode("overwrite").json(f"{path}/rules")
    inputs.select("path", "hash").write.mode("overwrite").json(f"{path}/inputs")


def read_lock(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema("name string, execution_hash string, params_hash string").json(f"{path}/rules"), spark.read.schema("path string, hash string").json(f"{path}/inputs")


class ArtifactError(ValueError):
    """A stored output that isn't as it was stored."""


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows and a sum of their hashes, in any order and any partitions."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    n, total = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)"))).first()
    return n, str(total)


def store_artifact(df: DataFrame, root: str, key: str) -> str:
    """An output in a shared cache folder under its key, with its fingerprint beside it; the first one stored stays."""
    spark, path = df.sparkSession, f"{root}/{key[:2]}/{key}"
    if fetch_artifact(spark, root, key) is None:
        df.write.mode("overwrite").parquet(f"{path}/data")
        held = [fingerprint(spark.read.parquet(f"{path}/data"))]
        spark.createDataFrame(held, "n long, total string").coalesce(1).write.mode("overwrite").json(f"{path}/print")  # last: marks it whole
    return path


def fetch_artifact(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    """The output of a key, or None where the cache has none.  Its rows are counted and hashed again before it is given
    out; one that was changed or damaged is an error."""
    path = f"{root}/{key[:2]}/{key}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/print/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        return None
    wanted = tuple(spark.read.schema("n long, total string").json(f"{path}/print").first())
    out = spark.read.parquet(f"{path}/data")
    if fingerprint(out) != wanted:
        raise ArtifactError(f"{path} isn't as it was stored")
    return out


def sse_frames(events: DataFrame) -> DataFrame:
    """Events as frames of a server-sent event stream: id, event and data lines and an empty one; null fields are left
    out.  Works on batches and streams."""
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns]))
    number = F.concat(F.lit("id: "), F.col("seq").cast("string"), F.lit("\n")) if "seq" in events.columns else F.lit("")
    return events.select(F.concat(F.coalesce(number, F.lit("")), F.lit("event: "), F.col("event"), F.lit("\ndata: "), body, F.lit("\n\n")).alias("value"))
