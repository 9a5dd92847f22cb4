"""Session factory, table access and lineage cuts shared by every module."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "loomwright", master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the queries assume (UTC, ANSI, AQE)."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that Python functions find it there whatever
    their working directory and path are."""
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_loomwright_shipped", False) or not os.path.isdir(package):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="loomwright-"), "loomwright.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.join("loomwright", os.path.relpath(full, package)))
    context.addPyFile(path)
    context._loomwright_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; the path may be any that Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``.  A temporary one stands in for it only where driver
    and executors are one process (local mode); anywhere else a missing setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.loomwright.localDir", None)
        if not found:
            master = spark.conf.get("spark.master", "")
            if not re.fullmatch(r"local(\[[^\]]*\])?", master):
                raise RuntimeError(f"spark.checkpoint.dir isn't set: executors of {master!r} share no other folder")
            found = f"file://{tempfile.mkdtemp(prefix='loomwright-')}"
            spark.conf.set("spark.loomwright.localDir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's own folder within the shared one."""
    return f"{shared_dir(spark)}/loomwright/{spark.sparkContext.applicationId}"


def materialize(spark: SparkSession, df: DataFrame, options: dict | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (``options``: the writer's) and read it back: lineage is cut, lost executors cost
    nothing."""
    ship(spark)
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomwright_path = path
    return out


def counted(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`materialize` with the number of rows, which is observed while they are written."""
    seen = Observation()
    out = materialize(spark, df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def sent(df: DataFrame, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """A written table, to be broadcast in a join if its rows (counted) come to ``most`` bytes at most; else as it is, so
    that both sides are shuffled."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def discard(spark: SparkSession, *frames: DataFrame | None) -> None:
    """Deletes what :func:`materialize` wrote for ``frames`` (others are passed over); nothing may read them any more."""
    for df in frames:
        path = getattr(df, "_loomwright_path", None)
        if path is not None:
            held = spark._jvm.org.apache.hadoop.fs.Path(path)
            held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


def release(spark: SparkSession) -> None:
    """Deletes what this application has materialized; frames that read it can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
