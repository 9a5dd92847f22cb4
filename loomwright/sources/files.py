"""Files as tables: discovery, hashes and a memo of known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import cache

#: Folders that discovery passes over, and how many folders deep it goes.
SKIPPED, DEPTH = ("target", "node_modules"), 5


def discover(spark: SparkSession, folder: str, depth: int = DEPTH, skipped: tuple[str, ...] = SKIPPED, only: list[str] | None = None) -> DataFrame:
    """(path relative to the folder, full_path, mtime in ns, size) of the files below a folder, or below the given files
    and folders in it: others aren't listed, so they may come and go meanwhile."""
    wanted = [folder] if only is None else [f"{folder}/{p}" for p in only]
    if not wanted:
        return spark.createDataFrame([], "path string, full_path string, mtime long, size long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(wanted).select("path", "modificationTime", "length")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    inside = F.regexp_replace(F.regexp_replace(F.col("path"), "^[a-z0-9]+:(//[^/]*)?", ""), f"^\\Q{root}\\E/", "")
    steps = F.split(inside, "/")
    fine = (F.size(steps) <= depth + 1) & ~F.exists(F.slice(steps, F.lit(1), F.size(steps) - 1), lambda s: s.isin(*skipped))
    return files.where(fine).select(inside.alias("path"), F.col("path").alias("full_path"), (F.unix_micros("modificationTime") * 1000).alias("mtime"), F.col("length").alias("size"))


def hashed(spark: SparkSession, folder: str) -> DataFrame:
    """(full_path, hash) by content.  A file is one value and has to fit a task."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("full_path"), F.sha2("content", 256).alias("hash"))


def with_hashes(spark: SparkSession, files: DataFrame, folder: str, memo: DataFrame | None = None) -> DataFrame:
    """``files`` with ``hash``: from the memo where path, time and size are known, by reading the others."""
    if memo is None:
        return files.join(hashed(spark, folder), "full_path")
    known, unknown = cache.memoised(files, memo)
    return known.select(*files.columns, "hash").unionByName(unknown.join(hashed(spark, folder), "full_path").select(*files.columns, "hash"))
