"""Snapshots and lock files: full-outer differences of named states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(job_id, change): added, removed, changed or unchanged; changed is a new status or new output hashes (nulls are
    equal to each other)."""
    b = before.select("job_id", F.col("status").alias("old_status"), F.col("output_hashes").alias("old_hashes"), F.lit(True).alias("was"))
    a = after.select("job_id", F.col("status").alias("new_status"), F.col("output_hashes").alias("new_hashes"), F.lit(True).alias("is"))
    both = b.join(a, "job_id", "full_outer")
    same = F.col("old_status").eqNullSafe(F.col("new_status")) & F.col("old_hashes").eqNullSafe(F.col("new_hashes"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.select("job_id", change.alias("change"), "old_status", "new_status", (~F.col("old_hashes").eqNullSafe(F.col("new_hashes"))).alias("outputs_changed"))


def summary(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed", "unchanged")])


SNAPSHOT = "snapshot_name string, created_at double, job_id string, rule string, status string, output_hashes string"


def create(jobs: DataFrame, folder: str, name: str, at: float) -> None:
    """Keeps the state of ``jobs`` (job_id, rule, status, output_hashes) under a name; an older one of the name goes.  One
    without jobs is kept too."""
    spark = jobs.sparkSession
    rows = jobs.select(F.lit(name).alias("snapshot_name"), F.lit(at).alias("created_at"), *[F.col(c).cast("string") for c in ("job_id", "rule", "status", "output_hashes")])
    mark = spark.createDataFrame([(name, at, None, None, None, None)], SNAPSHOT)
    rows.unionByName(mark).write.mode("overwrite").parquet(f"{folder}/{_coded(name)}")


def delete(spark: SparkSession, folder: str, name: str) -> bool:
    """Forgets a snapshot; whether there was one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_coded(name)}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(name, created_at) of all snapshots, and the jobs of all."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(path) and len(fs.listStatus(path)) > 0
    rows = spark.read.schema(SNAPSHOT).option("recursiveFileLookup", "true").parquet(folder) if there else spark.createDataFrame([], SNAPSHOT)
    return rows.groupBy(F.col("snapshot_name").alias("name")).agg(F.max("created_at").alias("created_at")), rows.where("job_id is not null")


def _coded(name: str) -> str:
    """A folder name for any snapshot name."""
    return "s-" + "".join(c if c.isascii() and c.isalnum() else f"%{ord(c):x}." for c in name)


def listing(snapshots: DataFrame, jobs: DataFrame) -> DataFrame:
    """Snapshots with their number of jobs, 0 for an empty one."""
    n = jobs.groupBy(F.col("snapshot_name").alias("name")).agg(F.count("*").alias("jobs"))
    return snapshots.join(n, "name", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0)))


def ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """All job ids of two snapshots."""
    return a.select("job_id").union(b.select("job_id")).distinct().orderBy("job_id")


def drift(locked_rules: DataFrame, rules: DataFrame, locked_inputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(kind, name) of every difference from a lock: rules by (name, execution_hash, params_hash), inputs by (path, hash).
    A rule may have changed in both ways."""
    r = locked_rules.select("name", F.col("execution_hash").alias("e0"), F.col("params_hash").alias("p0"), F.lit(True).alias("was")).join(rules.select("name", "execution_hash", "params_hash", F.lit(True).alias("is")), "name", "full_outer")
    both = F.col("was").isNotNull() & F.col("is").isNotNull()
    kinds = F.array(
        F.when(F.col("is").isNull(), "rule_removed"),
        F.when(F.col("was").isNull(), "rule_added"),
        F.when(both & ~F.col("e0").eqNullSafe(F.col("execution_hash")), "rule_execution_changed"),
        F.when(both & ~F.col("p0").eqNullSafe(F.col("params_hash")), "rule_params_changed"),
    )
    of_rules = r.select(F.explode(F.array_compact(kinds)).alias("kind"), "name")
    i = locked_inputs.select("path", F.col("hash").alias("h0"), F.lit(True).alias("was")).join(inputs.select("path", "hash", F.lit(True).alias("is")), "path", "full_outer")
    kind = F.when(F.col("is").isNull(), "input_removed").when(F.col("was").isNull(), "input_added").when(~F.col("h0").eqNullSafe(F.col("hash")), "input_changed")
    return of_rules.unionByName(i.select(kind.alias("kind"), F.col("path").alias("name")).where("kind is not null"))


def header_drift(locked: dict[str, str], current: dict[str, str]) -> list[tuple[str, str]]:
    """Differences of the workflow's own hash and of the platform."""
    out = []
    if locked.get("workflow_hash") != current.get("workflow_hash"):
        out.append(("workflow_changed", str(locked.get("workflow_hash"))))
    if (locked.get("os"), locked.get("arch")) != (current.get("os"), current.get("arch")):
        out.append(("platform_changed", f"{locked.get('os')}/{locked.get('arch')}"))
    return out
