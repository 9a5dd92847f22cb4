"""Scheduling policies over job tables: what to keep, retry, admit, evict, and when a failure has one root cause."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a copy costs to read, in microseconds.
COPY_COST = {"memory": 100, "object_store": 1000, "disk": 200_000}


def materialize_strategy(policy: Column, leaf: Column) -> Column:
    """Where an output goes: always and auto keep an object, always (and final at a leaf) writes it, never drops it
    after its last reader."""
    return F.struct(
        F.lit(True).alias("keep_object"),
        ((policy == "always") | ((policy == "final") & leaf)).alias("write_file"),
        (policy == "never").alias("evict_after_readers"),
    )


def backoff_seconds(kind: Column, attempt: Column) -> Column:
    """The wait before attempt n + 1: 1, n or 2^(n - 1) seconds for constant, linear and exponential."""
    return F.when(kind == "linear", attempt.cast("long")).when(kind == "exponential", F.pow(F.lit(2.0), (attempt - 1).cast("double")).cast("long")).otherwise(F.lit(1).cast("long"))


def retry_schedule(jobs: DataFrame) -> DataFrame:
    """(job_id, attempt, wait, at) for ``jobs`` (job_id, count, backoff): ``count`` is the total of attempts, so there
    are count - 1 waits; ``at`` is the time of the next attempt from the first."""
    waits = F.transform(F.sequence(F.lit(1), F.greatest(F.col("count").cast("int") - 1, F.lit(1))), lambda n: F.struct(n.alias("attempt"), backoff_seconds(F.col("backoff"), n).alias("wait")))
    each = jobs.where("count > 1").select("job_id", F.inline(waits))
    return each.withColumn("at", F.sum("wait").over(Window.partitionBy("job_id").orderBy("attempt")))


def by_priority(jobs: DataFrame) -> DataFrame:
    """Ready jobs in the order in which they start: priority falling (null is 0), then id."""
    return jobs.orderBy(F.coalesce("priority", F.lit(0)).desc(), "id")


def admitted(jobs: DataFrame, capacity: dict[str, float], pool: str = "pool") -> DataFrame:
    """(pool, id, admitted): greedy admission by priority under a budget for each resource.

    Jobs that don't fit are passed over and smaller ones may still fit, so a pool is taken in sequence; pools are
    independent.  ``jobs``: pool, id, priority, needs (map of resource to amount; resources without a capacity, and
    null amounts, aren't limited).  A pool is one ready set and has to fit a task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["priority", "id"], ascending=[False, True], kind="stable")
        left, out = dict(capacity), []
        for needs in part["needs"]:
            wanted = {k: v for k, v in dict(needs or {}).items() if k in left and v is not None}
            fits = all(v <= left[k] for k, v in wanted.items())
            out.append(fits)
            if fits:
                for k, v in wanted.items():
                    left[k] -= v
        return part.assign(admitted=out)[["pool", "id", "admitted"]]

    rows = jobs.select(F.col(pool).cast("string").alias("pool"), F.col("id").cast("long").alias("id"), F.coalesce("priority", F.lit(0)).alias("priority"), "needs")
    return rows.groupBy("pool").applyInPandas(run, "pool string, id long, admitted boolean")


def needs_of(resources: dict[str, str]) -> dict[str, float]:
    """What a job needs, as numbers; what can't be read as one isn't limited."""
    out = {}
    for name, text in resources.items():
        m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([KMGT]?)i?B?\s*", text, re.I)
        if m:
            out[name] = float(m[1]) * {"": 1, "K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}[m[2].upper()]
    return out


def fits(needs: dict[str, float], running: list[dict[str, float]], capacity: dict[str, float]) -> bool:
    """Whether a job can start beside those that are running; resources without a capacity aren't limited."""
    return all(sum(r.get(k, 0.0) for r in running) + v <= capacity[k] for k, v in needs.items() if k in capacity)


def eviction(copies: DataFrame, budget: int, pool: str) -> DataFrame:
    """Which in-memory copies go, largest first, until a pool is within ``budget`` bytes.  One may go if nobody will read
    it any more (consumers = 0), it isn't pinned, and a copy on disk stays: the only copy of an output never goes.
    ``copies``: pool, ref, size, consumers, in_memory, on_disk, pinned."""
    held = copies.where("in_memory").withColumn("held", F.sum("size").over(Window.partitionBy(pool)))
    may = held.where("consumers = 0 and on_disk and not pinned")
    before = F.coalesce(F.sum("size").over(Window.partitionBy(pool).orderBy(F.desc("size"), "ref").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return may.withColumn("freed", before).where(F.col("held") - F.col("freed") > budget).select(pool, "ref", "size")


def tracked(copies: DataFrame, consumers: DataFrame) -> DataFrame:
    """``copies`` (ref, kind, size, pinned) by artifact: how many consumers (ref, done) still wait for it, where it is,
    and whether its copy in memory may go."""
    waiting = consumers.groupBy("ref").agg(F.count_if(~F.col("done")).alias("consumers"))
    kinds = {k: F.bool_or(F.col("kind") == k) for k in COPY_COST}
    by = copies.groupBy("ref").agg(F.max("size").alias("size"), F.bool_or("pinned").alias("pinned"), kinds["memory"].alias("in_memory"), kinds["disk"].alias("on_disk"))
    rows = by.join(waiting, "ref", "left").withColumn("consumers", F.coalesce("consumers", F.lit(0)))
    return rows.withColumn("evictable", F.expr("in_memory and on_disk and not pinned and consumers = 0"))


def memory_stats(tracked_: DataFrame) -> DataFrame:
    """One row over :func:`tracked`: artifacts and bytes in memory, and what of these may go."""
    inside, may = F.col("in_memory"), F.col("evictable")
    return tracked_.agg(
        F.count_if(inside).alias("in_memory"),
        F.coalesce(F.sum(F.when(inside, F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if(may).alias("evictable"),
        F.coalesce(F.sum(F.when(may, F.col("size"))), F.lit(0)).alias("evictable_bytes"),
    )


def cheapest_copy(copies: DataFrame) -> DataFrame:
    """The copy of each artifact that costs least to read; ties by kind."""
    cost = F.create_map(*[F.lit(x) for pair in COPY_COST.items() for x in pair])
    ranked = copies.withColumn("cost", F.try_element_at(cost, F.col("kind")))
    return ranked.groupBy("ref").agg(F.min_by("kind", F.struct("cost", "kind")).alias("kind"), F.min("cost").alias("cost"))


def root_causes(failures: DataFrame, part: list[str], order: list[str], line: str, n: int = 3) -> DataFrame:
    """The first place in each part where the last ``n`` failures end in the same line.  Failures without a line aren't
    in the sequence, and don't break it."""
    w = Window.partitionBy(*part).orderBy(*order)
    last = w.rowsBetween(-(n - 1), 0)
    rows = failures.where(F.col(line).isNotNull()).withColumn("_n", F.count("*").over(last)).withColumn("_low", F.min(line).over(last)).withColumn("_high", F.max(line).over(last))
    found = rows.where((F.col("_n") == n) & (F.col("_low") == F.col("_high")))
    return found.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_n", "_low", "_high", "_first")


def array_index(jobs: DataFrame, width: int = 100_000) -> DataFrame:
    """Jobs of a rule as one array: each with its index from 0 by id.  Indexes are counted within ranges of ``width`` ids
    and shifted by the ranges before, so a rule with most of the jobs isn't one task."""
    rows = jobs.withColumn("_range", F.floor(F.col("id") / width))
    held = rows.groupBy("rule_name", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("rule_name").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shift = held.select(F.col("rule_name").alias("_rule"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("rule_name", "_range").orderBy("id"))
    joined = rows.withColumn("_own", own).join(shift, F.col("rule_name").eqNullSafe(F.col("_rule")) & F.col("_range").eqNullSafe(F.col("_of")))
    return joined.withColumn("array_index", (F.col("_shift") + F.col("_own") - 1).cast("int")).drop("_range", "_own", "_rule", "_of", "_shift")


def cluster_totals(nodes: DataFrame) -> DataFrame:
    """One row over the nodes of a cluster (state, total, available: maps of resource to amount): nodes that are alive and
    those that are pending, and CPUs, GPUs and memory of the nodes that are alive, in all and available."""
    alive = F.col("state") == "ALIVE"
    sums = [F.coalesce(F.sum(F.when(alive, F.coalesce(F.try_element_at(F.col(side), F.lit(key)), F.lit(0.0)))), F.lit(0.0)).alias(f"{side}_{name}") for key, name in (("CPU", "cpus"), ("GPU", "gpus"), ("memory", "memory")) for side in ("total", "available")]
    return nodes.agg(F.count_if(alive).alias("alive_nodes"), F.count_if(F.col("state") == "PENDING").alias("pending_nodes"), *sums)


def resource_totals(nodes: DataFrame) -> DataFrame:
    """Sum of each resource over the nodes that are alive (state, resources: a map)."""
    return nodes.where("state = 'ALIVE'").select(F.explode("resources").alias("resource", "amount")).groupBy("resource").agg(F.sum("amount").alias("amount"))


def resumable(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """What can start when a run is taken up again: jobs without a terminal status whose upstream jobs all succeeded or
    were skipped.  A failed or cancelled upstream holds a job back."""
    pending = jobs.where(~F.col("status").isin("completed", "skipped", "failed", "cancelled"))
    unmet = edges.join(jobs.where(~F.col("status").isin("completed", "skipped")).select(F.col("id").alias("from_job")), "from_job").select(F.col("to_job").alias("id"))
    return pending.join(unmet, "id", "left_anti")

