"""Incremental execution: framed hashes, cache keys, validation of outputs, staleness and invalidation.

Keys are SHA-256 over length-framed fields, so no two field lists run into each other.

Spark guesses a table's size from the files that it comes from.  Keys, paths and hashes that are computed from a few small
columns are many times that, so where whole tables of them are looked up, joins are told to sort and merge: what is
broadcast on such a guess doesn't fit the driver."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.operators import graph
from loomwright.session import materialize

FORMAT = "loomwright-1"
MODES = ("mtime", "mtime_hash", "content_hash")


def framed(tag: str, value: Column) -> Column:
    """``len:tag1len:value``, or ``len:tag0`` where the value is null: absent and empty differ."""
    text = value.cast("string")
    head = F.lit(f"{len(tag)}:{tag}")
    return F.when(text.isNull(), F.concat(head, F.lit("0"))).otherwise(F.concat(head, F.lit("1"), F.octet_length(text).cast("string"), F.lit(":"), text))


def map_hash(values: Column) -> Column:
    """A hash of a text map by sorted key; null for a null map."""
    pairs = F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(framed("k", e["key"]), framed("v", e["value"])))
    return F.sha2(F.concat(F.size(values).cast("string"), F.lit(";"), F.array_join(pairs, "")), 256)


def cache_keys(jobs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(job_id, cache_key) of ``jobs`` (job_id, source, params, env, shell, platform: texts, params to platform may be
    null) with ``inputs`` (job_id, path, hash).  A job with an input without a hash has no key."""
    pair = F.struct("path", "hash")
    by = inputs.groupBy("job_id").agg(F.array_sort(F.collect_list(pair)).alias("pairs"), F.bool_or(F.col("hash").isNull()).alias("missing"))
    body = F.array_join(F.transform(F.coalesce("pairs", F.array().cast("array<struct<path:string,hash:string>>")), lambda p: F.concat(framed("input.path", p["path"]), framed("input.hash", p["hash"]))), "")
    count = F.coalesce(F.size("pairs"), F.lit(0))
    text = F.concat(framed("format", F.lit(FORMAT)), framed("rule", F.col("source")), framed("inputs.count", F.when(F.col("pairs").isNull(), F.lit(0)).otherwise(count)), body, framed("params", F.col("params")), framed("env", F.col("env")), framed("shell", F.col("shell")), framed("platform", F.col("platform")))
    return jobs.join(by, "job_id", "left").select("job_id", F.when(~F.coalesce("missing", F.lit(False)), F.sha2(text, 256)).alias("cache_key"))


def framed_text(tag: str, value: str | int | None) -> str:
    """:func:`framed` on the driver."""
    if value is None:
        return f"{len(tag)}:{tag}0"
    return f"{len(tag)}:{tag}1{len(str(value).encode())}:{value}"


def cache_key_of(source: str, inputs: list[tuple[str, str | None]], params: str | None, env: str | None, shell: str | None, platform: str) -> str | None:
    """:func:`cache_keys` for one job on the driver."""
    if any(h is None for _, h in inputs):
        return None
    body = "".join(framed_text("input.path", p) + framed_text("input.hash", h) for p, h in sorted(inputs))
    parts = [framed_text("format", FORMAT), framed_text("rule", source), framed_text("inputs.count", len(inputs)), body]
    parts += [framed_text(t, v) for t, v in (("params", params), ("env", env), ("shell", shell), ("platform", platform))]
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed_map(values: dict[str, str]) -> str | None:
    """A text map as one text in which no two maps are alike; None for an empty one."""
    return "".join(framed_text("k", k) + framed_text("v", v) for k, v in sorted(values.items())) or None


def env_hash(spec: str | dict | None, content: Callable[[str], bytes | None]) -> str | None:
    """A hash of an environment: of its specification, and of what is in the files that it names."""
    if spec is None:
        return None
    named = sorted({str(v) for v in (spec.values() if isinstance(spec, dict) else [spec])})
    text = framed_text("spec", json.dumps(spec, sort_keys=True))
    for name in named:
        found = content(name)
        if found is not None:
            text += framed_text("file", name) + framed_text("hash", hashlib.sha256(found).hexdigest())
    return hashlib.sha256(text.encode()).hexdigest()


def valid(mode: str, current_mtime: Column, current_size: Column, current_hash: Column, mtime: Column, size: Column, hash: Column) -> Column:
    """Whether a file is as recorded: by time and size, by these with the hash as a second look, or by the hash."""
    same_meta = F.coalesce((current_mtime == mtime) & (current_size == size), F.lit(False))
    same_hash = F.coalesce(current_hash == hash, F.lit(False))
    return {"mtime": same_meta, "mtime_hash": same_meta | same_hash, "content_hash": same_hash}[mode]


def lookup(jobs: DataFrame, outputs: DataFrame, entries: DataFrame, records: DataFrame, files: DataFrame, mode: str = "mtime_hash") -> DataFrame:
    """(job_id, status, path): hit, miss, missing or mismatch, with the first bad output by place.

    jobs: job_id, cache_key; outputs: job_id, place, path; entries: cache_key; records: cache_key, path, hash, mtime,
    size; files: path, hash, mtime, size as they are now."""
    keyed = jobs.select("job_id", "cache_key").join(entries.select("cache_key").distinct().withColumn("known", F.lit(True)).hint("merge"), "cache_key", "left")
    held = records.select("cache_key", "path", F.col("hash").alias("r_hash"), F.col("mtime").alias("r_mtime"), F.col("size").alias("r_size"))
    now = files.select("path", F.col("hash").alias("f_hash"), F.col("mtime").alias("f_mtime"), F.col("size").alias("f_size"), F.lit(True).alias("there"))
    each = keyed.join(outputs.hint("merge"), "job_id", "left").join(held.hint("merge"), ["cache_key", "path"], "left").join(now.hint("merge"), "path", "left")
    fine = valid(mode, F.col("f_mtime"), F.col("f_size"), F.col("f_hash"), F.col("r_mtime"), F.col("r_size"), F.col("r_hash"))
    state = F.when(F.col("path").isNull(), F.lit(None)).when(F.col("r_hash").isNull(), "miss").when(F.col("there").isNull(), "missing").when(~fine, "mismatch")
    bad = F.min(F.when(state.isNotNull(), F.struct("place", state.alias("state"), "path")))
    by = each.groupBy("job_id").agg(F.bool_or(F.coalesce("known", F.lit(False))).alias("known"), bad.alias("bad"))
    status = F.when(~F.col("known"), "miss").otherwise(F.coalesce("bad.state", F.lit("hit")))
    return by.select("job_id", status.alias("status"), F.when(F.col("known") & F.col("bad.state").isin("missing", "mismatch"), F.col("bad.path")).alias("path"))


def healed(entries: DataFrame, jobs: DataFrame, found: DataFrame) -> DataFrame:
    """The entries without those whose outputs were missing or changed."""
    bad = jobs.join(found.where(F.col("status").isin("missing", "mismatch")).hint("merge"), "job_id", "left_semi").select("cache_key")
    return entries.join(bad.hint("merge"), "cache_key", "left_anti")


def fresh_by_time(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(job_id, fresh) without any record: all outputs are there and newer than the newest input (mtime, null: absent)."""
    o = outputs.groupBy("job_id").agg(F.min("mtime").alias("oldest"), F.bool_or(F.col("mtime").isNull()).alias("absent"))
    i = inputs.groupBy("job_id").agg(F.max("mtime").alias("newest"))
    return o.join(i, "job_id", "left").select("job_id", (~F.col("absent") & (F.col("newest").isNull() | (F.col("oldest") > F.col("newest")))).alias("fresh"))


def stale(spark: SparkSession, found: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, reason) of all jobs to run: those that aren't hits with their own status, and all downstream of them
    (a closure is without its seeds)."""
    own = materialize(spark, found.where("status <> 'hit'").select(F.col("job_id").alias("id"), F.col("status").alias("reason")))
    below = graph.rdeps(spark, edges, own).select("id", F.lit("upstream").alias("reason"))
    return own.unionByName(below)


def orphans(entries: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of which an output is gone, with the number of outputs gone."""
    gone = records.join(files.select("path"), "path", "left_anti").groupBy("cache_key").agg(F.count("*").alias("gone"))
    return entries.select("cache_key").join(gone, "cache_key")


def invalidated(records: DataFrame, paths: DataFrame) -> DataFrame:
    """Keys of entries that have one of the paths as an output."""
    return records.join(paths.select("path"), "path", "left_semi").select("cache_key").distinct()


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The rows of both with the latest of each key."""
    latest = Window.partitionBy(*key).orderBy(F.desc(order))
    return old.unionByName(new).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def identity(kind: str, content: Column, spec: Column, external: Column) -> Column:
    """What stands for an artifact: the hash of its content, of the computation that makes it, or a name given to it."""
    return {"content": F.concat(F.lit("content:"), F.sha2(content, 256)), "computation": F.concat(F.lit("computation:"), F.sha2(spec, 256)), "external": F.concat(F.lit("external:"), external)}[kind]


def memoised(files: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with a known hash, files to hash): a file is known by path, mtime and size."""
    known = files.join(memo.select("path", "mtime", "size", F.col("hash")), ["path", "mtime", "size"])
    return known, files.join(memo.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")
