"""Queries over sessions, files, sinks and streams: each makes a small project in the scratch folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import parsing, patterns
from loomwright.operators import cache, snapshot
from loomwright.plans import views
from loomwright.plans.registry import query
from loomwright.plans.runner import Session
from loomwright.session import scratch, table
from loomwright.sources import files, sinks, workflow
from loomwright.streaming import events

_FLOW = """
[config]
region = [{regions}]
least = "3"
[rule.all]
input = ["out/report.parquet"]
[rule.clean]
input = {{ raw = "raw/{{region}}.parquet" }}
output = ["out/clean/{{region}}.parquet"]
params = {{ least = "{{config.least}}" }}
sql = "SELECT '{{wildcards.region}}' AS region, nation, suppliers FROM {{raw}} WHERE suppliers >= {{params.least}}"
[rule.report]
input = ["out/clean/{{region}}.parquet"]
output = ["out/report.parquet"]
sql = "SELECT region, count(*) AS nations, CAST(sum(suppliers) AS BIGINT) AS suppliers FROM {{input}} GROUP BY region"
"""


def _folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/{uuid.uuid4().hex}"


def _project(spark: SparkSession, sf: str) -> tuple[str, workflow.Workflow]:
    """Suppliers by nation, a file for each region, and the workflow over them."""
    root = _folder(spark)
    places = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by = places.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("suppliers"))
    names = sorted(r.r_name for r in table(spark, sf, "region").select("r_name").collect())
    for name in names:
        sinks.commit(by.where(F.col("region") == name).select("nation", "suppliers"), f"{root}/raw/{name}.parquet")
    return root, workflow.parse_workflow(_FLOW.format(regions=", ".join(f'"{n}"' for n in names)), root)


def _session(spark: SparkSession, root: str, flow: workflow.Workflow, **settings: str) -> Session:
    builder = Session.builder(flow).root(root)
    for key, value in settings.items():
        builder.config_override(key, value)
    return builder.build(spark)


_NATIONS = "n AS (SELECT r_name AS region, n_name AS nation, count(*) AS suppliers FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)"


@query(f"WITH {_NATIONS} SELECT region, count(*) AS nations, CAST(sum(suppliers) AS BIGINT) AS suppliers FROM n WHERE suppliers >= 3 GROUP BY region")
def session_report(spark: SparkSession, sf: str) -> DataFrame:
    """What a whole run writes: sources, keys, SQL bodies, formats and commits together."""
    root, flow = _project(spark, sf)
    assert _session(spark, root, flow).run().ok
    return spark.read.parquet(f"{root}/out/report.parquet")


_STEPS = """s AS (SELECT 'clean' AS rule, r_name AS region FROM region UNION ALL SELECT 'report', NULL),
j AS (SELECT rule, region, CASE WHEN region IS NULL THEN 'report' ELSE 'clean-' || replace(replace(region, '%', '%25'), '-', '%2D') END AS job_id FROM s)"""


@query(
    f"""WITH {_STEPS}, f AS (SELECT min(r_name) AS first FROM region)
SELECT step, job_id, CASE WHEN step = 'first' OR step = 'param' THEN 'run' WHEN step = 'tampered' AND (region IS NULL OR region = (SELECT first FROM f)) THEN 'run' ELSE 'skip' END AS action,
  CASE WHEN step = 'first' OR step = 'param' THEN 'never ran with these inputs' WHEN step = 'tampered' AND region = (SELECT first FROM f) THEN 'output changed: out/clean/' || region || '.parquet'
       WHEN step = 'tampered' AND region IS NULL THEN 'upstream runs' END AS reason
FROM j, (VALUES ('first'), ('again'), ('param'), ('tampered')) t(step)"""
)
def session_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why jobs run: at first, again without a change, with another parameter, after an output was overwritten."""
    root, flow = _project(spark, sf)
    plans = {"first": _session(spark, root, flow).plan().collect()}
    _session(spark, root, flow).run()
    plans["again"] = _session(spark, root, flow).plan().collect()
    plans["param"] = _session(spark, root, flow, least="5").plan().collect()
    first = flow.config["region"][0]
    sinks.commit(spark.range(3), f"{root}/out/clean/{first}.parquet")
    plans["tampered"] = _session(spark, root, flow).plan().collect()
    rows = [(step, r.job_id, r.action, r.reason) for step, found in plans.items() for r in found]
    return spark.createDataFrame(rows, "step string, job_id string, action string, reason string")


@query(f"WITH {_STEPS}, r AS (SELECT min(r_name) AS first FROM region) SELECT job_id, CASE WHEN region IS NULL OR region = (SELECT first FROM r) THEN 'run' ELSE 'skip' END AS action FROM j")
def session_rerun_after_edit(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs that one edited source makes run again: its own and those downstream."""
    root, flow = _project(spark, sf)
    _session(spark, root, flow).run()
    first = f"{root}/raw/{flow.config['region'][0]}.parquet"
    edited = spark.createDataFrame([("somewhere", 77)], "nation string, suppliers long")
    edited.write.mode("append").parquet(first)
    return _session(spark, root, flow).plan().select("job_id", "action")


@query(f"WITH {_STEPS} SELECT job_id, rule, CAST(CASE WHEN region IS NULL THEN 0 ELSE 1 END AS INTEGER) AS level FROM j")
def session_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs and levels of the default targets."""
    root, flow = _project(spark, sf)
    return _session(spark, root, flow).plan().select("job_id", "rule", "level")


@query(f"WITH {_STEPS} SELECT event, count(*) AS n FROM (SELECT unnest(['job_started', 'job_completed']) AS event FROM j UNION ALL SELECT 'run_started' UNION ALL SELECT 'run_completed') GROUP BY event")
def session_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events that a run writes to its log, read back as a batch."""
    root, flow = _project(spark, sf)
    s = _session(spark, root, flow)
    s.run()
    return events.parsed(spark.read.text(f"{s.state}/events")).groupBy("event").agg(F.count("*").alias("n"))


@query("SELECT 'report' AS id, ['sign-off'] AS gates")
def session_gates(spark: SparkSession, sf: str) -> DataFrame:
    """A gate before the report: the others run, the report waits for it."""
    root, flow = _project(spark, sf)
    flow.gates.append(workflow.Gate("sign-off", ["clean"], ["report"]))
    s = _session(spark, root, flow)
    result = s.run()
    assert result.waiting == ["report"] and len(result.executed) == len(flow.config["region"])
    return s.gates()


@query(
    f"""WITH {_STEPS} SELECT change, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN k = 'all' THEN 'unchanged' END AS change FROM j, (VALUES ('all')) v(k)
UNION ALL SELECT 'changed' FROM j UNION ALL SELECT 'kept' FROM (VALUES (1), (2)) UNION ALL SELECT 'deleted') GROUP BY change"""
)
def session_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots before and after a run: what changed, how many are kept, how many were deleted."""
    root, flow = _project(spark, sf)
    s = _session(spark, root, flow)
    s.snapshot("before")
    s.run()
    s.snapshot("after")
    s.snapshot("again")
    deleted = int(s.delete_snapshot("again")) + int(s.delete_snapshot("never"))
    s.snapshot("same")
    found = [tuple(r) for pair in (("after", "same"), ("before", "after")) for r in s.compare(*pair).groupBy("change").agg(F.count("*").alias("n")).collect()]
    s.delete_snapshot("same")
    return spark.createDataFrame([*found, ("kept", s.snapshots().count()), ("deleted", deleted)], "change string, n long")


@query("SELECT 'in/' || n_name || '.txt' AS path, CAST(octet_length(encode(n_name || '!')) + 1 AS BIGINT) AS size, sha256(n_name || '!' || chr(10)) AS hash FROM nation WHERE n_nationkey <= 3")
def files_hashed(spark: SparkSession, sf: str) -> DataFrame:
    """Discovery and hashes: the second look takes all but the new file from the memo."""
    root, names = _folder(spark), [r.n_name for r in table(spark, sf, "nation").where("n_nationkey <= 3").collect()]
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(name: str) -> None:
        out = fs.create(fs_path(f"{root}/in/{name}.txt"))
        out.write(bytearray(f"{name}!\n".encode()))
        out.close()

    for name in names[:-1]:
        put(name)
    seen = files.with_hashes(spark, files.discover(spark, root), root).select("path", "mtime", "size", "hash").collect()
    memo = spark.createDataFrame(seen, "path string, mtime long, size long, hash string")
    put(names[-1])
    return files.with_hashes(spark, files.discover(spark, root), root, memo).select("path", "size", "hash")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def artifact_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Stored under a key, checked again and given out; what is stored later under the key doesn't replace it."""
    root, rows = _folder(spark), table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    sinks.store_artifact(rows, root, "ab12")
    sinks.store_artifact(rows.limit(1), root, "ab12")
    return sinks.fetch_artifact(spark, root, "ab12")


@query("SELECT 'rule_execution_changed' AS kind, 'r' || p_partkey AS name FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT 'input_removed', 'i' || s_suppkey FROM supplier WHERE s_suppkey % 8 = 0")
def lock_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A lock that is written, read back and held against a later state."""
    k, s, path = F.col("p_partkey"), F.col("s_suppkey"), _folder(spark)
    rules = table(spark, sf, "part").select(F.concat(F.lit("r"), k.cast("string")).alias("name"), F.lit("e").alias("execution_hash"), F.lit("p").alias("params_hash"), k)
    inputs = table(spark, sf, "supplier").select(F.concat(F.lit("i"), s.cast("string")).alias("path"), F.lit("h").alias("hash"), s)
    sinks.write_lock(spark, rules, inputs, path)
    locked = sinks.read_lock(spark, path)
    return snapshot.drift(locked[0], rules.withColumn("execution_hash", F.when(k % 9 == 0, "other").otherwise("e")), locked[1], inputs.where("s_suppkey % 8 <> 0"))


@query(
    """SELECT l_orderkey AS job_id, l_linenumber, printf('%.4f', ms / 1000.0) AS s, printf('%d:%02d:%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60) AS clock, printf('%.2f', l_linenumber / 4.0) AS cpu_time
FROM (SELECT *, CAST(l_partkey AS BIGINT) * 1777 AS ms FROM lineitem)"""
)
def benchmark_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("job_id"), (F.col("l_partkey").cast("long") * 1777).alias("wall_ms"), F.lit(0).alias("max_rss"), (F.col("l_linenumber") / 4.0).alias("cpu_s"))
    out = sinks.benchmark_rows(rows)
    return out.select(F.col("job_id.l_orderkey").alias("job_id"), "job_id.l_linenumber", "s", F.col("`h:m:s`").alias("clock"), "cpu_time")


@query("""SELECT event_id, '{"event":"' || event || '","job_id":"' || job_id || '"' || CASE WHEN duration_ms IS NULL THEN '' ELSE ',"duration_ms":' || duration_ms END || '}' AS value FROM engine_events""", ("engine_events",))
def event_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = views.engine_events(spark, sf)
    line = F.to_json(F.struct("event", "job_id", "duration_ms"))
    assert sinks.event_lines(e.select("event", "job_id", "duration_ms")).columns == ["value"]
    return e.select("event_id", line.alias("value"))


@query("""SELECT 'id: ' || event_id || chr(10) || 'event: ' || event || chr(10) || 'data: {"event":"' || event || '","job_id":"' || job_id || '","seq":' || event_id || '}' || chr(10) || chr(10) AS value FROM engine_events""", ("engine_events",))
def event_sse_frames(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.sse_frames(views.engine_events(spark, sf).select("event", "job_id", F.col("event_id").cast("long").alias("seq")))


_FOLD = """SELECT job_id, arg_max(CASE event WHEN 'job_queued' THEN 'pending' WHEN 'job_started' THEN 'running' WHEN 'job_completed' THEN 'completed' WHEN 'job_failed' THEN 'failed' WHEN 'job_skipped' THEN 'skipped' END,
  CASE WHEN event IN ('job_completed', 'job_failed', 'job_skipped') THEN 1000000000000 ELSE 0 END + event_id) AS status FROM engine_events WHERE event IN ('job_queued', 'job_started', 'job_completed', 'job_failed', 'job_skipped') GROUP BY job_id"""


@query(_FOLD, ("engine_events",))
def event_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a stream, through the bridge into the ledger, in several micro-batches."""
    root = _folder(spark)
    log = views.engine_events(spark, sf).select("event", "job_id", F.col("event_id").cast("long").alias("seq"), "duration_ms")
    sinks.append_events(log.repartition(4), f"{root}/log")
    events.bridge(events.follow(spark, f"{root}/log", per_trigger=2), events.ledger_sink(f"{root}/ledger"), f"{root}/checkpoint", f"bridge-{uuid.uuid4().hex}").awaitTermination()
    return events.folded_ledger(spark, f"{root}/ledger")


@query("SELECT 2 AS files, 1 AS followed")
def event_follow_new(spark: SparkSession, sf: str) -> DataFrame:
    """Without replay only what is written after the start comes: of two files the later one."""
    import time

    root = _folder(spark)
    line = spark.createDataFrame([('{"event":"job_started","job_id":"a"}',)], "value string")
    line.coalesce(1).write.mode("append").text(f"{root}/log")
    time.sleep(2.1)  # times of files are compared in seconds
    stream = events.follow(spark, f"{root}/log", replay=False)
    line.coalesce(1).write.mode("append").text(f"{root}/log")
    events.bridge(stream, events.ledger_sink(f"{root}/ledger"), f"{root}/checkpoint", f"new-{uuid.uuid4().hex}").awaitTermination()
    return spark.createDataFrame([(spark.read.text(f"{root}/log").count(), spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/ledger").count())], "files int, followed int")


# functions of the driver, over the rows of small tables


def _by_nation(spark: SparkSession, sf: str, function, schema: str) -> DataFrame:
    return spark.createDataFrame([(r.n_nationkey, function(r.n_nationkey, r.n_name)) for r in table(spark, sf, "nation").select("n_nationkey", "n_name").collect()], f"n_nationkey {table(spark, sf, 'nation').schema['n_nationkey'].dataType.simpleString()}, {schema}")


@query("SELECT n_nationkey, 'out/' || n_name || '/{config.missing}/' || n_nationkey AS text FROM nation")
def config_substitution(spark: SparkSession, sf: str) -> DataFrame:
    return _by_nation(spark, sf, lambda k, name: patterns.config_substituted("{config.dir}/{config.name}/{config.missing}/{config.key}", {"dir": "out", "name": name, "key": str(k)}, strict=False), "text string")


@query("SELECT n_nationkey, 'load raw/' || n_name || '.csv extra.csv -n ' || n_nationkey || ' -m fast --threads 4 > out/' || n_name || '.parquet; echo ' || n_name || ' raw/' || n_name || '.csv extra.csv' AS text FROM nation")
def command_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    text = "load {input.raw} {input[1]} -n {params.n} -m {config.mode} --threads {threads} > {output[0]}; echo {wildcards.name} {input}"
    return _by_nation(spark, sf, lambda k, name: patterns.command(text, [("raw", f"raw/{name}.csv"), (None, "extra.csv")], [(None, f"out/{name}.parquet")], {"name": name}, {"n": str(k)}, {"mode": "fast"}, {"cpu": "4"}), "text string")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'b/' || n_name ELSE '../' || n_name END AS text FROM nation")
def path_normal_form(spark: SparkSession, sf: str) -> DataFrame:
    return _by_nation(spark, sf, lambda k, name: patterns.normal_path(f"/root/x/./a/../b//{name}" if k % 2 == 0 else f"a/../../{name}/.", "/root/x"), "text string")


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN CAST(n_nationkey AS VARCHAR) WHEN 1 THEN n_nationkey || '.5' WHEN 2 THEN 'True' ELSE chr(39) || n_name || chr(39) END AS text FROM nation")
def call_literals(spark: SparkSession, sf: str) -> DataFrame:
    return _by_nation(spark, sf, lambda k, name: parsing.kwarg_literal([str(k), f"{k}.5", "true", name][k % 4]), "text string")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'outside' ELSE 'root/' || n_name || '/x' END AS text FROM nation")
def path_confinement(spark: SparkSession, sf: str) -> DataFrame:
    def put(k: int, name: str) -> str:
        try:
            return sinks.confined("root", [f"../{name}", f"{name}/./y/../x", f"a/../{name}/x"][k % 3])
        except sinks.OutsideError:
            return "outside"

    return _by_nation(spark, sf, put, "text string")


@query("SELECT n_nationkey, n_nationkey % 2 = 1 AS changed FROM nation")
def environment_hash(spark: SparkSession, sf: str) -> DataFrame:
    """The hash follows the content of the files that a specification names."""
    return _by_nation(spark, sf, lambda k, name: cache.env_hash({"requirements": "r.txt"}, lambda _: b"a") != cache.env_hash({"requirements": "r.txt"}, lambda _: [b"a", name.encode()][k % 2]), "changed boolean")
