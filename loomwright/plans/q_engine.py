"""Queries over patterns, guards, expansion, cache, snapshots, policies and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import guards, parsing, patterns
from loomwright.operators import cache, expand, policy, snapshot
from loomwright.plans import views
from loomwright.plans.registry import query
from loomwright.session import table

URL = patterns.parse_pattern("https://{host}/{path}")
_URL_CONSTRAINTS = {"path": r"[^?#]+"}


@query(r"SELECT page_id, regexp_extract(url, '^https://([^/]+)/([^?#]+)$', 1) AS host, regexp_extract(url, '^https://([^/]+)/([^?#]+)$', 2) AS path FROM pages WHERE regexp_matches(url, '^https://([^/]+)/([^?#]+)$')")
def pattern_resolve(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "pages").select("page_id", patterns.resolve(URL, F.col("url"), _URL_CONSTRAINTS).alias("w")).where("w is not null")
    return found.select("page_id", F.element_at("w", "host").alias("host"), F.element_at("w", "path").alias("path"))


@query("SELECT s_suppkey, 'data/' || s_nationkey || '/' || s_name || '.csv' AS path FROM supplier")
def pattern_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    w = F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("name"), F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", patterns.interpolate(patterns.parse_pattern("data/{nation}/{name}.csv"), w).alias("path"))


@query("SELECT c_custkey, 'load-' || replace(replace(c_mktsegment, '%', '%25'), '-', '%2D') || '-' || c_nationkey AS job_id FROM customer")
def pattern_job_id(spark: SparkSession, sf: str) -> DataFrame:
    w = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("a_segment"), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", patterns.job_id(F.lit("load"), w).alias("job_id"))


_RULES = [
    expand.RuleSpec("any_page", outputs=["https://{host}/{path}"], priority=1, constraints={"path": ".+"}),
    expand.RuleSpec("plain_page", outputs=["https://{host}/{path}"], priority=5, constraints={"path": "[^?#]+"}),
    expand.RuleSpec("insecure", outputs=["http://{host}/{path}"], priority=1, constraints={"path": ".+"}),
    expand.RuleSpec("insecure_too", outputs=["http://{host}/{path}"], priority=1, constraints={"path": "[a-z].*"}),
]


@query(
    r"""WITH p AS (SELECT page_id, url, regexp_matches(url, '^https://([^/]+)/(.+)$') AS a, regexp_matches(url, '^https://([^/]+)/([^?#]+)$') AS b,
  regexp_matches(url, '^http://([^/]+)/(.+)$') AS c, regexp_matches(url, '^http://([^/]+)/([a-z].*)$') AS d FROM pages)
SELECT page_id, CASE WHEN b THEN 'plain_page' WHEN a THEN 'any_page' WHEN c AND NOT d THEN 'insecure' WHEN d AND NOT c THEN 'insecure_too' END AS rule,
  CASE WHEN NOT a AND NOT c AND NOT d THEN 'no producer' WHEN NOT a AND c AND d THEN 'ambiguous: insecure, insecure_too' END AS error FROM p"""
)
def pattern_producer_priority(spark: SparkSession, sf: str) -> DataFrame:
    return expand.choose(table(spark, sf, "pages").select("page_id", "url"), _RULES, "url").select("page_id", "rule", "error")


@query(r"SELECT n_nationkey, n_name FROM nation WHERE NOT regexp_matches(n_name, '^(?:[A-Za-z_]*1[0-9]*)$')")
def pattern_constraints(spark: SparkSession, sf: str) -> DataFrame:
    w = F.create_map(F.lit("name"), F.col("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", "n_name").where(~patterns.within({"name": "[A-Za-z_]*1[0-9]*"}, w))


@query("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'explicit' END, n_name) AS name, 'r' || n_regionkey AS region FROM nation")
def pattern_tags(spark: SparkSession, sf: str) -> DataFrame:
    wild = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    own = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("name"), F.lit("explicit"))).otherwise(F.create_map().cast("map<string,string>"))
    tags = table(spark, sf, "nation").select("n_nationkey", patterns.with_tags(own, wild).alias("t"))
    return tags.select("n_nationkey", F.element_at("t", "name").alias("name"), F.element_at("t", "region").alias("region"))


@query(
    """SELECT c_custkey,
  coalesce(seg IN ('BUILDING', 'MACHINERY'), false) AS in_list, NOT coalesce(seg IN ('BUILDING', 'MACHINERY'), false) AS not_in_list,
  coalesce(seg = 'BUILDING', false) AS eq, NOT coalesce(seg = 'BUILDING', false) AS not_eq, coalesce(regexp_matches(seg, 'UIL'), false) AS regex,
  true AS config_eq, false AS env_set, true AS env_eq, false AS file_exists,
  coalesce(seg = 'BUILDING', false) AND coalesce(seg IN ('BUILDING', 'MACHINERY'), false) AS both, coalesce(seg = 'BUILDING', false) OR coalesce(regexp_matches(seg, '^H'), false) AS either,
  NOT coalesce(regexp_matches(seg, '^H'), false) AS negated FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS seg FROM customer)"""
)
def guard_all_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Each operator over a wildcard that is missing for every seventh row."""
    wild = F.when(F.col("c_custkey") % 7 != 0, F.create_map(F.lit("seg"), F.col("c_mktsegment"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = table(spark, sf, "customer").select("c_custkey", wild.alias("w"))
    config, environ = {"segments": ["BUILDING", "MACHINERY"], "mode": "fast"}, {"EMPTY": "", "SITE": "a"}
    inside, same, rx = {"op": "in", "field": "seg", "values": "@segments"}, {"op": "eq", "field": "seg", "value": "BUILDING"}, {"op": "regex", "field": "seg", "pattern": "^H"}
    all_ops = {
        "in_list": inside,
        "not_in_list": inside | {"op": "not_in"},
        "eq": same,
        "not_eq": same | {"op": "not_eq"},
        "regex": rx | {"pattern": "UIL"},
        "config_eq": {"op": "config_eq", "key": "mode", "value": "fast"},
        "env_set": {"op": "env_set", "name": "EMPTY"},
        "env_eq": {"op": "env_eq", "name": "SITE", "value": "a"},
        "file_exists": {"op": "file_exists", "path": "nothing"},
        "both": {"op": "and", "guards": [same, inside]},
        "either": {"op": "or", "guards": [same, rx]},
        "negated": {"op": "not", "guard": rx},
    }
    return rows.select("c_custkey", *[guards.as_column(g, F.col("w"), config, environ, lambda _: False).alias(n) for n, g in all_ops.items()])


def _names(spark: SparkSession, sf: str, name: str, column: str) -> list[str]:
    """A dimension list: the distinct values of a small table's column, in order."""
    return [r[0] for r in table(spark, sf, name).select(column).distinct().orderBy(column).collect()]


@query("SELECT n_name AS nation, r_name AS region, CAST(row_number() OVER (ORDER BY n_name, r_name) - 1 AS BIGINT) AS n FROM (SELECT DISTINCT n_name FROM nation), (SELECT DISTINCT r_name FROM region)")
def expand_product(spark: SparkSession, sf: str) -> DataFrame:
    return expand.product(spark, {"nation": _names(spark, sf, "nation", "n_name"), "region": _names(spark, sf, "region", "r_name")})


@query("SELECT 'v' || range AS a, 'w' || range AS b, range AS n FROM range(40)")
def expand_zip(spark: SparkSession, sf: str) -> DataFrame:
    return expand.zipped(spark, {"a": [f"v{k}" for k in range(40)], "b": [f"w{k}" for k in range(40)]})


@query("SELECT CAST(row_number() OVER (ORDER BY r_name) - 1 AS BIGINT) AS n, 'out/' || r_name || '.parquet' AS path FROM region")
def expand_target_plural(spark: SparkSession, sf: str) -> DataFrame:
    return expand.expand_target(spark, "{config.dir}/{region}.parquet", {"dir": "out", "regions": _names(spark, sf, "region", "r_name")})


@query("SELECT c_mktsegment AS value, min(c_custkey) AS first_row FROM customer WHERE trim(c_mktsegment) <> '' GROUP BY c_mktsegment")
def expand_from_csv_dims(spark: SparkSession, sf: str) -> DataFrame:
    """The ordered-distinct, non-empty values of a key column, as a dimension list has them."""
    c = table(spark, sf, "customer").select(F.trim("c_mktsegment").alias("value"), "c_custkey").where("value <> ''")
    return c.groupBy("value").agg(F.min("c_custkey").alias("first_row"))


_FLOW = [
    expand.RuleSpec("all", inputs=["report.txt"], outputs=["done"]),
    expand.RuleSpec("report", inputs=["part/{nation}.parquet"], outputs=["report.txt"]),
    expand.RuleSpec("part", inputs=["raw/{nation}.csv"], outputs=["part/{nation}.parquet"]),
]


@query(
    """SELECT 'all' AS job_id, 'all' AS rule, 0 AS level UNION ALL SELECT 'report', 'report', 1
UNION ALL SELECT 'part-' || replace(replace(n_name, '%', '%25'), '-', '%2D'), 'part', 2 FROM nation"""
)
def expand_backward_chain(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation")
    there = nations.select(F.concat(F.lit("raw/"), "n_name", F.lit(".csv")).alias("path"))
    config = {"nations": _names(spark, sf, "nation", "n_name")}
    jobs, _, _ = expand.chain(spark, _FLOW, config, spark.createDataFrame([("done",)], "path string"), there)
    return jobs.select("job_id", "rule", "level")


_LAYERS = [
    expand.RuleSpec("finalize", inputs=["proc/{i}"], outputs=["final/{i}"]),
    expand.RuleSpec("gen", inputs=["seed"], outputs=["gen/{i}"]),
    expand.RuleSpec("merge", inputs=["final/{i}"], outputs=["merged"]),
    expand.RuleSpec("process", inputs=["gen/{i}"], outputs=["proc/{i}"]),
    expand.RuleSpec("seed", outputs=["seed"]),
]


@query("SELECT 'merge' AS job_id, 0 AS level UNION ALL SELECT 'seed', 4 UNION ALL SELECT rule || '-' || range, level FROM range(3333), (VALUES ('finalize', 1), ('process', 2), ('gen', 3)) v(rule, level)")
def resolve_four_layers(spark: SparkSession, sf: str) -> DataFrame:
    """A graph of 3 * 3333 + 2 = 10,001 jobs in four layers, resolved on the driver as sessions do."""
    jobs, _ = expand.chain_local(_LAYERS, {"i": [str(k) for k in range(3333)]}, ["merged"], set())
    return spark.createDataFrame([(j.id, j.level) for j in jobs.values()], "job_id string, level int")


@query("SELECT event_id, event, tag_k FROM engine_events WHERE event IN ('job_failed', 'job_completed') AND tag_k = '7'", ("engine_events",))
def tag_filter(spark: SparkSession, sf: str) -> DataFrame:
    return views.engine_events(spark, sf).where(F.col("event").isin("job_failed", "job_completed") & (F.col("tag_k") == "7")).select("event_id", "event", "tag_k")


@query("SELECT id, rule_name FROM jobs WHERE regexp_matches(rule_name, 'URG|LOW')", ("jobs",))
def rule_filter(spark: SparkSession, sf: str) -> DataFrame:
    return views.jobs(spark, sf).where(F.col("rule_name").rlike("URG|LOW")).select("id", "rule_name")


# cache: jobs are orders, inputs are their lines, outputs are parts


def _framed(tag: str, value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"CASE WHEN {value} IS NULL THEN '{len(tag)}:{tag}0' ELSE '{len(tag)}:{tag}1' || octet_length(encode({text})) || ':' || {text} END"


_PATH, _HASH = "'in/' || l_partkey", "sha256(CAST(l_suppkey AS VARCHAR))"


@query(
    f"""WITH p AS (SELECT l_orderkey, string_agg({_framed('input.path', '(path)')} || {_framed('input.hash', '(hash)')}, '' ORDER BY path, hash) AS body, count(*) AS n, bool_or(hash IS NULL) AS missing
  FROM (SELECT l_orderkey, {_PATH} AS path, CASE WHEN l_linenumber % 7 <> 0 THEN {_HASH} END AS hash FROM lineitem) GROUP BY l_orderkey)
SELECT o_orderkey AS job_id, CASE WHEN NOT coalesce(missing, false) THEN sha256({_framed('format', f"('{cache.FORMAT}')")} || {_framed('rule', '(o_orderpriority)')} || {_framed('inputs.count', '(coalesce(n, 0))')} || coalesce(body, '')
  || {_framed('params', "(CASE WHEN o_orderkey % 2 = 0 THEN 'p' || o_custkey END)")} || {_framed('env', '(NULL)')} || {_framed('shell', '(NULL)')} || {_framed('platform', "('spark')")}) END AS cache_key FROM orders LEFT JOIN p ON l_orderkey = o_orderkey"""
)
def cache_key(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    jobs = table(spark, sf, "orders").select(key.alias("job_id"), F.col("o_orderpriority").alias("source"), F.when(key % 2 == 0, F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).alias("params"), F.lit(None).cast("string").alias("env"), F.lit(None).cast("string").alias("shell"), F.lit("spark").alias("platform"))
    inputs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("in/"), F.col("l_partkey").cast("string")).alias("path"), F.when(F.col("l_linenumber") % 7 != 0, F.sha2(F.col("l_suppkey").cast("string"), 256)).alias("hash"))
    return cache.cache_keys(jobs, inputs)


def _cache_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k, "p_size")
    name = F.concat(F.lit("k"), k.cast("string"))
    each = p.select(k, "p_size", F.explode(F.array(F.lit(0), F.lit(1))).alias("place"))
    path = F.concat(F.lit("out/"), k.cast("string"), F.lit("-"), F.col("place").cast("string"))
    hashed = F.sha2(path, 256)
    size = F.col("p_size").cast("long")
    return {
        "jobs": p.select(k.alias("job_id"), name.alias("cache_key")),
        "outputs": each.select(k.alias("job_id"), "place", path.alias("path")),
        "entries": p.where("p_partkey % 10 <> 3").select(name.alias("cache_key")),
        "records": each.where("(p_partkey + place) % 11 <> 5").select(name.alias("cache_key"), path.alias("path"), hashed.alias("hash"), (k * 1000).alias("mtime"), size.alias("size")),
        "files": each.where("(p_partkey + place) % 7 <> 2").select(path.alias("path"), F.when(k % 13 == 4, F.sha2(F.lit("new"), 256)).otherwise(hashed).alias("hash"), (k * 1000 + F.when(k % 3 == 0, 1).otherwise(0)).alias("mtime"), size.alias("size")),
    }


_CACHE = """e AS (SELECT p_partkey AS k, place, p_size, 'out/' || p_partkey || '-' || place AS path FROM part, (VALUES (0), (1)) v(place)),
s AS (SELECT k, place, path, CASE WHEN (k + place) % 11 = 5 THEN 'miss' WHEN (k + place) % 7 = 2 THEN 'missing'
  WHEN NOT ({0}) THEN 'mismatch' END AS state FROM e),
b AS (SELECT k, k % 10 <> 3 AS known, arg_min(state, place) FILTER (WHERE state IS NOT NULL) AS state, arg_min(path, place) FILTER (WHERE state IS NOT NULL) AS path FROM s GROUP BY k),
r AS (SELECT k AS job_id, CASE WHEN NOT known THEN 'miss' ELSE coalesce(state, 'hit') END AS status, CASE WHEN known AND state IN ('missing', 'mismatch') THEN path END AS path FROM b)"""


@query(f"WITH {_CACHE.format('k % 3 <> 0 OR k % 13 <> 4')} SELECT * FROM r")
def cache_lookup_status(spark: SparkSession, sf: str) -> DataFrame:
    return cache.lookup(**_cache_tables(spark, sf), mode="mtime_hash")


@query(f"WITH {_CACHE.format('k % 3 <> 0')} SELECT * FROM r")
def cache_lookup_mtime(spark: SparkSession, sf: str) -> DataFrame:
    return cache.lookup(**_cache_tables(spark, sf), mode="mtime")


@query(f"WITH {_CACHE.format('k % 13 <> 4')} SELECT * FROM r")
def cache_lookup_content(spark: SparkSession, sf: str) -> DataFrame:
    return cache.lookup(**_cache_tables(spark, sf), mode="content_hash")


@query(f"WITH {_CACHE.format('k % 13 <> 4')} SELECT 'k' || p_partkey AS cache_key FROM part WHERE p_partkey % 10 <> 3 AND p_partkey NOT IN (SELECT job_id FROM r WHERE status IN ('missing', 'mismatch'))")
def cache_self_heal(spark: SparkSession, sf: str) -> DataFrame:
    t = _cache_tables(spark, sf)
    return cache.healed(t["entries"], t["jobs"], cache.lookup(**t, mode="content_hash"))


@query("SELECT p_partkey AS job_id, p_partkey % 5 <> 0 AND p_size > coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 50 END, -1) AS fresh FROM part")
def cache_mtime_stateless(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    outputs = p.select(k.alias("job_id"), F.when(k % 5 != 0, F.col("p_size")).cast("long").alias("mtime"))
    return cache.fresh_by_time(outputs, p.where("p_partkey % 4 <> 0").select(k.alias("job_id"), (k % 50).alias("mtime")))


@query(
    f"""WITH {_CACHE.format('k % 3 <> 0 OR k % 13 <> 4')},
o AS (SELECT job_id AS id, status AS reason FROM r WHERE status <> 'hit'), d AS (SELECT id FROM o UNION SELECT e.to_job FROM job_edges e JOIN d ON e.from_job = d.id)
SELECT id, coalesce(reason, 'upstream') AS reason FROM d LEFT JOIN o USING (id)""",
    ("job_edges",),
    recursive=True,
)
def cache_stale_propagation(spark: SparkSession, sf: str) -> DataFrame:
    """All jobs that aren't hits are origins, with their own status."""
    return cache.stale(spark, cache.lookup(**_cache_tables(spark, sf), mode="mtime_hash"), views.job_edges(spark, sf))


@query("WITH e AS (SELECT p_partkey AS k, place FROM part, (VALUES (0), (1)) v(place)) SELECT 'k' || k AS cache_key, count(*) AS gone FROM e WHERE (k + place) % 11 <> 5 AND (k + place) % 7 = 2 AND k % 10 <> 3 GROUP BY k")
def cache_orphans(spark: SparkSession, sf: str) -> DataFrame:
    t = _cache_tables(spark, sf)
    return cache.orphans(t["entries"], t["records"], t["files"])


@query("SELECT DISTINCT 'k' || p_partkey AS cache_key FROM part, (VALUES (0), (1)) v(place) WHERE (p_partkey + place) % 11 <> 5 AND place = 1 AND p_partkey % 9 = 0")
def cache_invalidate(spark: SparkSession, sf: str) -> DataFrame:
    t = _cache_tables(spark, sf)
    return cache.invalidated(t["records"], t["outputs"].where("place = 1 and job_id % 9 = 0"))


@query("WITH a AS (SELECT user_id AS k, event_id AS v, epoch_us(ts) AS t FROM events) SELECT k, arg_max(v, CAST(t AS HUGEINT) * 1000000 + v % 1000000) AS v FROM a GROUP BY k")
def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), (F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(38,0)") * 1000000 + F.col("event_id") % 1000000).alias("t"))
    return cache.upserted(e.where("v % 2 = 0"), e.where("v % 2 = 1"), ["k"], "t").select("k", "v")


@query("SELECT p_partkey, 'content:' || sha256(p_name) AS by_content, 'computation:' || sha256(p_type) AS by_computation, 'external:' || p_brand AS by_name FROM part")
def cache_identity(spark: SparkSession, sf: str) -> DataFrame:
    args = (F.col("p_name"), F.col("p_type"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", *[cache.identity(k, *args).alias(n) for k, n in (("content", "by_content"), ("computation", "by_computation"), ("external", "by_name"))])


# snapshots and locks

_DIFF = """WITH b AS (SELECT * FROM snapshot_jobs WHERE snapshot_name = 'before'), a AS (SELECT * FROM snapshot_jobs WHERE snapshot_name = 'after'),
d AS (SELECT coalesce(b.job_id, a.job_id) AS job_id, CASE WHEN b.job_id IS NULL THEN 'added' WHEN a.job_id IS NULL THEN 'removed'
  WHEN b.status IS DISTINCT FROM a.status OR b.output_hashes IS DISTINCT FROM a.output_hashes THEN 'changed' ELSE 'unchanged' END AS change,
  b.status AS old_status, a.status AS new_status, b.output_hashes IS DISTINCT FROM a.output_hashes AS outputs_changed FROM b FULL JOIN a ON a.job_id = b.job_id)"""


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = views.snapshot_jobs(spark, sf)
    return s.where("snapshot_name = 'before'"), s.where("snapshot_name = 'after'")


@query(f"{_DIFF} SELECT * FROM d", ("jobs", "snapshot_jobs"))
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot.diff(*_both(spark, sf))


@query(f"{_DIFF} SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'changed') AS changed, count(*) FILTER (WHERE change = 'unchanged') AS unchanged FROM d", ("jobs", "snapshot_jobs"))
def snapshot_diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot.summary(snapshot.diff(*_both(spark, sf)))


@query("SELECT name, created_at, count(job_id) AS jobs FROM (VALUES ('before', 1), ('after', 2), ('empty', 3)) v(name, created_at) LEFT JOIN snapshot_jobs ON snapshot_name = name GROUP BY ALL", ("jobs", "snapshot_jobs"))
def snapshot_list(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("before", 1), ("after", 2), ("empty", 3)], "name string, created_at int")
    return snapshot.listing(names, views.snapshot_jobs(spark, sf))


@query("SELECT DISTINCT job_id FROM snapshot_jobs", ("jobs", "snapshot_jobs"))
def snapshot_ids(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot.ids(*_both(spark, sf))


@query(
    """SELECT kind, name FROM (SELECT 'r' || p_partkey AS name, p_partkey AS k, unnest([
    CASE WHEN k % 11 <> 0 AND k % 10 = 0 THEN NULL WHEN k % 11 = 0 AND k % 10 <> 0 THEN 'rule_removed' WHEN k % 10 = 0 AND k % 11 <> 0 THEN 'rule_added' END,
    CASE WHEN k % 10 = 0 AND k % 11 <> 0 THEN 'rule_added' END,
    CASE WHEN k % 10 <> 0 AND k % 11 <> 0 AND k % 7 = 0 THEN 'rule_execution_changed' END,
    CASE WHEN k % 10 <> 0 AND k % 11 <> 0 AND k % 5 = 1 THEN 'rule_params_changed' END]) AS kind FROM part) WHERE kind IS NOT NULL
UNION ALL SELECT kind, name FROM (SELECT 'i' || s_suppkey AS name, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 4 = 0 THEN 'input_removed' WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 <> 0 THEN 'input_added'
  WHEN s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0 AND s_suppkey % 5 = 0 THEN 'input_changed' END AS kind FROM supplier) WHERE kind IS NOT NULL"""
)
def lock_drift(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("p_partkey"), table(spark, sf, "part")
    name = F.concat(F.lit("r"), k.cast("string"))
    locked = p.where("p_partkey % 10 <> 0").select(name.alias("name"), F.sha2("p_name", 256).alias("execution_hash"), F.lit("p").alias("params_hash"))
    now = p.where("p_partkey % 11 <> 0").select(name.alias("name"), F.when(k % 7 == 0, "new").otherwise(F.sha2("p_name", 256)).alias("execution_hash"), F.when(k % 5 == 1, "q").otherwise("p").alias("params_hash"))
    s, i = table(spark, sf, "supplier"), F.concat(F.lit("i"), F.col("s_suppkey").cast("string"))
    old = s.where("s_suppkey % 3 <> 0").select(i.alias("path"), F.lit("h").alias("hash"))
    new = s.where("s_suppkey % 4 <> 0").select(i.alias("path"), F.when(F.col("s_suppkey") % 5 == 0, "g").otherwise("h").alias("hash"))
    return snapshot.drift(locked, now, old, new)


# policies


@query("SELECT policy, leaf, true AS keep_object, policy = 'always' OR (policy = 'final' AND leaf) AS write_file, policy = 'never' AS evict_after_readers FROM (VALUES ('always'), ('auto'), ('never'), ('final')) p(policy), (VALUES (true), (false)) l(leaf)")
def policy_materialize(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(p, leaf) for p in ("always", "auto", "never", "final") for leaf in (True, False)], "policy string, leaf boolean")
    return rows.select("policy", "leaf", policy.materialize_strategy(F.col("policy"), F.col("leaf")).alias("s")).select("policy", "leaf", "s.*")


@query(
    """WITH w AS (SELECT p_partkey AS job_id, unnest(range(1, p_size % 6 + 1)) AS attempt, ['constant', 'linear', 'exponential'][p_partkey % 3 + 1] AS backoff FROM part),
x AS (SELECT job_id, CAST(attempt AS INTEGER) AS attempt, CASE backoff WHEN 'linear' THEN attempt WHEN 'exponential' THEN CAST(pow(2, attempt - 1) AS BIGINT) ELSE 1 END AS wait FROM w)
SELECT job_id, attempt, wait, CAST(sum(wait) OVER (PARTITION BY job_id ORDER BY attempt) AS BIGINT) AS at FROM x"""
)
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("constant"), F.lit("linear"), F.lit("exponential")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return policy.retry_schedule(table(spark, sf, "part").select(F.col("p_partkey").alias("job_id"), (F.col("p_size") % 6 + 1).alias("count"), kind.alias("backoff")))


@query()
def budget_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy admission under a budget, in sequence within each pool; SQL has no form for it."""
    jobs = table(spark, sf, "part").select((F.col("p_partkey") % 20).cast("string").alias("pool"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).cast("int").alias("priority"), F.create_map(F.lit("cpu"), F.col("p_size").cast("double"), F.lit("disk"), F.lit(1.0)).alias("needs"))
    return policy.admitted(jobs, {"cpu": 300.0})


_COPIES = """c AS (SELECT p_brand, p_partkey AS ref, p_size AS size, p_partkey % 2 AS consumers, p_partkey % 5 <> 0 AS in_memory, p_partkey % 3 <> 0 AS on_disk, p_partkey % 7 = 0 AS pinned FROM part)"""


@query(
    f"""WITH {_COPIES}, m AS (SELECT *, sum(size) OVER (PARTITION BY p_brand) AS held FROM c WHERE in_memory),
e AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY p_brand ORDER BY size DESC, ref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM m WHERE consumers = 0 AND on_disk AND NOT pinned)
SELECT p_brand, ref, size FROM e WHERE held - freed > 800"""
)
def evict_largest_first(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    copies = table(spark, sf, "part").select("p_brand", k.alias("ref"), F.col("p_size").alias("size"), (k % 2).alias("consumers"), (k % 5 != 0).alias("in_memory"), (k % 3 != 0).alias("on_disk"), (k % 7 == 0).alias("pinned"))
    return policy.eviction(copies, 800, "p_brand")


_TRACKED = """k AS (SELECT l_orderkey AS ref, ['memory', 'object_store', 'disk'][l_linenumber % 3 + 1] AS kind, CAST(l_quantity AS BIGINT) AS size, l_suppkey % 11 = 0 AS pinned FROM lineitem),
b AS (SELECT ref, max(size) AS size, bool_or(pinned) AS pinned, bool_or(kind = 'memory') AS in_memory, bool_or(kind = 'disk') AS on_disk FROM k GROUP BY ref),
w AS (SELECT o_orderkey AS ref, count(*) FILTER (WHERE o_orderstatus <> 'O') AS consumers FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY o_orderkey),
t AS (SELECT b.*, coalesce(consumers, 0) AS consumers, in_memory AND on_disk AND NOT pinned AND coalesce(consumers, 0) = 0 AS evictable FROM b LEFT JOIN w USING (ref))"""


def _tracked(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("memory"), F.lit("object_store"), F.lit("disk")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    copies = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ref"), kind.alias("kind"), F.floor("l_quantity").cast("long").alias("size"), (F.col("l_suppkey") % 11 == 0).alias("pinned"))
    readers = table(spark, sf, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("ref"), (F.col("o_orderstatus") == "O").alias("done"))
    return policy.tracked(copies, readers)


@query(f"WITH {_TRACKED} SELECT ref, size, pinned, in_memory, on_disk, consumers, evictable FROM t")
def materialization_state(spark: SparkSession, sf: str) -> DataFrame:
    return _tracked(spark, sf)


@query(f"""WITH {_TRACKED} SELECT count(*) FILTER (WHERE in_memory) AS in_memory, CAST(coalesce(sum(size) FILTER (WHERE in_memory), 0) AS BIGINT) AS bytes,
  count(*) FILTER (WHERE evictable) AS evictable, CAST(coalesce(sum(size) FILTER (WHERE evictable), 0) AS BIGINT) AS evictable_bytes FROM t""")
def memory_stats(spark: SparkSession, sf: str) -> DataFrame:
    return policy.memory_stats(_tracked(spark, sf))


@query("WITH k AS (SELECT l_orderkey AS ref, ['memory', 'object_store', 'disk'][l_linenumber % 3 + 1] AS kind, [100, 1000, 200000][l_linenumber % 3 + 1] AS cost FROM lineitem) SELECT ref, arg_min(kind, cost) AS kind, min(cost) AS cost FROM k GROUP BY ref")
def cheapest_copy(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("memory"), F.lit("object_store"), F.lit("disk")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return policy.cheapest_copy(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ref"), kind.alias("kind")))


@query(
    """WITH f AS (SELECT user_id % 40 AS session, event_id, CASE WHEN event_id % 9 <> 0 THEN event_type END AS line FROM events),
w AS (SELECT *, count(*) OVER l AS n, min(line) OVER l AS low, max(line) OVER l AS high FROM f WHERE line IS NOT NULL WINDOW l AS (PARTITION BY session ORDER BY event_id ROWS 2 PRECEDING))
SELECT session, min(event_id) AS event_id, arg_min(line, event_id) AS line FROM w WHERE n = 3 AND low = high GROUP BY session"""
)
def root_cause_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select((F.col("user_id") % 40).alias("session"), "event_id", F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("line"))
    return policy.root_causes(rows, ["session"], ["event_id"], "line")


@query("SELECT id, rule_name, CAST(row_number() OVER (PARTITION BY rule_name ORDER BY id) - 1 AS INTEGER) AS array_index FROM jobs", ("jobs",))
def job_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return policy.array_index(views.jobs(spark, sf).select("id", "rule_name"))


_NODES = """n AS (SELECT ['ALIVE', 'ALIVE', 'DEAD', 'PENDING'][s_suppkey % 4 + 1] AS state, CAST(s_nationkey AS DOUBLE) AS cpu, CASE WHEN s_suppkey % 5 = 0 THEN 2.0::DOUBLE END AS gpu,
  CAST(s_suppkey AS DOUBLE) AS mem, CAST(s_nationkey % 3 AS DOUBLE) AS free FROM supplier)"""


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("double")
    state = F.element_at(F.array(*[F.lit(x) for x in ("ALIVE", "ALIVE", "DEAD", "PENDING")]), (k % 4 + 1).cast("int"))
    held = F.create_map(F.lit("CPU"), n, F.lit("memory"), k.cast("double"))
    total = F.when(k % 5 == 0, F.map_concat(held, F.create_map(F.lit("GPU"), F.lit(2.0)))).otherwise(held)
    return table(spark, sf, "supplier").select(state.alias("state"), total.alias("total"), F.create_map(F.lit("CPU"), (F.col("s_nationkey") % 3).cast("double")).alias("available"))


@query(f"WITH {_NODES} SELECT resource, sum(amount) AS amount FROM (SELECT state, 'CPU' AS resource, cpu AS amount FROM n UNION ALL SELECT state, 'memory', mem FROM n UNION ALL SELECT state, 'GPU', gpu FROM n WHERE gpu IS NOT NULL) WHERE state = 'ALIVE' GROUP BY resource")
def cluster_resources(spark: SparkSession, sf: str) -> DataFrame:
    return policy.resource_totals(_nodes(spark, sf).select("state", F.col("total").alias("resources")))


@query(
    f"""WITH {_NODES}, a AS (SELECT * FROM n WHERE state = 'ALIVE') SELECT (SELECT count(*) FROM a) AS alive_nodes, (SELECT count(*) FROM n WHERE state = 'PENDING') AS pending_nodes,
  (SELECT coalesce(sum(cpu), 0) FROM a) AS total_cpus, (SELECT coalesce(sum(free), 0) FROM a) AS available_cpus, (SELECT coalesce(sum(gpu), 0) FROM a) AS total_gpus, 0.0::DOUBLE AS available_gpus,
  (SELECT coalesce(sum(mem), 0) FROM a) AS total_memory, 0.0::DOUBLE AS available_memory"""
)
def cluster_summary(spark: SparkSession, sf: str) -> DataFrame:
    return policy.cluster_totals(_nodes(spark, sf))


@query("SELECT id, coalesce(priority, 0) AS priority FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS priority FROM part) ORDER BY 2 DESC, 1")
def ready_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("priority"))
    return policy.by_priority(rows).select("id", F.coalesce("priority", F.lit(0)).alias("priority"))


@query("SELECT id FROM jobs WHERE status IN ('pending', 'running') AND id NOT IN (SELECT to_job FROM job_edges JOIN jobs u ON u.id = from_job WHERE u.status NOT IN ('completed', 'skipped'))", ("jobs", "job_edges"))
def resume_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return policy.resumable(views.jobs(spark, sf), views.job_edges(spark, sf)).select("id")


# scalar functions


@query(
    """SELECT p_partkey, s AS text, CASE u WHEN 'K' THEN n * 1000 WHEN 'M' THEN n * 1000000 WHEN 'G' THEN n * 1000000000 WHEN '' THEN n END AS decimal_bytes,
  CASE u WHEN 'K' THEN n * 1024 WHEN 'M' THEN n * 1048576 WHEN 'G' THEN n * 1073741824 WHEN '' THEN n ELSE n END AS lenient_bytes
FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS n, ['K', 'M', 'G', '', 'x'][p_partkey % 5 + 1] AS u, p_size || ['K', 'M', 'G', '', 'x'][p_partkey % 5 + 1] AS s FROM part)"""
)
def parse_sizes(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in ("K", "M", "G", "", "x")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("text"))
    return rows.select("p_partkey", "text", parsing.byte_size(F.col("text")).cast("long").alias("decimal_bytes"), parsing.memory_bytes(F.col("text")).alias("lenient_bytes"))


@query("SELECT p_partkey, n * [1, 60, 3600, 86400, 1, NULL][p_partkey % 6 + 1] AS seconds FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS n FROM part)")
def parse_durations(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in ("s", "m", "h", "d", "", "w")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", parsing.duration_seconds(F.concat(F.col("p_size").cast("string"), unit)).alias("seconds"))


@query(
    r"""SELECT conv_id, turn, list_extract(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), -1) AS last FROM conversations"""
)
def last_nonempty_line(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", parsing.last_line(F.col("text")).alias("last"))


@query(
    """WITH d AS (SELECT o_orderkey, CAST(o_orderkey * o_orderkey % 20000000 AS BIGINT) AS ms FROM orders), e AS (SELECT *, ms // 1000 AS s FROM d)
SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || (s % 60) || 's' ELSE (s // 3600) || 'h' || (s % 3600 // 60) || 'm' || (s % 60) || 's' END AS elapsed,
  CASE WHEN ms < 1000 THEN ms || 'ms' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || (s % 60) || 's' ELSE (s // 3600) || 'h' || (s % 3600 // 60) || 'm' END AS span,
  CASE WHEN ms < 1000 THEN CASE WHEN (ms + 50) // 100 = 0 THEN '<0.1s' WHEN (ms + 50) // 100 >= 10 THEN '1s' ELSE '0.' || ((ms + 50) // 100) || 's' END WHEN s < 60 THEN s || 's'
    WHEN s < 3600 THEN (s // 60) || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE (s // 3600) || 'h' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' END AS duration,
  format('{:,}', ms) AS counted FROM e"""
)
def fmt_duration(spark: SparkSession, sf: str) -> DataFrame:
    ms = (F.col("o_orderkey") * F.col("o_orderkey") % 20000000).cast("long")
    rows = table(spark, sf, "orders").select("o_orderkey", ms.alias("ms"))
    m = F.col("ms")
    return rows.select("o_orderkey", parsing.format_elapsed(F.floor(m / 1000).cast("long")).alias("elapsed"), parsing.format_span(m).alias("span"), parsing.format_duration(m).alias("duration"), parsing.format_count(m).alias("counted"))


@query("SELECT id, strftime(to_timestamp(started_at) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS started, json_extract_string(wildcards, '$.customer') AS customer, CASE WHEN wildcards IS NULL THEN rule_name ELSE rule_name || ' (customer=' || json_extract_string(wildcards, '$.customer') || ')' END AS label FROM jobs", ("jobs",))
def job_labels(spark: SparkSession, sf: str) -> DataFrame:
    w = parsing.json_map(F.col("wildcards"))
    return views.jobs(spark, sf).select("id", parsing.iso8601(F.col("started_at")).alias("started"), F.try_element_at(w, F.lit("customer")).alias("customer"), parsing.job_label(F.col("rule_name"), w).alias("label"))


@query(
    """SELECT p_partkey, ['queued', 'running', 'completed', 'failed', 'cancelled', 'running'][p_partkey % 6 + 1] AS status, CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE p_size END AS exit_code,
  CAST(p_size AS BIGINT) * [1024, 1048576, 1073741824, 1][p_partkey % 4 + 1] AS rss, CAST(p_size * 3600 + 62 AS BIGINT) AS elapsed, CAST(p_partkey AS BIGINT) AS parent, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) END AS task FROM part"""
)
def batch_fields(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    state = F.element_at(F.array(*[F.lit(x) for x in ("PENDING", "STAGE_OUT", "COMPLETED", "TIMEOUT", "PREEMPTED", "odd")]), (k % 6 + 1).cast("int"))
    unit = F.element_at(F.array(*[F.lit(x) for x in ("K", "M", "G", "")]), (k % 4 + 1).cast("int"))
    task = parsing.array_task(F.concat(k.cast("string"), F.when(k % 2 == 0, F.concat(F.lit("_"), size)).otherwise("")))
    code = F.when(k % 4 == 0, "x:0").otherwise(F.concat(size, F.lit(":0")))
    rows = table(spark, sf, "part").select("p_partkey", parsing.batch_status(state).alias("status"), parsing.batch_exit_code(code).alias("exit_code"), parsing.max_rss(F.concat(size, unit)).alias("rss"), parsing.batch_elapsed(F.concat(size, F.lit(":01:02"))).alias("elapsed"), task.alias("t"))
    return rows.select("p_partkey", "status", "exit_code", "rss", "elapsed", "t.parent", "t.task")


@query("SELECT rule_name, CAST(count(*) FILTER (WHERE cached = 1) AS BIGINT) AS cached, count(*) AS total, count(*) FILTER (WHERE cached = 0) AS to_run FROM jobs GROUP BY rule_name", ("jobs",))
def dry_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return views.jobs(spark, sf).groupBy("rule_name").agg(F.count_if(F.col("cached") == 1).alias("cached"), F.count("*").alias("total"), F.count_if(F.col("cached") == 0).alias("to_run"))


@query("SELECT status, count(*) AS jobs, count(*) FILTER (WHERE log_path IS NOT NULL) AS with_logs FROM jobs GROUP BY status", ("jobs",))
def jobs_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return views.jobs(spark, sf).groupBy("status").agg(F.count("*").alias("jobs"), F.count("log_path").alias("with_logs"))


