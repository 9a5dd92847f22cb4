"""Graph queries over the derived edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import graph, ledger
from loomwright.plans import views
from loomwright.plans.registry import query
from loomwright.session import table


def _seed(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id long")


_UP = "c AS (SELECT from_job AS id FROM job_edges WHERE to_job = {0} UNION SELECT e.from_job FROM job_edges e JOIN c ON e.to_job = c.id)"
_DOWN = "d AS (SELECT to_job AS id FROM job_edges WHERE from_job = {0} UNION SELECT e.to_job FROM job_edges e JOIN d ON e.from_job = d.id)"


@query(f"WITH {_UP.format(150)} SELECT id FROM c", ("job_edges",), recursive=True)
def graph_deps(spark: SparkSession, sf: str) -> DataFrame:
    return graph.deps(spark, views.job_edges(spark, sf), _seed(spark, 150)).select("id")


@query(f"WITH {_DOWN.format(3)} SELECT id FROM d", ("job_edges",), recursive=True)
def graph_rdeps(spark: SparkSession, sf: str) -> DataFrame:
    return graph.rdeps(spark, views.job_edges(spark, sf), _seed(spark, 3)).select("id")


@query(f"WITH {_UP.format(150)}, {_DOWN.format(3)} SELECT id FROM (SELECT id FROM c UNION SELECT 150) INTERSECT SELECT id FROM (SELECT id FROM d UNION SELECT 3)", ("job_edges",), recursive=True)
def graph_allpaths(spark: SparkSession, sf: str) -> DataFrame:
    return graph.all_paths(spark, views.job_edges(spark, sf), _seed(spark, 3), _seed(spark, 150))


@query(
    """WITH c AS (SELECT from_job AS id, 1 AS depth FROM job_edges WHERE to_job = 1500 UNION SELECT e.from_job, depth + 1 FROM job_edges e JOIN c ON e.to_job = c.id)
SELECT id, min(depth) AS depth FROM c GROUP BY id""",
    ("job_edges",),
    recursive=True,
)
def graph_explain(spark: SparkSession, sf: str) -> DataFrame:
    """What a target needs, nearest first."""
    return graph.deps(spark, views.job_edges(spark, sf), _seed(spark, 1500)).orderBy("depth", "id")


_LEVELS = """l AS (SELECT id, 0 AS level FROM job_nodes WHERE id NOT IN (SELECT to_job FROM job_edges)
  UNION SELECT e.to_job, level + 1 FROM l JOIN job_edges e ON e.from_job = l.id), m AS (SELECT id, max(level) AS level FROM l GROUP BY id)"""


@query(f"WITH {_LEVELS} SELECT id, level FROM m", ("job_edges", "job_nodes"), recursive=True)
def graph_levels(spark: SparkSession, sf: str) -> DataFrame:
    return graph.levels(spark, views.job_nodes(spark, sf), views.job_edges(spark, sf))


@query(
    f"""WITH {_LEVELS}, p AS (SELECT e.to_job AS id, min(e.from_job) AS previous FROM job_edges e JOIN m a ON a.id = e.from_job JOIN m b ON b.id = e.to_job WHERE a.level = b.level - 1 GROUP BY e.to_job),
s AS (SELECT level AS position, id FROM (SELECT * FROM m ORDER BY level DESC, id LIMIT 1) UNION SELECT position - 1, previous FROM s JOIN p USING (id))
SELECT position, id FROM s""",
    ("job_edges", "job_nodes"),
    recursive=True,
)
def graph_critical_path(spark: SparkSession, sf: str) -> DataFrame:
    return graph.critical_path(spark, views.job_nodes(spark, sf), views.job_edges(spark, sf))


@query(
    """SELECT id, rule_name FROM jobs WHERE status = 'pending' AND id NOT IN
  (SELECT e.to_job FROM job_edges e JOIN jobs u ON u.id = e.from_job WHERE u.status NOT IN ('completed', 'skipped'))""",
    ("jobs", "job_edges"),
)
def graph_ready(spark: SparkSession, sf: str) -> DataFrame:
    return graph.ready(views.jobs(spark, sf), views.job_edges(spark, sf), ledger.SATISFIED).select("id", "rule_name")


@query(
    """WITH w AS (SELECT from_job, to_job FROM job_edges WHERE from_job % 5 <> 0
  UNION SELECT w.from_job, e.to_job FROM w JOIN job_edges e ON e.from_job = w.to_job WHERE w.to_job % 5 = 0)
SELECT from_job, to_job FROM w WHERE to_job % 5 <> 0""",
    ("job_edges",),
    recursive=True,
)
def graph_skipped_bridge(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bridged(spark, views.job_edges(spark, sf), views.job_nodes(spark, sf).where("id % 5 = 0"))


@query(
    "WITH n AS (SELECT id FROM job_nodes UNION SELECT id FROM jobs) SELECT id FROM n WHERE id NOT IN (SELECT from_job FROM job_edges UNION SELECT to_job FROM job_edges)",
    ("job_edges", "job_nodes", "jobs"),
)
def graph_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Over all edges, with the ids of orders as further nodes, as every part has an edge."""
    nodes = views.job_nodes(spark, sf).unionByName(views.jobs(spark, sf).select("id")).distinct()
    return graph.orphans(nodes, views.job_edges(spark, sf))


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("rule"), F.concat(F.lit("out/"), (F.col("p_partkey") % 1000).cast("string")).alias("ref"))


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("rule"), F.concat(F.lit("out/"), (F.col("p_partkey") * 3).cast("string")).alias("ref"))


_IO = "o AS (SELECT p_partkey AS rule, 'out/' || (p_partkey % 1000) AS ref FROM part), i AS (SELECT p_partkey AS rule, 'out/' || (p_partkey * 3) AS ref FROM part)"


@query(f"WITH {_IO} SELECT rule, ref FROM o WHERE ref NOT IN (SELECT ref FROM i)")
def graph_shadow_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.shadows(_outputs(spark, sf), _inputs(spark, sf))


@query(f"WITH {_IO} SELECT ref, count(DISTINCT rule) AS producers FROM o GROUP BY ref HAVING count(DISTINCT rule) > 1")
def graph_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.conflicts(_outputs(spark, sf))


@query(f"WITH {_IO} SELECT DISTINCT rule, ref FROM o JOIN i USING (rule, ref)")
def graph_self_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return graph.self_overlaps(_outputs(spark, sf), _inputs(spark, sf))


@query(f"WITH {_IO} SELECT DISTINCT o.rule AS from_job, i.rule AS to_job FROM o JOIN i USING (ref) WHERE o.rule <> i.rule")
def graph_build_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.linked(_outputs(spark, sf), _inputs(spark, sf))


@query(f"WITH {_IO} SELECT DISTINCT ref FROM i WHERE ref NOT IN (SELECT ref FROM o)")
def graph_sources(spark: SparkSession, sf: str) -> DataFrame:
    return graph.sources(_outputs(spark, sf), _inputs(spark, sf))


#: Nodes on a cycle (they reach themselves), and those that one cycle leads to and that lead to one.
_CYCLES = """p AS (SELECT from_job AS f, to_job AS t FROM {0} UNION SELECT p.f, e.to_job FROM p JOIN {0} e ON e.from_job = p.t), c AS (SELECT DISTINCT f AS id FROM p WHERE f = t),
x AS (SELECT id FROM c UNION SELECT a.t FROM p a JOIN c ON c.id = a.f WHERE a.t IN (SELECT b.f FROM p b JOIN c ON c.id = b.t))"""


@query(f"WITH {_CYCLES.format('job_edges')} SELECT id FROM x", ("job_edges",), recursive=True)
def graph_cycle_check(spark: SparkSession, sf: str) -> DataFrame:
    return graph.in_cycles(spark, views.job_edges(spark, sf))


def _ring_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers in rings of ten, some rings open, with lines that lead into, out of and between them."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(k)
    ring = s.where("s_suppkey % 10 <> 9 or s_suppkey % 3 <> 0").select(k.alias("from_job"), (k - k % 10 + (k + 1) % 10).alias("to_job"))
    lines = s.where("s_suppkey % 10 = 4").select(k.alias("from_job"), (k + 13).alias("to_job"))
    return ring.unionByName(lines)


_RINGS = """r AS (SELECT s_suppkey AS from_job, s_suppkey - s_suppkey % 10 + (s_suppkey + 1) % 10 AS to_job FROM supplier WHERE s_suppkey % 10 <> 9 OR s_suppkey % 3 <> 0
  UNION ALL SELECT s_suppkey, s_suppkey + 13 FROM supplier WHERE s_suppkey % 10 = 4)"""


@query(f"WITH {_RINGS}, {_CYCLES.format('r')} SELECT id FROM x", recursive=True)
def graph_cycle_rings(spark: SparkSession, sf: str) -> DataFrame:
    return graph.in_cycles(spark, _ring_edges(spark, sf))


@query(
    """WITH e AS (SELECT n_regionkey * 100 AS f, n_nationkey AS t FROM nation UNION SELECT n_nationkey, n_regionkey * 100 FROM nation WHERE n_nationkey % 2 = 0),
p AS (SELECT f, t FROM e UNION SELECT p.f, e.t FROM p JOIN e ON e.f = p.t) SELECT DISTINCT f AS id FROM p WHERE f = t""",
    recursive=True,
)
def graph_cycle_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    there = n.select((F.col("n_regionkey") * 100).cast("int").alias("from_job"), F.col("n_nationkey").alias("to_job"))
    back = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("from_job"), (F.col("n_regionkey") * 100).cast("int").alias("to_job"))
    return graph.in_cycles(spark, there.unionByName(back))


@query("SELECT (SELECT count(*) FROM job_nodes) AS nodes, (SELECT count(*) FROM job_edges) AS edges", ("job_nodes", "job_edges"))
def graph_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return graph.metrics(views.job_nodes(spark, sf), views.job_edges(spark, sf))


@query("SELECT 'digraph {' || chr(10) || string_agg('  \"' || n_regionkey || '\" -> \"' || n_nationkey || '\";', chr(10) ORDER BY n_regionkey, n_nationkey) || chr(10) || '}' AS text FROM nation")
def graph_render_dot(spark: SparkSession, sf: str) -> DataFrame:
    return graph.rendered(table(spark, sf, "nation").select(F.col("n_regionkey").alias("from_job"), F.col("n_nationkey").alias("to_job")))


_GATES = """g AS (SELECT 'gate-' || n_nationkey AS gate, ['pending', 'approved', 'rejected'][n_nationkey % 3 + 1] AS status FROM nation WHERE n_nationkey < 20),
b AS (SELECT o_orderkey AS id, 'gate-' || (o_custkey % 25) AS gate FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'gate-' || (o_orderkey % 4) FROM orders)"""


@query(f"WITH {_GATES} SELECT b.id, list_sort(list(DISTINCT b.gate)) AS gates FROM b JOIN jobs j ON j.id = b.id AND j.status = 'pending' WHERE b.gate NOT IN (SELECT gate FROM g WHERE status = 'approved') GROUP BY b.id", ("jobs",))
def graph_gate_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Pending jobs behind gates that aren't approved; gates 20 to 24 aren't known."""
    k, n, o = F.col("o_orderkey"), F.col("n_nationkey"), table(spark, sf, "orders")
    status = F.element_at(F.array(F.lit("pending"), F.lit("approved"), F.lit("rejected")), (n % 3 + 1).cast("int"))
    gates = table(spark, sf, "nation").where("n_nationkey < 20").select(F.concat(F.lit("gate-"), n.cast("string")).alias("gate"), status.alias("status"))
    blocks = o.where("o_orderkey % 2 = 0").select(F.concat(F.lit("gate-"), (F.col("o_custkey") % 25).cast("string")).alias("gate"), k.alias("id"))
    return graph.gated(views.jobs(spark, sf), gates, blocks.unionByName(o.select(F.concat(F.lit("gate-"), (k % 4).cast("string")).alias("gate"), k.alias("id"))))


@query(f"WITH {_IO}, l AS (SELECT DISTINCT o.rule AS f, i.rule AS t FROM o JOIN i USING (ref) WHERE o.rule <> i.rule), d AS (SELECT t AS id FROM l WHERE f = 9 UNION SELECT l.t FROM l JOIN d ON l.f = d.id) SELECT id FROM d UNION SELECT 9", recursive=True)
def invalidate_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The rules that an invalidation of rule 9 forgets, by equal pattern texts."""
    return graph.invalidate_cascade(spark, _outputs(spark, sf), _inputs(spark, sf), _seed(spark, 9))


@query("SELECT (SELECT count(*) FROM job_nodes) AS nodes, (SELECT count(*) FROM job_edges) AS edges, (SELECT count(*) FROM job_nodes WHERE id NOT IN (SELECT to_job FROM job_edges)) AS roots, (SELECT count(*) FROM job_nodes WHERE id NOT IN (SELECT from_job FROM job_edges)) AS leaves", ("job_nodes", "job_edges"))
def graph_report(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = views.job_nodes(spark, sf), views.job_edges(spark, sf)
    ends = [nodes.join(edges.select(F.col(side).alias("id")), "id", "left_anti").agg(F.count("*").alias(name)) for side, name in (("to_job", "roots"), ("from_job", "leaves"))]
    out = graph.metrics(nodes, edges)
    for one in ends:
        out = out.withColumn("_k", F.lit(0)).join(F.broadcast(one.withColumn("_k", F.lit(0))), "_k").drop("_k")
    return out


_UNTIL = f"WITH {_UP.format(150)}"


@query(f"{_UNTIL} SELECT id FROM job_nodes WHERE id IN (SELECT id FROM c) OR id = 150", ("job_edges", "job_nodes"), recursive=True)
def select_until(spark: SparkSession, sf: str) -> DataFrame:
    seed = _seed(spark, 150)
    return views.job_nodes(spark, sf).join(graph.with_seeds(graph.deps(spark, views.job_edges(spark, sf), seed), seed), "id", "left_semi")


@query(f"WITH {_DOWN.format(3)} SELECT id FROM job_nodes WHERE id NOT IN (SELECT id FROM d) AND id <> 3", ("job_edges", "job_nodes"), recursive=True)
def select_omit_from(spark: SparkSession, sf: str) -> DataFrame:
    seed = _seed(spark, 3)
    return views.job_nodes(spark, sf).join(graph.with_seeds(graph.rdeps(spark, views.job_edges(spark, sf), seed), seed), "id", "left_anti")


@query(
    """WITH d AS (SELECT id FROM job_nodes WHERE id % 17 = 4 UNION SELECT e.to_job FROM job_edges e JOIN d ON e.from_job = d.id)
SELECT id FROM job_nodes WHERE id % 3 = 0 AND id NOT IN (SELECT id FROM d)""",
    ("job_edges", "job_nodes"),
    recursive=True,
)
def forcerun_set(spark: SparkSession, sf: str) -> DataFrame:
    """The skip set (ids divisible by 3) without the forced jobs and what is downstream of them."""
    nodes, edges = views.job_nodes(spark, sf), views.job_edges(spark, sf)
    forced = nodes.where("id % 17 = 4")
    return nodes.where("id % 3 = 0").join(graph.with_seeds(graph.rdeps(spark, edges, forced), forced), "id", "left_anti")


@query(f"WITH {_DOWN.format(11)} SELECT id FROM d UNION SELECT 11", ("job_edges",), recursive=True)
def cancel_cascade(spark: SparkSession, sf: str) -> DataFrame:
    seed = _seed(spark, 11)
    return graph.with_seeds(graph.rdeps(spark, views.job_edges(spark, sf), seed), seed)


@query(
    """WITH c AS (SELECT conv_id, from_turn AS root, to_turn AS turn FROM chain_edges WHERE from_turn = 0 UNION SELECT c.conv_id, root, e.to_turn FROM c JOIN chain_edges e ON e.conv_id = c.conv_id AND e.from_turn = c.turn)
SELECT conv_id, count(*) AS reached FROM c GROUP BY conv_id""",
    ("chain_edges",),
    recursive=True,
)
def graph_chain_reach(spark: SparkSession, sf: str) -> DataFrame:
    e = views.chain_edges(spark, sf)
    key = F.col("conv_id") * 1000
    edges = e.select((key + F.col("from_turn")).alias("from_job"), (key + F.col("to_turn")).alias("to_job"))
    found = graph.closure(spark, edges, e.where("from_turn = 0").select(key.alias("id")))
    return found.groupBy(F.expr("id div 1000").alias("conv_id")).agg(F.count("*").alias("reached"))
