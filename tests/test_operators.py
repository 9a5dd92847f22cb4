import random
import time

import pytest
from pyspark.sql import functions as F

from loomwright.operators import cache, expand, graph, ledger, policy, snapshot, workloads


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_admission_is_greedy_and_passes_over(spark):
    rng = random.Random(2)
    rows = [(rng.choice("pq"), k, rng.choice([None, 0, 1, 2]), {"cpu": float(rng.randrange(1, 6)), "other": 99.0} if k % 5 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "pool string, id long, priority int, needs map<string,double>")
    want = []
    for pool in "pq":
        left = 20.0
        for _, k, _, needs in sorted((r for r in rows if r[0] == pool), key=lambda r: (-(r[2] or 0), r[1])):
            need = (needs or {}).get("cpu", 0.0)
            fits = need <= left
            left -= need if fits else 0
            want.append((pool, k, fits))
    assert rows_of(policy.admitted(df, {"cpu": 20.0})) == sorted(want, key=str)


def test_products_and_zips(spark):
    assert [(r.a, r.b) for r in expand.product(spark, {"a": ["1", "2"], "b": ["x", "y"]}).orderBy("n").collect()] == [("1", "x"), ("1", "y"), ("2", "x"), ("2", "y")]
    assert expand.product(spark, {"a": [], "b": ["x"]}).count() == 0 and expand.product(spark, {}).count() == 1
    assert [(r.a, r.b) for r in expand.zipped(spark, {"a": ["1", "2"], "b": ["x", "y"]}).orderBy("n").collect()] == [("1", "x"), ("2", "y")]
    assert expand.zipped(spark, {"a": [], "b": []}).count() == 1
    with pytest.raises(expand.ExpandError):
        expand.zipped(spark, {"a": ["1"], "b": []})
    assert expand.expand_target(spark, "x/{q}", {}).count() == 0
    with pytest.raises(expand.ExpandError):
        expand.expand_target(spark, "x/{q}", {"q": ["a1"]}, constraints={"q": "[a-z]+"})


def test_chain_over_tables(spark):
    rules = [expand.RuleSpec("a", ["b", "c"], ["a"]), expand.RuleSpec("b", ["c"], ["b"]), expand.RuleSpec("c", [], ["c"], when={"op": "eq", "field": "x", "value": "1"})]
    target = spark.createDataFrame([("a",)], "path string")
    with pytest.raises(expand.ExpandError, match="guard"):
        expand.chain(spark, rules, {}, target)
    rules[2].when = None
    jobs, _, _ = expand.chain(spark, rules, {}, target)
    assert rows_of(jobs.select("job_id", "level")) == [("a", 0), ("b", 1), ("c", 2)]
    rules[2].inputs = ["a"]
    with pytest.raises(graph.CycleError):
        expand.chain(spark, rules, {}, target)


def both_ways(monkeypatch, run):
    """What a graph query gives on the driver and level by level."""
    local = run()
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    monkeypatch.setattr(graph, "COMPACT", 2)
    return local, run()


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_queries_are_the_same_on_tables(spark, monkeypatch, seed):
    rng = random.Random(seed)
    links = sorted({(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a < b})
    edges, nodes = spark.createDataFrame(links, "from_job long, to_job long"), spark.createDataFrame([(i,) for i in range(42)], "id long")
    seeds = spark.createDataFrame([(0,), (3,), (99,)], "id long")
    ring = spark.createDataFrame([*links, (30, 31), (31, 30), (38, 2)], "from_job long, to_job long")

    def run():
        return [rows_of(graph.closure(spark, edges, seeds).select("id", "depth")), rows_of(graph.levels(spark, nodes, edges).select("id", "level")), rows_of(graph.critical_path(spark, nodes, edges).select("position", "id")), rows_of(graph.in_cycles(spark, ring)), rows_of(graph.in_cycles(spark, edges))]

    local, spread = both_ways(monkeypatch, run)
    assert local == spread and local[2] and local[3] and not local[4]


def test_long_chains_and_cycles_end_at_once(spark, monkeypatch):
    chain = spark.createDataFrame([(k, k + 1) for k in range(5000)], "from_job long, to_job long")
    nodes = spark.range(5001)
    began = time.time()
    assert graph.levels(spark, nodes, chain).agg(F.max("level")).first()[0] == 5000
    assert graph.critical_path(spark, nodes, chain).count() == 5001 and time.time() - began < 30
    reached = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1)], "from_job long, to_job long")

    def run():
        with pytest.raises(graph.CycleError):
            graph.levels(spark, spark.range(4), reached)
        return True

    assert both_ways(monkeypatch, run) == (True, True)


def test_paths_double_on_tables(spark, monkeypatch):
    links = [(k, k + 1) for k in range(11)]
    edges = spark.createDataFrame(links, "from_job long, to_job long")
    local, spread = both_ways(monkeypatch, lambda: rows_of(graph.critical_path(spark, spark.range(12), edges).select("position", "id")))
    assert sorted(local) == sorted(spread) == [(k, k) for k in range(12)]


def test_framing_keeps_fields_apart(spark):
    rows = [({"ab": "c"},), ({"a": "bc"},), ({},), (None,)]
    hashes = [r[0] for r in spark.createDataFrame(rows, "m map<string,string>").select(cache.map_hash(F.col("m"))).collect()]
    assert len(set(hashes)) == 4 and hashes[3] is None
    assert spark.range(1).select(cache.framed("t", F.lit(""))).first()[0] == cache.framed_text("t", "") != cache.framed_text("t", None)


def test_root_cause_ignores_failures_without_a_line(spark):
    rows = [(1, "a"), (2, "x"), (3, None), (4, "x"), (5, "x"), (6, "x")]
    df = spark.createDataFrame([("s", *r) for r in rows], "s string, n int, line string")
    assert rows_of(policy.root_causes(df, ["s"], ["n"], "line")) == [("s", 5, "x")]


def test_transitions_are_guarded(spark):
    events = [("j", 1, "complete", "a"), ("j", 2, "claim", "a"), ("j", 3, "claim", "b"), ("j", 4, "complete", "b"), ("j", 5, "complete", "a"), ("j", 6, "cancel", "a"), ("k", 1, "skip", None), ("k", 2, "claim", "a")]
    df = spark.createDataFrame(events, "job_id string, seq int, event string, owner string")
    assert rows_of(ledger.status_fold(df)) == [("j", "completed", "a", 4), ("k", "skipped", None, 1)]


def test_snapshots_with_nulls(spark):
    schema = "job_id string, status string, output_hashes string"
    a = spark.createDataFrame([("1", "ok", None), ("2", "ok", "h"), ("3", "ok", "h")], schema)
    b = spark.createDataFrame([("1", "ok", None), ("2", "ok", None), ("4", "ok", "h")], schema)
    assert {r.job_id: r.change for r in snapshot.diff(a, b).collect()} == {"1": "unchanged", "2": "changed", "3": "removed", "4": "added"}
    assert snapshot.header_drift({"workflow_hash": "a", "os": "x", "arch": "y"}, {"workflow_hash": "b", "os": "x", "arch": "z"}) == [("workflow_changed", "a"), ("platform_changed", "x/y")]


def test_quirks_of_the_workflows(spark):
    rows = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate([5, 7, 4, 9])], "s string, k int, v double")
    assert [r.variance for r in workloads.rolling_variance(rows, ["s"], ["k"], "v", 3).orderBy("k").collect()] == [round(((5**2 + 2**2 + 3**2) - (5 + 2 - 3) ** 2 / 3) / 2, 6), round(((2**2 + 3**2 + 5**2) - (2 - 3 + 5) ** 2 / 3) / 2, 6)]
    assert [r.k for r in workloads.mean_scaled(rows, "s", ["k"], "v").orderBy("k").collect()] == [1, 2, 3]
    assert [r.trend for r in workloads.rolling_trend(rows, ["s"], ["k"], "v", 2).orderBy("k").collect()] == [1.0, -1.5, 2.5]


def test_stateless_times(spark):
    o = spark.createDataFrame([("a", 5), ("b", 5), ("c", None), ("d", 4)], "job_id string, mtime long")
    i = spark.createDataFrame([("a", 4), ("b", 5), ("c", 1)], "job_id string, mtime long")
    assert rows_of(cache.fresh_by_time(o, i)) == [("a", True), ("b", False), ("c", False), ("d", True)]
