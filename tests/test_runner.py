import os
import time

import pytest

from loomwright.plans.runner import RunError, Session
from loomwright.sources import workflow

FLOW = """
include = ["more.toml"]
[config]
samples = { source = "units.tsv", key = "sample", columns = ["unit"] }
out = "results"
[rule.all]
input = ["{config.out}/summary.parquet"]
[rule.clean]
input = { raw = "data/{sample}.csv" }
output = ["{config.out}/{sample}.parquet"]
wildcard_constraints = { sample = "[a-c]" }
params = { least = 1 }
sql = "SELECT '{wildcards.sample}' AS sample, key, CAST(value AS INT) AS value FROM {raw} WHERE CAST(value AS INT) > {params.least}"
"""
MORE = """
[rule.summary]
input = ["{config.out}/{sample}.parquet"]
output = ["{config.out}/summary.parquet"]
"""


def summary(inputs, params, wildcards):
    return inputs["input"].groupBy("sample").sum("value").toDF("sample", "total")


@pytest.fixture
def root(tmp_path):
    (tmp_path / "flow.toml").write_text(FLOW.replace("{raw}", "{raw}"))
    (tmp_path / "more.toml").write_text(MORE)
    (tmp_path / "units.tsv").write_text("sample\tunit\na\t1\na\t2\n\nb\t1\nc\t\n")
    (tmp_path / "data").mkdir()
    for k, s in enumerate("abc"):
        (tmp_path / f"data/{s}.csv").write_text(f"key,value\nx,{k + 1}\ny,{k + 5}\n")
    return str(tmp_path)


def session(spark, root):
    return Session.builder(f"{root}/flow.toml").build(spark)


def test_dimensions(root):
    flow = workflow.read_workflow(f"{root}/flow.toml")
    assert flow.config == {"sample": ["a", "b", "c"], "unit": ["1", "2"], "out": "results"} or flow.config["samples"] == ["a", "b", "c"]
    assert [r.name for r in flow.rules] == ["all", "clean", "summary"]
    assert workflow.with_overrides(flow, {"out": "x", "samples": "q"}).config["out"] == "x"


def test_incremental_runs(spark, root):
    s = session(spark, root)
    plan = s.plan().collect()
    assert [(r.job_id, r.action) for r in plan] == [("clean-a", "run"), ("clean-b", "run"), ("clean-c", "run"), ("summary", "run")]
    first = s.run({"summary": summary})
    assert first.ok and sorted(first.executed) == ["clean-a", "clean-b", "clean-c", "summary"]
    assert sorted((r.sample, r.total) for r in spark.read.parquet(f"{root}/results/summary.parquet").collect()) == [("a", 5), ("b", 8), ("c", 10)]
    again = session(spark, root).run({"summary": summary})
    assert again.executed == [] and len(again.cached) == 4
    for name in "abc":  # other times, same content
        os.utime(f"{root}/data/{name}.csv", (time.time() + 50, time.time() + 50))
    assert session(spark, root).run({"summary": summary}).executed == []
    with open(f"{root}/data/b.csv", "a") as file:
        file.write("z,100\n")
    assert {r.job_id: r.reason for r in session(spark, root).plan().where("action = 'run'").collect()} == {"clean-b": "never ran with these inputs", "summary": "never ran with these inputs"}
    assert sorted(session(spark, root).run({"summary": summary}).executed) == ["clean-b", "summary"]
    assert session(spark, root).run({"summary": summary}, force=["clean"]).executed != []
    assert session(spark, root).history().select("run_id").distinct().count() == 5


def test_queries(spark, root):
    s = session(spark, root)
    assert {r.id for r in s.query("deps(summary)").collect()} == {"clean-a", "clean-b", "clean-c"}
    assert {r.id for r in s.query("rdeps(results/a.parquet)").collect()} == {"summary"}
    assert {r.id for r in s.query("allpaths(clean-a, summary)").collect()} == {"clean-a", "summary"}
    with pytest.raises(RunError):
        s.query("deps(clean)")
    with pytest.raises(RunError):
        s.query("upstream(summary)")


def test_failures(spark, root):
    calls = []

    def broken(inputs, params, wildcards):
        calls.append(1)
        raise ValueError("line one\n  the reason  \n")

    s = session(spark, root)
    rule = s.workflow.rule("summary")
    rule.retries, rule.backoff = 3, "exponential"
    waits = []
    result = s.run({"summary": broken}, sleep=waits.append)
    assert result.failed == ["summary"] and waits == [1, 2] and len(calls) == 3
    row = s.history().where("job_id = 'summary'").first()
    assert (row.status, row.error, row.attempt) == ("failed", "the reason", 3)
    with pytest.raises(RunError):
        session(spark, root).run()
    rule.on_error, rule.retries = "ignore", 1
    assert s.run({"summary": broken}).ok


def test_driver_and_tables_agree(spark):
    from loomwright.operators import cache, expand

    rules = [
        expand.RuleSpec("all", ["r/{a}.txt"], ["done"]),
        expand.RuleSpec("r", ["p/{a}-{b}.txt", "fixed"], ["r/{a}.txt"]),
        expand.RuleSpec("p", ["raw/{b}"], ["p/{a}-{b}.txt"], constraints={"b": "[0-9]+"}),
        expand.RuleSpec("p_low", ["raw/{b}"], ["p/{a}-{b}.txt"], priority=-1),
    ]
    config = {"a": ["x", "y-z"], "bs": ["1", "2"]}
    there = {"raw/1", "raw/2", "fixed"}
    jobs, sources = expand.chain_local(rules, config, ["done"], there)
    frame = spark.createDataFrame([(p,) for p in there], "path string")
    both = [way(spark, rules, config, spark.createDataFrame([("done",)], "path string"), frame) for way in (expand.chain, expand.chain_spread)]
    for tables, needs, found in both:
        assert {(r.job_id, r.rule, r.level) for r in tables.collect()} == {(j.id, j.rule, j.level) for j in jobs.values()}
        assert {(r.job_id, r.place, r.path) for r in needs.collect()} == {(j.id, n, p) for j in jobs.values() for n, p in j.inputs}
        assert {r.path for r in found.collect()} == sources == there
    assert sorted(map(str, both[0][1].collect())) == sorted(map(str, both[1][1].collect()))
    spec = [("j", "sql:é", "p", None, None, "spark"), ("k", "x", None, "", None, "spark"), ("l", "x", None, None, None, "spark")]
    inputs = [("j", "b", "2"), ("j", "a", "1"), ("k", "a", None)]
    keys = cache.cache_keys(spark.createDataFrame(spec, "job_id string, source string, params string, env string, shell string, platform string"), spark.createDataFrame(inputs, "job_id string, path string, hash string"))
    assert {r.job_id: r.cache_key for r in keys.collect()} == {s[0]: cache.cache_key_of(s[1], [(p, h) for i, p, h in inputs if i == s[0]], *s[2:]) for s in spec}


@pytest.mark.parametrize(("rules", "targets", "message"), [
    ([("a", ["b"], ["a"]), ("b", ["a"], ["b"])], ["a"], "cycle"),
    ([("a", ["b"], ["a"])], ["a"], "no producer"),
    ([("a", [], ["{x}"]), ("b", [], ["{y}"])], ["q"], "ambiguous"),
    ([("a", ["{q}"], ["a"])], ["a"], "no values"),
])
def test_errors(rules, targets, message):
    from loomwright.operators import expand

    with pytest.raises(expand.ExpandError, match=message):
        expand.chain_local([expand.RuleSpec(*r) for r in rules], {}, targets, set())


TWO = """
[config]
least = "0"
[rule.all]
input = ["out/low.parquet", "out/high.parquet"]
[rule.split]
input = { raw = "raw.csv" }
output = { low = "out/low.parquet", high = "out/high.parquet" }
call = "split"
[rule.note]
output = ["note.txt"]
shell = "echo {params.word} {config.least} > {output}"
params = { word = "hello" }
benchmark = "bench/note.tsv"
[rule.inline]
input = { raw = "raw.csv" }
output = { out = "inline.json" }
run = "import json; json.dump({'lines': len(open(input.raw).readlines()), 'k': params.k, 'w': str(output)}, open(output.out, 'w'))"
params = { k = "v" }
[rule.slow]
output = ["slow.txt"]
shell = "sleep 30; touch slow.txt"
timeout = "1s"
[rule.bad]
output = ["bad.txt"]
shell = "echo why >&2; exit 3"
[rule.after]
input = ["bad.txt"]
output = ["after.txt"]
shell = "cp {input} {output}"
[rule.scripted]
output = ["scripted.txt"]
script = "make.sh"
[gate.ok]
after = ["split"]
before = ["note"]
"""


@pytest.fixture
def two(tmp_path):
    (tmp_path / "flow.toml").write_text(TWO)
    (tmp_path / "raw.csv").write_text("k,v\na,1\nb,5\nc,9\n")
    (tmp_path / "make.sh").write_text("echo made > $1\n")
    return str(tmp_path)


def split(inputs, params, wildcards):
    raw = inputs["raw"]
    return {"low": raw.where("int(v) < 5"), "high": raw.where("int(v) >= 5")}


def build(spark, root, *targets, **settings):
    builder = Session.builder(f"{root}/flow.toml").targets(list(targets))
    for k, v in settings.items():
        builder.config_override(k, v)
    return builder.build(spark)


def test_outputs_get_their_own_frames_and_code_counts(spark, two):
    assert build(spark, two).run({"split": split}).executed == ["split"]
    assert [spark.read.parquet(f"{two}/out/{n}.parquet").count() for n in ("low", "high")] == [1, 2]
    assert build(spark, two).run({"split": split}).executed == []

    def other(inputs, params, wildcards):
        return [inputs["raw"].limit(1), inputs["raw"].limit(3)]

    assert [r.reason for r in build(spark, two)._settle(bodies={"split": other}).values()] == ["code changed"]
    assert build(spark, two).run({"split": other}).executed == ["split"]
    assert spark.read.parquet(f"{two}/out/high.parquet").count() == 3
    failed = build(spark, two).run({"split": lambda i, p, w: i["raw"]})
    assert failed.failed == ["split"] and "1 frames for 2 outputs" in build(spark, two).history().where("status = 'failed'").first().error


def test_a_changed_parameter_or_output_runs_again(spark, root):
    first = Session.builder(f"{root}/flow.toml").targets(["results/a.parquet"]).build(spark)
    assert first.run().executed == ["clean-a"]
    with open(f"{root}/flow.toml") as file:
        text = file.read()
    with open(f"{root}/flow.toml", "w") as file:
        file.write(text.replace("least = 1", "least = 3"))
    again = Session.builder(f"{root}/flow.toml").targets(["results/a.parquet"]).build(spark)
    assert again.run().executed == ["clean-a"] and spark.read.parquet(f"{root}/results/a.parquet").count() == 1
    spark.range(7).write.mode("overwrite").parquet(f"{root}/results/a.parquet")
    tampered = Session.builder(f"{root}/flow.toml").targets(["results/a.parquet"]).build(spark)
    assert [r.reason for r in tampered.plan().collect()] == ["output changed: results/a.parquet"] and tampered.heal() == 1
    assert tampered.run().executed == ["clean-a"] and spark.read.parquet(f"{root}/results/a.parquet").count() == 1
    for name in os.listdir(f"{root}/results/a.parquet"):  # other times, same content
        os.utime(f"{root}/results/a.parquet/{name}", (time.time() + 90, time.time() + 90))
    assert Session.builder(f"{root}/flow.toml").targets(["results/a.parquet"]).build(spark).run().executed == []
    strict = Session.builder(f"{root}/flow.toml").targets(["results/a.parquet"]).validation("mtime").build(spark)
    assert [r.reason for r in strict.plan().collect()] == ["output changed: results/a.parquet"]


def test_programs_gates_and_benchmarks(spark, two):
    seen = []
    s = build(spark, two, "note.txt", "inline.json", "scripted.txt")
    result = s.run(report=seen.append)
    assert result.waiting == ["note"] and not result.ok and sorted(result.executed) == ["inline", "scripted"]
    assert [(r.id, r.gates) for r in s.gates().collect()] == [("note", ["ok"])] and s.gate_status("ok") == "pending"
    assert open(f"{two}/inline.json").read() == '{"lines": 4, "k": "v", "w": "inline.json"}' and open(f"{two}/scripted.txt").read() == "made\n"
    s.approve("ok", "someone")
    assert build(spark, two, "note.txt").run().executed == ["note"] and open(f"{two}/note.txt").read() == "hello 0\n"
    assert spark.read.csv(f"{two}/bench/note.tsv", sep="\t", header=True).columns == ["s", "h:m:s", "max_rss", "cpu_time"]
    assert build(spark, two, "note.txt", least="2").run().executed == ["note"] and open(f"{two}/note.txt").read() == "hello 2\n"
    assert [e["event"] for e in seen][0] == "run_started" and seen[-1]["event"] == "run_completed"
    closed = build(spark, two, "note.txt", least="3").run(gate=lambda name: False, wait_for_gates=0.4, sleep=lambda _: None)
    assert closed.waiting == ["note"]


def test_failures_stop_or_finish(spark, two):
    result = build(spark, two, "slow.txt").run()
    assert result.failed == ["slow"] and "timed out after 1 s" in build(spark, two).history().where("job_id = 'slow'").first().error
    s = build(spark, two, "after.txt", "note.txt")
    s.approve("ok")
    s.workflow.rule("bad").priority = 5
    result = s.run(parallel=1)
    assert result.failed == ["bad"] and sorted(result.cancelled) == ["after", "note"]
    assert s.history().where("job_id = 'bad'").first().error == "exit code 3: why"
    s = build(spark, two, "after.txt", "note.txt")
    s.workflow.rule("bad").on_error = "finish"
    result = s.run(parallel=1)
    assert result.failed == ["bad"] and result.cancelled == ["after"] and result.executed == ["note"]


def test_budget_holds_jobs_back(spark, root):
    s = session(spark, root)
    s.workflow.rule("clean").resources = {"cpu": "2", "note": "many"}
    now, most = set(), []
    report = lambda e: (now.add(e["job_id"]), most.append(len(now))) if e["event"] == "job_started" else now.discard(e.get("job_id"))
    assert s.run({"summary": summary}, parallel=8, budget={"cpu": 4}, report=report).ok and max(most) == 2
    s = session(spark, root)
    s.workflow.rule("clean").resources = {"cpu": "2"}
    result = s.run({"summary": summary}, force=["clean"], budget={"cpu": 1})
    assert result.waiting == ["clean-a", "clean-b", "clean-c", "summary"]


def test_snapshots_and_cascade(spark, root):
    s = session(spark, root)
    s.snapshot("a b/c")
    s.run({"summary": summary})
    s = session(spark, root)
    s.snapshot("after")
    assert sorted((r.name, r.jobs) for r in s.snapshots().collect()) == [("a b/c", 4), ("after", 4)]
    assert {r.change for r in s.compare("a b/c", "after").collect()} == {"changed"}
    assert s.delete_snapshot("after") and not s.delete_snapshot("after") and s.snapshots().count() == 1
    s.invalidate("clean", cascade=True)
    assert len(session(spark, root).run({"summary": summary}).executed) == 4
    s.invalidate("clean")
    assert session(spark, root).plan().where("action = 'run'").count() == 4
