import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwright.operators import graph
from loomwright.sources import codecs, files, sinks, workflow
from loomwright.streaming import events


def test_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b\tc", 2)], "k string, n long")
    for name in ("x.parquet", "x.csv", "x.tsv", "x.ndjson", "x.orc"):
        codecs.write(df, f"{tmp_path}/{name}")
        back = codecs.read(spark, f"{tmp_path}/{name}").select("k", F.col("n").cast("long"))
        assert sorted(back.collect()) == sorted(df.collect())
    with pytest.raises(codecs.CodecError):
        codecs.write(df, f"{tmp_path}/x.npz")
    with pytest.raises(codecs.CodecError):
        codecs.detect("x.unknown")
    assert codecs.detect("a/b.dat", "csv") == "csv" and codecs.detect("b.dat", ".feather") == "arrow" and codecs.detect("b.JSON") == "json"


def test_arrays_arrow_and_documents(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6).reshape(2, 3))
    assert [r["values"] for r in codecs.read(spark, f"{tmp_path}/a.npy").orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]
    np.savez(tmp_path / "b.npz", p=np.ones(2), q=np.zeros((1, 2)))
    assert {(r.name, tuple(r["values"])) for r in codecs.read(spark, f"{tmp_path}/b.npz").collect()} == {("p", (1.0, 1.0)), ("q", (0.0, 0.0))}
    t = pa.table({"k": ["x", "y"], "n": [1, 2]})
    with pa.OSFile(f"{tmp_path}/c.arrow", "wb") as sink, pa.ipc.new_file(sink, t.schema) as out:
        out.write_table(t)
    assert sorted(tuple(r) for r in codecs.read(spark, f"{tmp_path}/c.arrow").collect()) == [("x", 1), ("y", 2)]
    (tmp_path / "d.json").write_text(json.dumps([{"k": 1}, {"k": 2}], indent=1))
    assert sorted(r.k for r in codecs.read(spark, f"{tmp_path}/d.json").collect()) == [1, 2]
    with pytest.raises(codecs.CodecError):
        codecs.read(spark, f"{tmp_path}/e.pickle")


def test_discovery_and_hashes(spark, tmp_path):
    for name in ("a.txt", "d/b.txt", "d/target/c.txt", "1/2/3/4/5/ok.txt", "1/2/3/4/5/6/deep.txt"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(name)
    found = files.discover(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {"a.txt", "d/b.txt", "1/2/3/4/5/ok.txt"}
    hashed = files.with_hashes(spark, found, str(tmp_path))
    memo = hashed.where("path <> 'a.txt'").select("path", "mtime", "size", F.lit("known").alias("hash"))
    again = {r.path: r.hash for r in files.with_hashes(spark, found, str(tmp_path), memo).collect()}
    assert again["d/b.txt"] == "known" and len(again["a.txt"]) == 64


def test_commit_replaces_whole(spark, tmp_path):
    for n in (3, 5):
        sinks.commit(spark.range(n), f"{tmp_path}/deep/out.parquet")
        assert spark.read.parquet(f"{tmp_path}/deep/out.parquet").count() == n
    assert os.listdir(tmp_path / "deep") == ["out.parquet"]


def test_benchmark_lock_and_artifacts(spark, tmp_path):
    row = sinks.benchmark_rows(spark.createDataFrame([("j", 3_723_500, 10, 1.5)], "job_id string, wall_ms long, max_rss long, cpu_s double")).first()
    assert (row["s"], row["h:m:s"], row["cpu_time"]) == ("3723.5000", "1:02:03", "1.50")
    rules = spark.createDataFrame([("r", "e", "p")], "name string, execution_hash string, params_hash string")
    inputs = spark.createDataFrame([("i", "h")], "path string, hash string")
    sinks.write_lock(spark, rules, inputs, f"{tmp_path}/lock")
    a, b = sinks.read_lock(spark, f"{tmp_path}/lock")
    assert a.collect() == rules.collect() and b.collect() == inputs.collect()
    sinks.store_artifact(spark.range(3), f"{tmp_path}/cache", "ab12")
    sinks.store_artifact(spark.range(9), f"{tmp_path}/cache", "ab12")
    assert sinks.fetch_artifact(spark, f"{tmp_path}/cache", "ab12").count() == 3 and sinks.fetch_artifact(spark, f"{tmp_path}/cache", "cd") is None


def test_workflow_files(tmp_path):
    (tmp_path / "u.csv").write_text("k, v\na, 1\nb,\na, 2\n")
    flow = workflow.parse_workflow(
        """
[config]
names = { source = "u.csv", key = "k", columns = ["v"] }
n = 3
flag = true
[rule.b]
input = { x = "in/{name}.csv", y = ["p.csv", "q.csv"] }
output = [{ path = "out/{name}.parquet", materialize = "never" }]
call = "m:f"
when = { op = "in", field = "name", values = "@k" }
error_strategy = { strategy = "retry", count = 4, backoff = "linear" }
params = { p = 1 }
[rule.a]
output = "z"
sql = "SELECT 1"
[gate.g]
before = ["b"]
[profile.fast]
n = 1
""",
        str(tmp_path),
    )
    assert flow.config == {"names": ["a", "b"], "v": ["1", "2"], "n": "3", "flag": "true"}
    b = flow.rule("b")
    assert [(f.name, f.pattern) for f in b.inputs] == [("x", "in/{name}.csv"), ("y", "p.csv"), ("y", "q.csv")]
    assert (b.retries, b.backoff, b.on_error, b.outputs[0].materialize, b.source) == (4, "linear", "retry", "never", "call:m:f(p=1)")
    assert workflow.default_targets(flow) == ["z"] and flow.gates[0].before == ["b"]
    assert workflow.with_overrides(flow, {"names": "q", "n": "7,8"}, "fast").config | {"v": 0} == {"names": ["q"], "n": ["7", "8"], "flag": "true", "v": 0}
    for bad in ("x = [", "[rule.r]\noutput = '{a}{b}'\n", "[rule.r]\nsql='a'\ncall='b'\n", "[rule.r]\nwhen = 'a in b'\n"):
        with pytest.raises(ValueError):
            workflow.parse_workflow(bad)


def test_stream_equals_batch(spark, tmp_path):
    lines = [{"event": "job_started", "job_id": f"j{k % 7}", "seq": k, "ts": f"2025-01-01T00:{k:02d}:00Z", "tags": {"k": str(k % 2)}} for k in range(20)]
    lines += [{"event": "job_completed", "job_id": "j1", "seq": 5, "ts": "2025-01-01T01:00:00Z"}, {"event": "new_kind", "job_id": "j2", "seq": 30, "ts": "2025-01-01T01:00:00Z"}]
    text = [json.dumps(x) for x in lines] + ["not json", "{}"]
    os.makedirs(tmp_path / "log")
    for part in range(3):
        (tmp_path / f"log/{part}.ndjson").write_text("\n".join(text[part::3]) + "\n")
    batch = events.parsed(spark.read.text(f"{tmp_path}/log"))
    assert batch.count() == 22 and events.matching(batch, ["job_started"], {"k": "1"}).count() == 10
    stream = events.follow(spark, f"{tmp_path}/log", per_trigger=1)
    events.bridge(stream, events.ledger_sink(f"{tmp_path}/ledger"), f"{tmp_path}/ckpt").awaitTermination(120)
    want = {tuple(r) for r in events.latest_status(batch).collect()}
    assert {tuple(r) for r in events.folded_ledger(spark, f"{tmp_path}/ledger").collect()} == want and ("j1", "completed") in want
    q = events.counters(events.latest_status(batch)).first()
    assert (q.running, q.completed) == (6, 1)


def test_cycles_are_found(spark):
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (0, 1)], "from_job long, to_job long")
    nodes = spark.createDataFrame([(k,) for k in range(5)], "id long")
    assert {r.id for r in graph.in_cycles(spark, loop).collect()} == {1, 2, 3}
    with pytest.raises(graph.CycleError):
        graph.levels(spark, nodes, loop)
