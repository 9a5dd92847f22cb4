"""Sessions: a workflow is planned as tables (jobs, edges, what to run and why) and run level by level.

    session = Session.builder("flow.toml").targets(["report.parquet"]).config_override("samples", "a,b").build(spark)
    session.plan().show()
    result = session.run({"clean": clean})

A rule's body is SQL over its named inputs, a Python function (inputs, params, wildcards) -> DataFrame, or for small
steps a program (shell, run, script) that the driver starts beside a local root.  What SQL and functions return is lazy
until its output is committed; a rule with several outputs returns one frame for each, by name or by place.  Jobs of a
level run side by side as Spark jobs of one application.

A job is up to date if its key is in the cache and its outputs are as they were recorded.  A key holds the rule's text
with the job's values filled in, its parameters, environment and wildcards (framed, so no two run into each other), and
what its inputs are: the content hash of a file from outside (looked up by path, time and size before it is read), and
the key of the producing job for a file of our own.  The code of a function is kept beside the key and compared where
the function is given.  Outputs are recorded with time, size and (but for validation "mtime") a hash when they are
committed; one that is missing or was changed by others is made again, and its entry is dropped."""

from __future__ import annotations

import hashlib
import inspect
import os
import re
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import patterns
from loomwright.functions.parsing import kwarg_literal
from loomwright.operators import cache, expand, graph, policy, snapshot
from loomwright.plans import blocks
from loomwright.plans.interfaces import Executor, GateCheck, RemoteCache, Reporter
from loomwright.sources import codecs, files, sinks, workflow
from loomwright.sources.workflow import Rule, Workflow
from loomwright.streaming.events import EVENT_SCHEMA

Body = Callable[[dict[str, DataFrame], dict[str, str], dict[str, str]], DataFrame]
Frames = DataFrame | dict[str, DataFrame] | list[DataFrame] | tuple[DataFrame, ...]
ENTRIES = "cache_key string, job_id string, code string"
RECORDS = "cache_key string, path string, hash string, mtime long, size long, at double"
MEMO = "path string, mtime long, size long, hash string"
GATES = "gate string, status string, by string, at double"
#: Seconds between two looks at closed gates, and by unit of a timeout.
POLL, UNITS = 0.2, {"s": 1, "m": 60, "h": 3600, "d": 86400}
PLAN = "job_id string, rule string, level int, action string, reason string, cache_key string"
HISTORY = "run_id string, job_id string, rule string, status string, cached boolean, attempt int, started_at double, completed_at double, wall_ms long, cache_key string, error string"


class RunError(RuntimeError):
    """A run that can't be planned or started."""


@dataclass
class Job:
    id: str
    rule: Rule
    wildcards: dict[str, str]
    level: int
    inputs: list[tuple[str | None, str, str | None]] = field(default_factory=list)
    outputs: list[tuple[str, str | None]] = field(default_factory=list)
    upstream: set[str] = field(default_factory=set)
    key: str | None = None
    reason: str | None = None  # why it runs; None: it is up to date
    code: str | None = None  # hash of the function that is its body


@dataclass
class Result:
    run_id: str
    executed: list[str]
    cached: list[str]
    failed: list[str]
    cancelled: list[str]
    waiting: list[str] = field(default_factory=list)  # behind a gate that isn't open, or a budget that can't hold them

    @property
    def ok(self) -> bool:
        return not self.failed and not self.cancelled and not self.waiting


def seconds_of(text: str | None) -> float | None:
    """A timeout: a number of seconds, or one with a unit."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smhd]?)\s*", text or "")
    return float(m[1]) * UNITS.get(m[2], 1) if m else None


def code_hash(body: Callable) -> str:
    """A hash of a function's source, or of its compiled code where there is none."""
    try:
        text = inspect.getsource(body).encode()
    except (OSError, TypeError):
        made = getattr(body, "__code__", None)
        text = made.co_code + repr(made.co_consts).encode() if made else repr(type(body)).encode()
    return hashlib.sha256(text).hexdigest()


class Builder:
    def __init__(self, source: str | Workflow):
        self._workflow = workflow.read_workflow(source) if isinstance(source, str) else source
        self._targets: list[str] = []
        self._overrides: dict[str, str] = {}
        self._profile: str | None = None
        self._root: str | None = None
        self._state: str | None = None
        self._validation = "mtime_hash"

    def targets(self, paths: list[str]) -> Builder:
        self._targets = list(paths)
        return self

    def config_override(self, key: str, value: str) -> Builder:
        self._overrides[key] = value
        return self

    def profile(self, name: str) -> Builder:
        self._profile = name
        return self

    def root(self, folder: str) -> Builder:
        """The folder that paths are relative to; by default that of the workflow file."""
        self._root = folder
        return self

    def state(self, folder: str) -> Builder:
        """Where the cache and the ledger are kept; by default ``.loom`` in the root."""
        self._state = folder
        return self

    def validation(self, mode: str) -> Builder:
        """How outputs are compared with their records: "mtime", "mtime_hash" or "content_hash"."""
        if mode not in cache.MODES:
            raise RunError(f"no validation {mode!r}")
        self._validation = mode
        return self

    def build(self, spark: SparkSession) -> Session:
        made = workflow.with_overrides(self._workflow, self._overrides, self._profile)
        names = [r.name for r in made.rules]
        if len(set(names)) < len(names):
            raise RunError("two rules have one name")
        root = (self._root or made.base).rstrip("/")
        return Session(spark, made, self._targets, root, (self._state or f"{root}/.loom").rstrip("/"), self._validation)


class Session:
    def __init__(self, spark: SparkSession, flow: Workflow, targets: list[str], root: str, state: str, validation: str = "mtime_hash"):
        self.spark, self.workflow, self.root, self.state, self.validation = spark, flow, root, state, validation
        self.targets = [patterns.config_substituted(t, flow.config, strict=False) for t in targets]
        self._jobs: dict[str, Job] | None = None
        self._edges: DataFrame | None = None

    @staticmethod
    def builder(source: str | Workflow) -> Builder:
        return Builder(source)

    # planning

    def target_paths(self) -> list[str]:
        wanted = self.targets or workflow.default_targets(self.workflow)
        return list(dict.fromkeys(p for text in wanted for p in expand.target_paths(text, self.workflow.config)))

    def _sources(self) -> set[str]:
        """Files, and folders that hold some, that are there and aren't outputs of the workflow's rules, by path."""
        specs = expand.resolved([r.spec() for r in self.workflow.rules], self.workflow.config)
        made = [patterns.compiled(patterns.parse_pattern(o), r.constraints, "(/.*)?").match for r in specs for o in r.outputs]
        out = set()
        for (path,) in files.discover(self.spark, self.root, depth=64, skipped=()).select("path").toLocalIterator():
            steps = path.split("/")
            if len(steps) <= files.DEPTH + 1 and not set(steps[:-1]) & set(files.SKIPPED) and ".staged-" not in path and steps[0] != ".loom":
                out |= {"/".join(steps[:n]) for n in range(1, len(steps) + 1)}
        return {p for p in out if not any(m(p) for m in made)}

    def graph(self) -> tuple[dict[str, Job], DataFrame]:
        """The jobs by id, and (from_job, to_job)."""
        if self._jobs is not None:
            return self._jobs, self._edges
        found, _ = expand.chain_local([r.spec() for r in self.workflow.rules], self.workflow.config, self.target_paths(), self._sources(), lambda p: self._exists(f"{self.root}/{p}"))
        makers = {p: j.id for j in found.values() for p in j.outputs}
        by: dict[str, Job] = {}
        for j in found.values():
            rule = self.workflow.rule(j.rule)
            inputs = [(rule.inputs[place].name, path, rule.inputs[place].format) for place, path in j.inputs]
            outputs = [(path, ref.format) for path, ref in zip(j.outputs, rule.outputs, strict=True)]
            by[j.id] = Job(j.id, rule, j.wildcards, j.level, inputs, outputs, {makers[p] for _, p in j.inputs if p in makers})
        self._jobs = by
        self._edges = self.spark.createDataFrame(sorted((u, j.id) for j in by.values() for u in j.upstream), "from_job string, to_job string")
        return by, self._edges

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.state}/{name}"
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _source_hashes(self, paths: set[str]) -> dict[str, str]:
        """Content hashes of files (or folders as one) from outside; only those that the memo doesn't know are read."""
        if not paths:
            return {}
        memo = self._table("memo", MEMO).dropDuplicates(["path", "mtime", "size"])
        now = self._outputs_now(sorted(paths), False).drop("hash")
        _, unknown = cache.memoised(now, memo)
        unknown = [r.path for r in unknown.select("path").collect()]  # as many as the plan's jobs take in
        if unknown:
            self._outputs_now(unknown, True).select("path", "mtime", "size", "hash").write.mode("append").parquet(f"{self.state}/memo")
            memo = self._table("memo", MEMO).dropDuplicates(["path", "mtime", "size"])
        known, _ = cache.memoised(now, memo)
        return {r.path: r.hash for r in known.select("path", "hash").collect()}

    def _values(self, job: Job) -> dict[str, str]:
        """A job's parameters, with wildcards and config filled in."""
        scalars = {k: v for k, v in self.workflow.config.items() if isinstance(v, str)}
        return {k: patterns.command(v, [], [], job.wildcards, config=scalars) for k, v in job.rule.params.items()}

    def _filled(self, job: Job, text: str, quoted: bool = False) -> str:
        """A body's text with the job's files, wildcards, params, config and resources filled in."""
        scalars = {k: v for k, v in self.workflow.config.items() if isinstance(v, str)}
        pairs = [[(n, p) for n, p, _ in job.inputs], [(ref.name, p) for (p, _), ref in zip(job.outputs, job.rule.outputs, strict=True)]]
        wildcards = {k: v.replace("'", "''") for k, v in job.wildcards.items()} if quoted else job.wildcards
        if quoted:  # SQL: {input} and named inputs are frames, and stay
            return patterns.command(text.replace("{input}", "{\0}"), [], [], wildcards, self._values(job)).replace("{\0}", "{input}")
        return patterns.command(text, *pairs, wildcards, self._values(job), scalars, job.rule.resources)

    def _content(self, path: str) -> bytes | None:
        """A small file of the project (a script, an environment's specification)."""
        full = f"{self.root}/{path}"
        return bytes(self.spark.read.format("binaryFile").load(full).select("content").first()[0]) if self._exists(full) else None

    def _source_of(self, job: Job) -> str:
        """What a job does, as text: the body with its values filled in and the parameters, framed."""
        rule = job.rule
        body = rule.source
        if rule.sql is not None:
            body = "sql:" + self._filled(job, rule.sql, quoted=True)
        elif rule.shell is not None or rule.run is not None:
            body = self._filled(job, body)
        elif rule.script is not None:
            body += ":" + hashlib.sha256(self._content(rule.script) or b"").hexdigest()
        return cache.framed_text("body", body) + cache.framed_text("params", cache.framed_map(self._values(job)))

    def _outputs_now(self, paths: list[str], hashes: bool) -> DataFrame:
        """path, hash, mtime, size of the outputs that are there (files, or folders as one); a hash only where asked for."""
        wanted = self.spark.createDataFrame([(p,) for p in paths], "path string")
        there = [p for p in paths if self._exists(f"{self.root}/{p}")]
        listed = files.discover(self.spark, self.root, depth=64, skipped=(), only=there)
        steps = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
        parts = listed.select(F.explode(above).alias("path"), "full_path", "mtime", "size").join(F.broadcast(wanted), "path")
        if hashes:
            read = [f"{self.root}/{p}" for p in there]
            content = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(read) if read else self.spark.createDataFrame([], "path string, content binary")
            parts = parts.join(content.select(F.col("path").alias("full_path"), F.sha2("content", 256).alias("own")), "full_path", "left")
        else:
            parts = parts.withColumn("own", F.lit(None).cast("string"))
        whole = F.when(F.count("own") == F.count("*"), F.sha2(F.array_join(F.array_sort(F.collect_list("own")), ","), 256))
        return parts.groupBy("path").agg(whole.alias("hash"), F.max("mtime").alias("mtime"), F.sum("size").alias("size"))

    def _records(self) -> DataFrame:
        """The latest record of each key and output."""
        rows = self._table("records", RECORDS)
        latest = rows.groupBy("cache_key", "path").agg(F.max_by(F.struct("hash", "mtime", "size"), "at").alias("r"))
        return latest.select("cache_key", "path", "r.*")

    def _verified(self, jobs: dict[str, Job]) -> dict[str, tuple[str, str | None]]:
        """Hit, miss, missing or mismatch of each job with a key, with the first bad output."""
        keyed = [(j.id, j.key) for j in jobs.values() if j.key]
        outputs = [(j.id, k, p) for j in jobs.values() for k, (p, _) in enumerate(j.outputs)]
        if not keyed or not outputs:
            known = {r.cache_key for r in self._mine(keyed, self._table("cache", ENTRIES)).collect()} if keyed else set()
            return {i: ("hit" if k in known else "miss", None) for i, k in keyed}
        frames = self.spark.createDataFrame(keyed, "job_id string, cache_key string"), self.spark.createDataFrame(outputs, "job_id string, place int, path string")
        entries, records = self._mine(keyed, self._table("cache", ENTRIES)), self._mine(keyed, self._records())
        now = self._outputs_now([p for _, _, p in outputs], self.validation == "content_hash")
        found = cache.lookup(*frames, entries, records, now, "mtime" if self.validation == "mtime_hash" else self.validation).collect()
        doubtful = [r.path for r in found if r.status == "mismatch"]
        if doubtful and self.validation == "mtime_hash":  # only what time and size don't vouch for is read
            now = now.join(self.spark.createDataFrame([(p,) for p in doubtful], "path string"), "path", "left_anti").unionByName(self._outputs_now([p for _, _, p in outputs], True))
            now = now.groupBy("path").agg(F.max("hash").alias("hash"), F.max("mtime").alias("mtime"), F.max("size").alias("size"))
            found = cache.lookup(*frames, entries, records, now, "mtime_hash").collect()
        return {r.job_id: (r.status, r.path) for r in found}

    def _mine(self, keyed: list[tuple[str, str]], rows: DataFrame) -> DataFrame:
        return rows.join(self.spark.createDataFrame(sorted({(k,) for _, k in keyed}), "cache_key string"), "cache_key", "left_semi")

    def _settle(self, force: list[str] | None = None, bodies: dict[str, Body] | None = None) -> dict[str, Job]:
        """Keys and reasons of all jobs."""
        jobs, _ = self.graph()
        producers = {p: j.id for j in jobs.values() for p, _ in j.outputs}
        outside = {p for j in jobs.values() for _, p, _ in j.inputs if p not in producers} | {p for j in jobs.values() for p in j.rule.param_files}
        hashes = self._source_hashes(outside)
        order = sorted(jobs.values(), key=lambda j: -j.level)  # upstream first
        for j in order:
            pairs = [(p, jobs[producers[p]].key if p in producers else hashes.get(p)) for p in [*(i[1] for i in j.inputs), *j.rule.param_files]]
            j.key = cache.cache_key_of(self._source_of(j), pairs, cache.framed_map(j.wildcards), cache.env_hash(j.rule.env, self._content), None, "spark")
            body = (bodies or {}).get(j.rule.call or j.rule.name)
            j.code = code_hash(body) if body is not None else None
        found = self._verified(jobs)
        codes: dict[str, set[str]] = {}
        if any(j.code for j in order):
            for r in self._mine([(j.id, j.key) for j in order if j.key], self._table("cache", ENTRIES)).where("code is not null").select("cache_key", "code").distinct().collect():
                codes.setdefault(r.cache_key, set()).add(r.code)
        for j in order:
            status, path = found.get(j.id, ("miss", None))
            reasons = {"miss": "never ran with these inputs", "missing": f"output missing: {path}", "mismatch": f"output changed: {path}"}
            j.reason = "no key" if j.key is None else reasons.get(status)
            if j.reason is None and j.code and j.key in codes and j.code not in codes[j.key]:
                j.reason = "code changed"
            if j.reason is None and force and j.rule.name in force:
                j.reason = "forced"
            if j.reason is None and any(jobs[u].reason for u in j.upstream):
                j.reason = "upstream runs"
        return jobs

    def heal(self) -> int:
        """Drops the entries of jobs whose outputs are missing or changed; their number."""
        jobs = self._settle()
        bad = [(j.key,) for j in jobs.values() if j.reason and j.reason.startswith("output ")]
        if bad:
            self._forget(self.spark.createDataFrame(bad, "cache_key string"), "cache_key")
        return len(bad)

    def _forget(self, gone: DataFrame, key: str) -> None:
        kept = self._table("cache", ENTRIES).join(gone.select(key).distinct(), key, "left_anti").select("cache_key", "job_id", "code")
        sinks.commit(kept, f"{self.state}/cache", "parquet")

    def plan(self, force: list[str] | None = None) -> DataFrame:
        """job_id, rule, level (0 is last), action, reason, cache_key; in the order in which jobs can run."""
        rows = [(j.id, j.rule.name, j.level, "run" if j.reason else "skip", j.reason, j.key) for j in self._settle(force).values()]
        return self.spark.createDataFrame(rows, PLAN).orderBy(F.desc("level"), "job_id")

    def edges(self) -> DataFrame:
        return self.graph()[1]

    def deps(self, job: str) -> DataFrame:
        return graph.deps(self.spark, self.edges(), self.spark.createDataFrame([(job,)], "id string"))

    def rdeps(self, job: str) -> DataFrame:
        return graph.rdeps(self.spark, self.edges(), self.spark.createDataFrame([(job,)], "id string"))

    def all_paths(self, start: str, end: str) -> DataFrame:
        frame = self.spark.createDataFrame
        return graph.all_paths(self.spark, self.edges(), frame([(start,)], "id string"), frame([(end,)], "id string"))

    def query(self, text: str) -> DataFrame:
        """``deps(X)``, ``rdeps(X)`` or ``allpaths(X, Y)``; X is a job id, an output path, or a rule with one job."""
        m = re.fullmatch(r"\s*(deps|rdeps|allpaths)\(\s*([^,()]+?)\s*(?:,\s*([^,()]+?)\s*)?\)\s*", text)
        if not m or (m[1] == "allpaths") != (m[3] is not None):
            raise RunError(f"not a query: {text!r}")
        names = [self._named(n) for n in m.groups()[1:] if n]
        return {"deps": self.deps, "rdeps": self.rdeps, "allpaths": self.all_paths}[m[1]](*names)

    def _named(self, name: str) -> str:
        jobs, _ = self.graph()
        if name in jobs:
            return name
        by_output = [j.id for j in jobs.values() if name in (p for p, _ in j.outputs)]
        found = by_output or [j.id for j in jobs.values() if j.rule.name == name]
        if len(found) != 1:
            raise RunError(f"{name!r} is {'no job' if not found else f'{len(found)} jobs'}")
        return found[0]

    # running

    def run(
        self,
        bodies: dict[str, Body] | None = None,
        parallel: int = 4,
        keep_going: bool = False,
        force: list[str] | None = None,
        sleep: Callable[[float], None] = time.sleep,
        budget: dict[str, float] | None = None,
        gate: GateCheck | None = None,
        wait_for_gates: float = 0.0,
        report: Reporter | None = None,
        executor: Executor | None = None,
        remote: RemoteCache | None = None,
    ) -> Result:
        """Runs what isn't up to date and writes the ledger, also where nothing ran.

        ``budget`` limits what running jobs need together, by resource.  Jobs behind a gate that isn't open (see
        :meth:`approve`, or ``gate``) wait; where nothing else is left, for ``wait_for_gates`` seconds at most.  A failure
        stops the run and what is running, unless its rule's strategy is "finish" or ``keep_going`` is set: then only
        what is downstream of it is cancelled."""
        jobs, bodies, run_id = self._settle(force, bodies), bodies or {}, uuid.uuid4().hex
        plain = lambda r: r.sql is None and r.shell is None and r.run is None and r.script is None
        missing = sorted({j.rule.call or j.rule.name for j in jobs.values() if j.reason and j.rule.outputs and plain(j.rule) and (j.rule.call or j.rule.name) not in bodies}) if executor is None else []
        if missing:
            raise RunError(f"no body for {', '.join(missing)}")
        state = {j.id: "completed" if j.reason is None else "pending" for j in jobs.values()}
        below: dict[str, set[str]] = {}
        for j in jobs.values():
            for u in j.upstream:
                below.setdefault(u, set()).add(j.id)
        history: list[tuple] = [(run_id, j.id, j.rule.name, "completed", True, 0, None, None, None, j.key, None) for j in jobs.values() if j.reason is None]
        left = {j.id: sum(state[u] == "pending" for u in j.upstream) for j in jobs.values() if state[j.id] == "pending"}
        ready = [i for i, n in left.items() if not n]
        running: dict[Future, str] = {}
        told: list[dict] = []
        same: set[str] = set()  # jobs that made what was there before
        stopped, waited = False, 0.0
        shut = {r: g.name for g in self.workflow.gates for r in g.before}
        opened: dict[str, bool] = {}

        def tell(event: str, **more) -> None:
            told.append({"event": event, "ts": time.time(), "seq": len(told), **more})
            if report:
                report(told[-1])

        def held_back(job: Job) -> bool:
            name = shut.get(job.rule.name)
            if name is not None and not opened.get(name):
                opened[name] = bool(gate(name)) if gate else self.gate_status(name) == "approved"
            return name is not None and not opened[name]

        def startable(job: Job) -> bool:
            return not held_back(job) and policy.fits(policy.needs_of(job.rule.resources), [], budget or {})

        def done_with(job: Job) -> None:
            for d in below.get(job.id, ()):
                if d in left and state[d] == "pending":
                    left[d] -= 1
                    if not left[d]:
                        ready.append(d)

        tell("run_started", total_jobs=len(jobs), to_run=len(left), cached=len(history))
        context = self.spark.sparkContext
        with ThreadPoolExecutor(max(1, parallel)) as pool:
            while (ready and not stopped) or running:
                ready.sort(key=lambda i: (-jobs[i].rule.priority, i))
                for i in list(ready):
                    job = jobs[i]
                    if stopped or len(running) >= parallel:
                        break
                    if job.reason == "upstream runs" and job.upstream and all(state[u] == "completed" and (jobs[u].reason is None or u in same) for u in job.upstream):
                        ready.remove(i)  # looked at again when it could start: what it takes in came out as it was
                        state[i] = "completed"
                        same.add(i)
                        history.append((run_id, i, job.rule.name, "completed", True, 0, None, None, None, job.key, None))
                        done_with(job)
                        continue
                    used = [policy.needs_of(jobs[r].rule.resources) for r in running.values()]
                    if held_back(job) or not policy.fits(policy.needs_of(job.rule.resources), used, budget or {}):
                        continue
                    ready.remove(i)
                    state[i] = "running"
                    tell("job_started", job_id=i, rule=job.rule.name, tags=job.wildcards)
                    running[pool.submit(self._attempts, job, bodies, sleep, f"{run_id}-{i}", lambda: stopped, executor, remote)] = i
                if not running:
                    if not stopped and any(held_back(jobs[i]) for i in ready) and waited < wait_for_gates:
                        sleep(POLL)
                        waited += POLL
                        continue
                    if stopped or not any(left[i] == 0 and startable(jobs[i]) for i in ready):
                        break
                    continue
                done, _ = wait(running, return_when=FIRST_COMPLETED)
                for future in done:
                    job = jobs[running.pop(future)]
                    status, attempt, began, ended, error, unchanged = future.result()
                    if status == "failed" and stopped:
                        status, error = "cancelled", None
                    history.append((run_id, job.id, job.rule.name, status, False, attempt, began, ended, int((ended - began) * 1000), job.key, error))
                    tell({"completed": "job_completed", "failed": "job_failed"}.get(status, "job_skipped"), job_id=job.id, rule=job.rule.name, tags=job.wildcards, duration_ms=int((ended - began) * 1000), error_message=error)
                    if status == "failed" and job.rule.on_error == "ignore":
                        status = "skipped"
                    state[job.id] = status
                    if unchanged:
                        same.add(job.id)
                    if job.rule.benchmark and status == "completed":
                        self._benchmark(job, int((ended - began) * 1000))
                    if status == "cancelled":
                        continue
                    if status == "failed":
                        if not (keep_going or job.rule.on_error == "finish") and not stopped:
                            stopped = True
                            for other in running.values():
                                context.cancelJobsWithTag(f"{run_id}-{other}")
                        gone, todo = set(), [job.id]
                        while todo:
                            for d in below.get(todo.pop(), ()):
                                if d not in gone and state[d] == "pending":
                                    gone.add(d)
                                    todo.append(d)
                        for d in gone:
                            state[d] = "cancelled"
                        continue
                    done_with(job)
        waiting = {i for i in ready if state[i] == "pending"} if not stopped else set()
        todo = list(waiting)
        while todo:
            for d in below.get(todo.pop(), ()):
                if state[d] == "pending" and d not in waiting:
                    waiting.add(d)
                    todo.append(d)
        for i in (i for i, s in state.items() if s == "pending"):
            state[i] = "waiting" if i in waiting else "cancelled"
        logged = {h[1] for h in history}
        history += [(run_id, i, jobs[i].rule.name, s, False, 0, None, None, None, jobs[i].key, None) for i, s in state.items() if s in ("cancelled", "waiting") and i not in logged]
        self.spark.createDataFrame(history, HISTORY).write.mode("append").parquet(f"{self.state}/history")
        self._remember([jobs[h[1]] for h in history if h[3] == "completed" and (not h[4] or h[1] in same)])
        ran = [h[1] for h in history if not h[4] and h[3] == "completed"]
        out = Result(run_id, ran, [h[1] for h in history if h[4]], [h[1] for h in history if h[3] == "failed" and state[h[1]] == "failed"], [i for i, s in state.items() if s == "cancelled"], sorted(i for i, s in state.items() if s == "waiting"))
        tell("run_completed", succeeded=len(ran), failed=len(out.failed), cached=len(out.cached))
        names = [f.name for f in EVENT_SCHEMA]
        rows = [tuple(datetime.fromtimestamp(e["ts"], timezone.utc) if n == "ts" else e.get(n) for n in names) for e in told]
        sinks.append_events(self.spark.createDataFrame(rows, EVENT_SCHEMA), f"{self.state}/events")
        return out

    def _remember(self, jobs: list[Job]) -> None:
        """Entries and records of jobs whose outputs are as they are now."""
        keyed = [j for j in jobs if j.key]
        if not keyed:
            return
        self.spark.createDataFrame([(j.key, j.id, j.code) for j in keyed], ENTRIES).write.mode("append").parquet(f"{self.state}/cache")
        pairs = [(j.key, p) for j in keyed for p, _ in j.outputs]
        if pairs:
            now = self._outputs_now([p for _, p in pairs], self.validation != "mtime")
            made = self.spark.createDataFrame(pairs, "cache_key string, path string").join(now, "path")
            made.select("cache_key", "path", F.coalesce("hash", F.lit("-")).alias("hash"), "mtime", "size", F.lit(time.time()).alias("at")).write.mode("append").parquet(f"{self.state}/records")

    def _benchmark(self, job: Job, wall_ms: int) -> None:
        """Writes a job's times to the file that its rule names, tab-separated."""
        row = self.spark.createDataFrame([(job.id, wall_ms, 0, wall_ms / 1000)], "job_id string, wall_ms long, max_rss long, cpu_s double")
        path = sinks.confined(self.root, patterns.fill(patterns.parse_pattern(job.rule.benchmark), job.wildcards))
        sinks.commit(sinks.benchmark_rows(row).select("s", "h:m:s", "max_rss", "cpu_time"), path, "tsv")

    def _attempts(self, job: Job, bodies: dict[str, Body], sleep: Callable[[float], None], tag: str, stopped: Callable[[], bool], executor: Executor | None, remote: RemoteCache | None) -> tuple[str, int, float, float, str | None, bool]:
        began, attempt, limit = time.time(), 0, seconds_of(job.rule.timeout)
        context = self.spark.sparkContext
        while True:
            attempt += 1
            late = threading.Event()
            clock = threading.Timer(limit, lambda: (late.set(), context.cancelJobsWithTag(tag))) if limit else None
            try:
                context.addJobTag(tag)
                if clock:
                    clock.start()
                before = self._digest(job) if job.reason not in ("never ran with these inputs", "no key") or job.outputs else None
                self._execute(job, bodies, stopped, executor, remote)
                return "completed", attempt, began, time.time(), None, before is not None and before == self._digest(job)
            except Exception as e:  # noqa: BLE001  a rule's body may raise anything
                if attempt >= job.rule.retries or stopped():
                    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
                    return "failed", attempt, began, time.time(), f"timed out after {limit:g} s" if late.is_set() else lines[-1] if lines else type(e).__name__, False
                sleep({"linear": attempt, "exponential": 2 ** (attempt - 1)}.get(job.rule.backoff, 1))
            finally:
                if clock:
                    clock.cancel()
                context.removeJobTag(tag)

    def _digest(self, job: Job) -> list[tuple[str, str]] | None:
        """The hashes of a job's outputs, or None where one is missing or validation goes by time alone."""
        if self.validation == "mtime" or not job.outputs or not all(self._exists(f"{self.root}/{p}") for p, _ in job.outputs):
            return None
        return sorted((r.path, r.hash) for r in self._outputs_now([p for p, _ in job.outputs], True).collect())

    def _execute(self, job: Job, bodies: dict[str, Body], stopped: Callable[[], bool], executor: Executor | None, remote: RemoteCache | None) -> None:
        rule, params = job.rule, self._values(job)
        if not job.outputs:
            return
        if any(not self._exists(f"{self.root}/{p}") for _, p, _ in job.inputs):
            raise RunError(f"an input of {job.id} is missing")
        targets = [(sinks.confined(self.root, p), form) for p, form in job.outputs]
        if rule.shell is not None or rule.run is not None or rule.script is not None:
            self._program(job, params, stopped)
            return
        if remote is not None and job.key and len(targets) == 1 and (found := remote.fetch(job.key)) is not None:
            sinks.commit(found, *targets[0])
            return
        groups: dict[str, list[DataFrame]] = {}
        for at, (name, path, form) in enumerate(job.inputs):
            df = codecs.read(self.spark, f"{self.root}/{path}", form)
            groups.setdefault(name or f"input{at}", []).append(df)
            if name is None:
                groups.setdefault("input", []).append(df)
        inputs = {}
        for name, parts in groups.items():
            df = parts[0]
            for other in parts[1:]:
                df = df.unionByName(other, allowMissingColumns=True)
            inputs[name] = df
        if executor is not None:
            executor(job, inputs, params)
            return
        if rule.sql is not None:
            text = self._filled(job, rule.sql, quoted=True)
            out = self.spark.sql(text, **inputs) if inputs else self.spark.sql(text)
        else:
            out = bodies[rule.call or rule.name](inputs, params, job.wildcards)
        for (path, form), df in zip(targets, self._returned(job, out), strict=True):
            sinks.commit(df, path, form)
        if remote is not None and job.key and len(targets) == 1:
            remote.store(job.key, codecs.read(self.spark, *targets[0]))

    def _returned(self, job: Job, out: Frames) -> list[DataFrame]:
        """One frame for each output: by name or number from a dict, by place from a list, or the only one."""
        n = len(job.outputs)
        if isinstance(out, dict):
            keys = [[k for k in (ref.name, str(at), at) if k in out] for at, ref in enumerate(job.rule.outputs)]
            if any(not k for k in keys) or len(out) != n:
                raise RunError(f"{job.id} returned {sorted(map(str, out))} for {n} outputs")
            return [out[k[0]] for k in keys]
        frames = list(out) if isinstance(out, (list, tuple)) else [out]
        if len(frames) != n:
            raise RunError(f"{job.id} returned {len(frames)} frames for {n} outputs")
        return frames

    def _program(self, job: Job, params: dict[str, str], stopped: Callable[[], bool]) -> None:
        rule, outputs = job.rule, [p for p, _ in job.outputs]
        given = {"input": [(n, p) for n, p, _ in job.inputs], "output": [(ref.name, p) for p, ref in zip(outputs, rule.outputs, strict=True)], "params": params, "wildcards": job.wildcards, "resources": rule.resources}
        if rule.shell is not None:
            arguments = ["bash", "-euo", "pipefail", "-c", self._filled(job, rule.shell)]
        elif rule.run is not None:
            program = blocks.interpreter(rule.lang)
            arguments = [program, "-c", blocks.preamble(given) + rule.run if program == "python3" else self._filled(job, rule.run)]
        else:
            arguments = [blocks.interpreter(rule.lang, rule.script), rule.script, *[p for _, p, _ in job.inputs], *outputs]
        blocks.execute(arguments, self.root.removeprefix("file://"), outputs, stopped, seconds_of(rule.timeout))

    # gates and snapshots

    def gate_status(self, name: str) -> str:
        """approved, rejected or pending: what was said last."""
        said = self._table("gates", GATES).where(F.col("gate") == name).agg(F.max_by("status", "at")).first()[0]
        return said or "pending"

    def approve(self, name: str, by: str = "", status: str = "approved") -> None:
        if name not in {g.name for g in self.workflow.gates}:
            raise RunError(f"no gate {name!r}")
        self.spark.createDataFrame([(name, status, by, time.time())], GATES).write.mode("append").parquet(f"{self.state}/gates")

    def gates(self) -> DataFrame:
        """(id, gates): the jobs of the plan that a gate keeps from running."""
        jobs = self._settle()
        rows = self.spark.createDataFrame([(j.id, "pending" if j.reason else "completed") for j in jobs.values()], "id string, status string")
        behind = [(g.name, j.id) for g in self.workflow.gates for j in jobs.values() if j.rule.name in g.before]
        known = self.spark.createDataFrame([(g.name, self.gate_status(g.name)) for g in self.workflow.gates], "gate string, status string")
        return graph.gated(rows, known, self.spark.createDataFrame(behind, "gate string, id string"))

    def snapshot(self, name: str) -> None:
        """Keeps the state of the plan's jobs under a name."""
        jobs = self._settle()
        rows = [(j.id, j.rule.name, "pending" if j.reason else "completed", j.key) for j in jobs.values()]
        snapshot.create(self.spark.createDataFrame(rows, "job_id string, rule string, status string, output_hashes string"), f"{self.state}/snapshots", name, time.time())

    def snapshots(self) -> DataFrame:
        return snapshot.listing(*snapshot.kept(self.spark, f"{self.state}/snapshots"))

    def delete_snapshot(self, name: str) -> bool:
        return snapshot.delete(self.spark, f"{self.state}/snapshots", name)

    def compare(self, before: str, after: str) -> DataFrame:
        """The differences of two snapshots."""
        _, jobs = snapshot.kept(self.spark, f"{self.state}/snapshots")
        return snapshot.diff(jobs.where(F.col("snapshot_name") == before), jobs.where(F.col("snapshot_name") == after))

    def history(self) -> DataFrame:
        return self._table("history", HISTORY)

    def touch(self) -> int:
        """Takes all outputs that are there as up to date; the number of jobs that this concerns."""
        jobs = self._settle()
        fresh = [j for j in jobs.values() if j.key and all(self._exists(f"{self.root}/{p}") for p, _ in j.outputs)]
        self._remember(fresh)
        return len(fresh)

    def invalidate(self, rule: str, cascade: bool = False) -> None:
        """Forgets what is cached of a rule's jobs, and with ``cascade`` of those of all rules that take in, by the same
        pattern, what it puts out."""
        jobs, _ = self.graph()
        rules = {rule}
        if cascade:
            frame = self.spark.createDataFrame
            outputs = frame([(r.name, o.pattern) for r in self.workflow.rules for o in r.outputs], "rule string, ref string")
            inputs = frame([(r.name, i.pattern) for r in self.workflow.rules for i in r.inputs], "rule string, ref string")
            rules = {r.id for r in graph.invalidate_cascade(self.spark, outputs, inputs, frame([(rule,)], "id string")).collect()}
        if self._exists(f"{self.state}/cache"):
            mine = [(j.id,) for j in jobs.values() if j.rule.name in rules]
            self._forget(self.spark.createDataFrame(mine, "job_id string"), "job_id")


def call_text(job: Job) -> str:
    """A job's call as text, for explanations."""
    args = [f"{k}={kwarg_literal(v)}" for k, v in {**job.rule.params, **job.wildcards}.items()]
    return f"{job.rule.call or job.rule.name}({', '.join(args)})"


def default_state(root: str) -> str:
    return os.path.join(root, ".loom")
