"""Workflow files: TOML with config, rules, gates, includes and profiles, read on the driver into plain objects."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from loomwright.functions import guards, patterns
from loomwright.functions.parsing import kwarg_literal
from loomwright.operators.expand import RuleSpec


class WorkflowError(ValueError):
    """A workflow file that can't be read."""


@dataclass(frozen=True)
class FileRef:
    """An input or output pattern with its optional name, format and policies."""

    pattern: str
    name: str | None = None
    format: str | None = None
    lifecycle: str = "persistent"
    materialize: str = "auto"


@dataclass
class Rule:
    name: str
    inputs: list[FileRef] = field(default_factory=list)
    outputs: list[FileRef] = field(default_factory=list)
    sql: str | None = None
    call: str | None = None
    tags: dict[str, str] = field(default_factory=dict)
    params: dict[str, str] = field(default_factory=dict)
    param_files: list[str] = field(default_factory=list)
    resources: dict[str, str] = field(default_factory=dict)
    constraints: dict[str, str] = field(default_factory=dict)
    when: dict | None = None
    expand: str = "product"
    priority: int = 0
    retries: int = 1
    backoff: str = "constant"
    on_error: str = "terminate"
    timeout: str | None = None
    description: str = ""
    benchmark: str | None = None
    executor: str | None = None
    shell: str | None = None
    run: str | None = None
    script: str | None = None
    lang: str | None = None
    env: str | dict | None = None

    def spec(self) -> RuleSpec:
        return RuleSpec(self.name, [i.pattern for i in self.inputs], [o.pattern for o in self.outputs], self.priority, self.constraints, self.expand, self.tags, self.when)

    @property
    def source(self) -> str:
        """The text that stands for the rule's body, before a job's values are filled in."""
        for kind in ("sql", "shell", "run", "script"):
            if getattr(self, kind) is not None:
                return f"{kind}:{self.lang or ''}:{getattr(self, kind)}" if kind in ("run", "script") else f"{kind}:{getattr(self, kind)}"
        params = ", ".join(f"{k}={kwarg_literal(v)}" for k, v in sorted(self.params.items()))
        return f"call:{self.call}({params})" if self.call else "none"


@dataclass
class Gate:
    name: str
    after: list[str]
    before: list[str]
    message: str = ""


@dataclass
class Workflow:
    config: dict[str, str | list[str]] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    gates: list[Gate] = field(default_factory=list)
    profiles: dict[str, dict[str, str | list[str]]] = field(default_factory=dict)
    base: str = "."

    def rule(self, name: str) -> Rule:
        return next(r for r in self.rules if r.name == name)


def text_of(value) -> str:
    """Every config value, parameter and tag is text; booleans are lower case."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def read_dimension(path: str, key: str, columns: list[str] | None = None) -> dict[str, list[str]]:
    """Ordered-distinct, non-empty lists from a small delimited file: tab if its header has one, else comma.  No quoting."""
    with open(path, encoding="utf-8") as file:
        lines = file.read().splitlines()
    if not lines or not lines[0].strip():
        raise WorkflowError(f"{path} is empty")
    by = "\t" if "\t" in lines[0] else ","
    header = [h.strip() for h in lines[0].split(by)]
    out = {}
    for column in [key, *(columns or [])]:
        if column not in header:
            raise WorkflowError(f"{path} has no column {column!r} (it has {', '.join(header)})")
        at = header.index(column)
        cells = [[c.strip() for c in line.split(by)] for line in lines[1:] if line.strip()]
        out[column] = list(dict.fromkeys(c[at] for c in cells if len(c) > at and c[at]))
    return out


def dimension_frame(spark: SparkSession, path: str, key: str) -> DataFrame:
    """:func:`read_dimension` for a large file that Spark reads: (value, first_row) in order of first occurrence."""
    from pyspark.sql import functions as F

    first = spark.read.text(path).first()
    by = "\t" if first and "\t" in first[0] else ","
    rows = spark.read.csv(path, sep=by, header=True).select(F.trim(F.col(f"`{key}`")).alias("value"), F.monotonically_increasing_id().alias("row"))
    return rows.where("value <> ''").groupBy("value").agg(F.min("row").alias("first_row")).orderBy("first_row")


def refs_of(value) -> list[FileRef]:
    """``"a"``, ``["a", {path = ..}]`` or ``{name = "a"}``."""
    if value is None:
        return []
    if isinstance(value, str):
        return [FileRef(value)]
    items = [(None, v) for v in value] if isinstance(value, list) else list(value.items())
    out = []
    for name, one in items:
        for v in one if isinstance(one, list) else [one]:
            if isinstance(v, str):
                out.append(FileRef(v, name))
            elif isinstance(v, dict) and "path" in v:
                out.append(FileRef(v["path"], v.get("name", name), v.get("format"), v.get("lifecycle", "persistent"), v.get("materialize", "auto")))
            else:
                raise WorkflowError(f"not a file pattern: {v!r}")
    return out


def rule_of(name: str, raw: dict) -> Rule:
    if sum(raw.get(kind) is not None for kind in ("sql", "call", "shell", "run", "script")) > 1:
        raise WorkflowError(f"rule {name} has more than one body")
    if raw.get("when") is not None:
        guards.check(raw["when"])
    for ref in [*refs_of(raw.get("input")), *refs_of(raw.get("output"))]:
        patterns.parse_pattern(re.sub(r"\{config\.\w+\}", "config", ref.pattern))
    strategy = raw.get("error_strategy", "terminate")
    retry = strategy if isinstance(strategy, dict) else {}
    kind = retry.get("strategy", "retry") if retry else str(strategy)
    if kind not in ("terminate", "retry", "ignore", "finish"):
        kind = "terminate"
    attempts = int(raw.get("retries", retry.get("count", 1)))
    return Rule(
        name,
        refs_of(raw.get("input")),
        refs_of(raw.get("output")),
        raw.get("sql"),
        raw.get("call"),
        {k: text_of(v) for k, v in raw.get("tags", {}).items()},
        {k: text_of(v) for k, v in raw.get("params", {}).items()},
        list(raw.get("param_files", [])),
        {k: text_of(v) for k, v in raw.get("resources", {}).items()},
        dict(raw.get("wildcard_constraints", {})),
        raw.get("when"),
        raw.get("expand", "product"),
        int(raw.get("priority", 0)),
        max(1, attempts),
        retry.get("backoff", "constant"),
        "retry" if attempts > 1 and kind == "terminate" else kind,
        raw.get("timeout"),
        raw.get("description", ""),
        raw.get("benchmark"),
        raw.get("executor"),
        raw.get("shell"),
        raw.get("run"),
        raw.get("script"),
        raw.get("lang"),
        raw.get("env"),
    )


def parse_workflow(text: str, base: str = ".", seen: tuple[str, ...] = ()) -> Workflow:
    """A workflow from TOML.  Includes are merged, the including file wins; config file sources are read."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise WorkflowError(str(e)) from None
    out = Workflow(base=base)
    for name in raw.get("include", []):
        path = os.path.normpath(os.path.join(base, name))
        if path in seen:
            raise WorkflowError(f"{path} includes itself")
        with open(path, encoding="utf-8") as file:
            part = parse_workflow(file.read(), os.path.dirname(path) or ".", (*seen, path))
        out.config |= part.config
        out.rules += part.rules
        out.gates += part.gates
        out.profiles |= part.profiles
    for key, value in raw.get("config", {}).items():
        if isinstance(value, dict):
            lists = read_dimension(os.path.join(base, value["source"]), value["key"], value.get("columns"))
            out.config[key] = lists.pop(value["key"])
            out.config |= lists
        else:
            out.config[key] = [text_of(v) for v in value] if isinstance(value, list) else text_of(value)
    names = set()
    for name, value in sorted(raw.get("rule", {}).items()):
        names.add(name)
        out.rules = [r for r in out.rules if r.name != name] + [rule_of(name, value)]
    out.rules.sort(key=lambda r: r.name)
    out.gates += [Gate(n, list(g.get("after", [])), list(g.get("before", [])), g.get("message", "")) for n, g in sorted(raw.get("gate", {}).items())]
    out.profiles |= {n: {k: [text_of(x) for x in v] if isinstance(v, list) else text_of(v) for k, v in p.items()} for n, p in raw.get("profile", {}).items()}
    return out


def read_workflow(path: str) -> Workflow:
    with open(path, encoding="utf-8") as file:
        return parse_workflow(file.read(), os.path.dirname(path) or ".", (os.path.normpath(path),))


def with_overrides(workflow: Workflow, overrides: dict[str, str], profile: str | None = None) -> Workflow:
    """Config with a profile's values and then ``key = value`` settings: a comma makes a list, and a single value for
    a key that has a list makes a list of one."""
    config = dict(workflow.config)
    if profile is not None:
        if profile not in workflow.profiles:
            raise WorkflowError(f"no profile {profile!r}")
        config |= workflow.profiles[profile]
    for key, value in overrides.items():
        if "," in value:
            config[key] = [v.strip() for v in value.split(",")]
        else:
            config[key] = [value] if isinstance(config.get(key), list) else value
    return replace(workflow, config=config)


def default_targets(workflow: Workflow) -> list[str]:
    """Patterns of the rule ``all``, or else of the first by name: its inputs if it has no outputs."""
    rule = next((r for r in workflow.rules if r.name == "all"), workflow.rules[0] if workflow.rules else None)
    return [] if rule is None else [f.pattern for f in rule.outputs or rule.inputs]


def rules_frame(spark: SparkSession, workflow: Workflow) -> DataFrame:
    """The rules as a table."""
    rows = [(r.name, [i.pattern for i in r.inputs], [o.pattern for o in r.outputs], r.source, r.tags, r.params, r.priority, r.expand) for r in workflow.rules]
    return spark.createDataFrame(rows, "name string, inputs array<string>, outputs array<string>, source string, tags map<string,string>, params map<string,string>, priority int, expand string")
