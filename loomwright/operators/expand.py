"""From rules and targets to jobs: products and zips of config lists, producers by pattern, backward chaining.

Rules are few and known to the driver, so their patterns become Column expressions: finding the producers of any
number of targets is one projection, without a join."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import guards, patterns
from loomwright.operators import graph
from loomwright.session import materialize


class ExpandError(ValueError):
    """Dimensions or targets that can't be expanded."""


class RuleCycleError(ExpandError, graph.CycleError):
    """Rules that feed each other."""


@dataclass
class RuleSpec:
    """What expansion needs to know of a rule."""

    name: str
    inputs: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    priority: int = 0
    constraints: dict[str, str] = field(default_factory=dict)
    expand: str = "product"
    tags: dict[str, str] = field(default_factory=dict)
    when: dict | None = None


def product(spark: SparkSession, dims: dict[str, list[str]]) -> DataFrame:
    """One row for each combination, the first list outermost; ``n`` has the order.  No list: one empty row."""
    out = spark.range(1).select(F.lit(0).cast("long").alias("n"))
    for name, values in dims.items():
        each = F.posexplode(F.array(*[F.lit(v) for v in values]).cast("array<string>"))
        out = out.select("*", each.alias("_at", name)).withColumn("n", F.col("n") * max(1, len(values)) + F.col("_at")).drop("_at")
    return out


def zipped(spark: SparkSession, dims: dict[str, list[str]]) -> DataFrame:
    """One row for each place in lists of equal length; unequal ones are an error, and empty ones give one empty row."""
    lengths = {k: len(v) for k, v in dims.items()}
    if len(set(lengths.values())) > 1:
        raise ExpandError(f"lists of unequal length: {lengths}")
    if not dims or not next(iter(lengths.values())):
        return spark.range(1).select(F.lit(0).cast("long").alias("n"))
    arrays = [F.array(*[F.lit(v) for v in values]).alias(k) for k, values in dims.items()]
    return spark.range(1).select(F.posexplode(F.arrays_zip(*arrays)).alias("n", "z")).select(F.col("n").cast("long").alias("n"), *[F.col(f"z.`{k}`").alias(k) for k in dims])


def list_of(config: dict, name: str) -> list[str] | None:
    """The config list of a wildcard: by its name, with an s, or without one."""
    for key in (name, f"{name}s", name[:-1] if name.endswith("s") else name):
        value = config.get(key)
        if isinstance(value, list):
            return value
    return None


def bindings(config: dict, names: list[str]) -> dict[str, list[str]] | None:
    """The lists of all wildcards, or None where one has none."""
    found = {n: list_of(config, n) for n in names}
    return None if any(v is None for v in found.values()) else found


def expand_target(spark: SparkSession, text: str, config: dict, how: str = "product", constraints: dict[str, str] | None = None) -> DataFrame:
    """(n, path) of a pattern over the config; a pattern that can't be expanded gives nothing, a value against its
    constraint is an error."""
    pattern = patterns.parse_pattern(patterns.config_substituted(text, config, strict=False))
    dims = bindings(config, pattern.names)
    if dims is None:
        return spark.range(0).select(F.col("id").alias("n"), F.lit("").alias("path"))
    for name, expression in (constraints or {}).items():
        patterns.check_constraint(name, expression)
        bad = [v for v in dims.get(name, []) if not re.fullmatch(expression, v)]
        if bad:
            raise ExpandError(f"{name}={bad[0]!r} is against its constraint {expression!r}")
    rows = (zipped if how == "zip" else product)(spark, dims)
    names = [x for k in dims for x in (F.lit(k), F.col(k))]
    wildcards = F.create_map(*names) if names else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.select("n", patterns.interpolate(pattern, wildcards).alias("path"))


def producers(rules: list[RuleSpec], path: Column) -> Column:
    """All rules whose outputs match a path, as an array of (priority, rule, wildcards); one entry for each rule."""
    found = []
    for rule in sorted(rules, key=lambda r: r.name):
        fits = [patterns.resolve(patterns.parse_pattern(o), path, rule.constraints) for o in rule.outputs]
        if fits:
            found.append(F.struct(F.lit(rule.priority).alias("priority"), F.lit(rule.name).alias("rule"), F.coalesce(*fits).alias("wildcards")))
    if not found:
        return F.array().cast("array<struct<priority:int,rule:string,wildcards:map<string,string>>>")
    return F.filter(F.array(*found), lambda p: p["wildcards"].isNotNull())


def choose(targets: DataFrame, rules: list[RuleSpec], path: str = "path") -> DataFrame:
    """``targets`` with ``rule``, ``wildcards`` and ``error``: the producer with the highest priority; a tie is
    ambiguous, no producer is an error too."""
    found = targets.withColumn("_p", producers(rules, F.col(path)))
    top = F.array_max(F.transform("_p", lambda p: p["priority"]))
    best = found.withColumn("_b", F.filter("_p", lambda p: p["priority"] == top))
    one = F.try_element_at("_b", F.lit(1))
    error = F.when(F.size("_b") == 0, "no producer").when(F.size("_b") > 1, F.concat(F.lit("ambiguous: "), F.array_join(F.transform("_b", lambda p: p["rule"]), ", ")))
    return best.select(*targets.columns, F.when(error.isNull(), one["rule"]).alias("rule"), F.when(error.isNull(), one["wildcards"]).alias("wildcards"), error.alias("error"))


def needs(rule: RuleSpec, config: dict) -> list[tuple[int, Column]]:
    """Each input pattern of a rule as (place, array of paths) over ``wildcards``; wildcards that its outputs don't
    bind are expanded from the config, by product or zip."""
    bound = {n for o in rule.outputs for n in patterns.parse_pattern(o).names}
    out = []
    for at, text in enumerate(rule.inputs):
        pattern = patterns.parse_pattern(text)
        free = [n for n in pattern.names if n not in bound]
        dims = bindings(config, free)
        if dims is None:
            raise ExpandError(f"rule {rule.name}: no values for the wildcards of {text!r}")
        if rule.expand == "zip" and len({len(v) for v in dims.values()}) > 1:
            raise ExpandError(f"rule {rule.name}: lists of unequal length")
        combos: list[dict[str, str]] = [{}]
        if rule.expand == "zip" and dims:
            combos = [dict(zip(dims, row, strict=True)) for row in zip(*dims.values(), strict=True)] or [{}]
        else:
            for name, values in dims.items():
                combos = [{**c, name: v} for c in combos for v in values]
        paths = []
        for combo in combos:
            pieces = tuple(("text", combo[v]) if k == "wild" and v in combo else (k, v) for k, v in pattern.pieces)
            paths.append(patterns.interpolate(patterns.Pattern(text, pieces), F.col("wildcards")))
        out.append((at, F.array(*paths)))
    return out


def resolved(rules: list[RuleSpec], config: dict) -> list[RuleSpec]:
    """The rules with ``{config.X}`` filled in."""

    def sub(texts: list[str]) -> list[str]:
        return [patterns.config_substituted(t, config) for t in texts]

    return [RuleSpec(r.name, sub(r.inputs), sub(r.outputs), r.priority, r.constraints, r.expand, r.tags, r.when) for r in rules]


#: Levels of chaining after which rules are taken to feed each other without end.
MOST_LEVELS = 1000
#: Jobs up to which a table of targets is chained on the driver.
LOCAL_JOBS = 100_000


def chain(spark: SparkSession, rules: list[RuleSpec], config: dict, targets: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Backward chaining from ``targets`` (path): (jobs, needs, sources).

    jobs: job_id, rule, wildcards, level; needs: job_id, place, at, path; sources: paths that exist and no rule makes.
    Where targets and existing paths are few (counted) and no more than ``LOCAL_JOBS`` jobs come of them, they are chained
    on the driver, else by :func:`chain_spread`; both give the same rows and errors."""
    given, there = graph.held(targets, "path"), graph.held(existing, "path") if existing is not None else []
    local = chain_local(rules, config, [p for (p,) in given], {p for (p,) in there}, most=LOCAL_JOBS) if given is not None and there is not None else None
    if local is None:
        return chain_spread(spark, rules, config, targets, existing)
    found, outside = local
    wanted = []
    for job in found.values():
        places: dict[int, int] = {}
        for place, path in job.inputs:
            wanted.append((job.id, place, places.setdefault(place, 0), path))
            places[place] += 1
    frame = spark.createDataFrame
    jobs = frame([(j.id, j.rule, j.wildcards, j.level) for j in found.values()], "job_id string, rule string, wildcards map<string,string>, level int")
    return jobs, frame(wanted, "job_id string, place int, at int, path string"), frame([(p,) for p in sorted(outside)], "path string")


def chain_spread(spark: SparkSession, rules: list[RuleSpec], config: dict, targets: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`chain` over tables: a level of targets is one pass, and targets that were seen before don't come again."""
    rules = resolved(rules, config)
    by_name = {r.name: r for r in rules}
    empty_paths = spark.createDataFrame([], "path string")
    existing = materialize(spark, (existing if existing is not None else empty_paths).select("path").distinct())
    frontier = materialize(spark, targets.select("path").distinct())
    seen, jobs, edges, sources, level = frontier, None, None, None, 0
    while not frontier.isEmpty():
        if level > MOST_LEVELS:
            raise ExpandError(f"more than {MOST_LEVELS} levels: rules feed each other")
        found = materialize(spark, choose(frontier, rules))
        there = found.where("error = 'no producer'").join(existing, "path", "left_semi")
        bad = found.where("error is not null").join(existing, "path", "left_anti").union(found.where("error like 'ambiguous%'")).first()
        if bad:
            raise ExpandError(f"{bad.path}: {bad.error}")
        made = found.where("error is null")
        for rule in rules:
            if rule.when is not None:
                refused = made.where(F.col("rule") == rule.name).where(~guards.as_column(rule.when, F.col("wildcards"), config)).first()
                if refused:
                    raise ExpandError(f"{refused.path}: the guard of {rule.name} is false")
        one = made.select(patterns.job_id(F.col("rule"), F.col("wildcards")).alias("job_id"), "rule", "wildcards").dropDuplicates(["job_id"])
        one = materialize(spark, one.withColumn("level", F.lit(level)))  # the pass in which a job was found
        wanted = None
        for name, rule in by_name.items():
            for at, paths in needs(rule, config):
                part = one.where(F.col("rule") == name).select("job_id", F.lit(at).alias("place"), F.posexplode(paths).alias("at", "path"))
                wanted = part if wanted is None else wanted.unionByName(part)
        wanted = materialize(spark, wanted if wanted is not None else spark.createDataFrame([], "job_id string, place int, at int, path string"))
        jobs = one if jobs is None else jobs.unionByName(one)
        edges = wanted if edges is None else edges.unionByName(wanted)
        sources = there.select("path") if sources is None else sources.unionByName(there.select("path"))
        frontier = materialize(spark, wanted.select("path").distinct().join(seen, "path", "left_anti"))
        seen = seen.unionByName(frontier)
        level += 1
    none = spark.createDataFrame([], "job_id string, rule string, wildcards map<string,string>, level int")
    jobs = none if jobs is None else jobs.drop("level").dropDuplicates(["job_id"])
    edges = edges if edges is not None else spark.createDataFrame([], "job_id string, place int, at int, path string")
    edges = edges.distinct()
    if level:  # the level is the longest distance to a target, which also finds cycles
        jobs = materialize(spark, jobs)
        upstream = graph.reversed_edges(job_edges(outputs_of(rules, config, jobs), edges))
        try:
            placed = graph.levels(spark, jobs.select(F.col("job_id").alias("id")), upstream)
        except graph.CycleError:
            raise RuleCycleError("rules feed each other in a cycle") from None
        jobs = jobs.join(placed.withColumnRenamed("id", "job_id"), "job_id")
    return jobs, edges, (sources if sources is not None else empty_paths).distinct()


def outputs_of(rules: list[RuleSpec], config: dict, jobs: DataFrame) -> DataFrame:
    """job_id, path of each job's outputs."""
    out = None
    for rule in resolved(rules, config):
        mine = jobs.where(F.col("rule") == rule.name)
        for text in rule.outputs:
            part = mine.select("job_id", patterns.interpolate(patterns.parse_pattern(text), F.col("wildcards")).alias("path"))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else jobs.select("job_id", F.lit("").alias("path")).limit(0)


def job_edges(outputs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(from_job, to_job) by equal paths."""
    o, i = outputs.select(F.col("job_id").alias("from_job"), "path"), wanted.select(F.col("job_id").alias("to_job"), "path")
    return o.join(i, "path").select("from_job", "to_job").distinct()


# The same on the driver, for sessions: their jobs are started one by one from there, so their number is bounded by that.


@dataclass
class Planned:
    """A job of :func:`chain_local`: its inputs as (place, path), its outputs, and its distance from the targets."""

    id: str
    rule: str
    wildcards: dict[str, str]
    inputs: list[tuple[int, str]]
    outputs: list[str]
    level: int = 0


def target_paths(text: str, config: dict, how: str = "product") -> list[str]:
    """:func:`expand_target` on the driver."""
    pattern = patterns.parse_pattern(patterns.config_substituted(text, config, strict=False))
    dims = bindings(config, pattern.names)
    return [] if dims is None else [patterns.fill(pattern, c) for c in combinations(dims, how)]


def combinations(dims: dict[str, list[str]], how: str) -> list[dict[str, str]]:
    """All bindings of a product or zip, the first list outermost."""
    if how == "zip" and dims:
        if len({len(v) for v in dims.values()}) > 1:
            raise ExpandError(f"lists of unequal length: { {k: len(v) for k, v in dims.items()} }")
        return [dict(zip(dims, row, strict=True)) for row in zip(*dims.values(), strict=True)] or [{}]
    out: list[dict[str, str]] = [{}]
    for name, values in dims.items():
        out = [{**c, name: v} for c in out for v in values]
    return out


class Producers:
    """Rules by what their output patterns start with, so that a path is matched with few of them."""

    def __init__(self, rules: list[RuleSpec]):
        self.by_head: dict[str, list[tuple[RuleSpec, patterns.Pattern, Callable]]] = {}
        for rule in rules:
            for text in rule.outputs:
                pattern = patterns.parse_pattern(text)
                head = pattern.pieces[0][1] if pattern.pieces and pattern.pieces[0][0] == "text" else ""
                whole = len(pattern.pieces) == 1 and bool(head)
                for name in set(rule.constraints) & set(pattern.names):
                    patterns.check_constraint(name, rule.constraints[name])
                self.by_head.setdefault(head, []).append((rule, pattern, (lambda p, h=head: {} if p == h else None) if whole else self._matcher(pattern, rule.constraints)))
        self.lengths = sorted({len(h) for h in self.by_head})

    @staticmethod
    def _matcher(pattern: patterns.Pattern, constraints: dict[str, str]) -> Callable[[str], dict[str, str] | None]:
        fits = patterns.compiled(pattern, constraints).match
        names = [v for k, v in pattern.pieces if k == "wild"]

        def matched(path: str) -> dict[str, str] | None:
            m = fits(path)
            if m is None:
                return None
            found: dict[str, str] = {}
            for name, value in zip(names, m.groups(), strict=True):
                if found.setdefault(name, value) != value:
                    return None
            return found

        return matched

    def of(self, path: str) -> tuple[RuleSpec, dict[str, str]] | None:
        """The rule with the highest priority that makes a path, and its wildcards; a tie is an error."""
        found: dict[str, tuple[RuleSpec, dict[str, str]]] = {}
        for n in self.lengths:
            if n > len(path):
                break
            for rule, _, matched in self.by_head.get(path[:n], ()):
                if rule.name not in found and (w := matched(path)) is not None:
                    found[rule.name] = (rule, w)
        if not found:
            return None
        top = max(r.priority for r, _ in found.values())
        best = sorted(n for n, (r, _) in found.items() if r.priority == top)
        if len(best) > 1:
            raise ExpandError(f"{path}: ambiguous: {', '.join(best)}")
        return found[best[0]]


def chain_local(rules: list[RuleSpec], config: dict, targets: Iterable[str], existing: set[str], exists: Callable[[str], bool] | None = None, most: int | None = None) -> tuple[dict[str, Planned], set[str]] | None:
    """Backward chaining on the driver: jobs by id, and the paths that come from outside; None for over ``most`` jobs."""
    rules = resolved(rules, config)
    producers_ = Producers(rules)
    plans: dict[str, list[tuple[int, list[patterns.Pattern]]]] = {}
    for rule in rules:
        bound = {n for o in rule.outputs for n in patterns.parse_pattern(o).names}
        plans[rule.name] = []
        for place, text in enumerate(rule.inputs):
            pattern = patterns.parse_pattern(text)
            dims = bindings(config, [n for n in pattern.names if n not in bound])
            if dims is None:
                plans[rule.name].append((place, []))  # an error only where the rule is used
                continue
            combos = combinations(dims, rule.expand)
            plans[rule.name].append((place, [patterns.Pattern(text, tuple(("text", c[v]) if k == "wild" and v in c else (k, v) for k, v in pattern.pieces)) for c in combos]))
    jobs: dict[str, Planned] = {}
    sources: set[str] = set()
    maker: dict[str, str] = {}
    frontier, seen, level = list(dict.fromkeys(targets)), set(), 0
    while frontier:
        if level > MOST_LEVELS:
            raise ExpandError(f"more than {MOST_LEVELS} levels: rules feed each other")
        step: list[str] = []
        for path in frontier:
            seen.add(path)
            found = producers_.of(path)
            if found is None:
                if path not in existing:
                    raise ExpandError(f"{path}: no producer")
                sources.add(path)
                continue
            rule, wildcards = found
            name = patterns.job_id_of(rule.name, wildcards)
            maker[path] = name
            if name in jobs:
                continue
            if most is not None and len(jobs) >= most:
                return None
            if rule.when is not None and not guards.holds(rule.when, wildcards, config, exists=exists):
                raise ExpandError(f"{path}: the guard of {rule.name} is false")
            inputs = []
            for place, shapes in plans[rule.name]:
                if not shapes:
                    raise ExpandError(f"rule {rule.name}: no values for the wildcards of {rule.inputs[place]!r}")
                inputs += [(place, patterns.fill(p, wildcards)) for p in shapes]
            outputs = [patterns.fill(patterns.parse_pattern(o), wildcards) for o in rule.outputs]
            jobs[name] = Planned(name, rule.name, dict(sorted(wildcards.items())), inputs, outputs)
            step += [p for _, p in inputs]
        frontier = [p for p in dict.fromkeys(step) if p not in seen]
        level += 1
    for job in jobs.values():
        for path in job.outputs:
            maker.setdefault(path, job.id)
    _place(jobs, maker)
    return jobs, sources


def _place(jobs: dict[str, Planned], maker: dict[str, str]) -> None:
    """Levels as the longest distance to a target; a job that would be downstream of itself is an error."""
    below: dict[str, set[str]] = {}
    for job in jobs.values():
        for _, path in job.inputs:
            if path in maker:
                below.setdefault(maker[path], set()).add(job.id)
    left = {i: len(below.get(i, ())) for i in jobs}
    todo, done = [i for i, n in left.items() if not n], 0
    while todo:
        job = jobs[todo.pop()]
        done += 1
        for up in {maker[p] for _, p in job.inputs if p in maker}:
            jobs[up].level = max(jobs[up].level, job.level + 1)
            left[up] -= 1
            if not left[up]:
                todo.append(up)
    if done < len(jobs):
        raise RuleCycleError("rules feed each other in a cycle")
