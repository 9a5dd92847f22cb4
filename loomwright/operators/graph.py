"""Graph queries over an edge table (from_job, to_job): closures, paths, levels, critical path, readiness and checks.

Edges are read once.  A graph of up to ``LOCAL_EDGES`` edges (counted, not guessed: one row more is asked for) is
walked on the driver, as a session's is, with no Spark job for a level.  A larger one is written once and goes level by
level with an anti-join on what has been seen, so diamonds cost no more than once; each level is written to the shared
folder, which cuts the lineage and survives lost executors, and only counts come to the driver.  Both ways give the
same rows.  Ids are numbers or texts, not null.

Closures don't leave it to Spark what to broadcast: it goes by the size of files, and a small file of ids holds many rows,
all of which would pass through the driver."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import counted, discard, materialize

#: Edges (and nodes, and seeds) up to which a graph is walked on the driver: about 20 MB there.
LOCAL_EDGES = 200_000
#: Levels after which what has been seen is written anew as one set of files.
COMPACT = 8


class CycleError(ValueError):
    """A graph that has no topological order."""


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("to_job").alias("from_job"), F.col("from_job").alias("to_job"))


def held(df: DataFrame, *names: str) -> list[tuple] | None:
    """The rows of a small table, or None if it has more than ``LOCAL_EDGES``."""
    found = df.select(*names).limit(LOCAL_EDGES + 1).toArrow()
    if found.num_rows > LOCAL_EDGES:
        return None
    return list(zip(*(found.column(n).to_pylist() for n in names), strict=True))


def framed(spark: SparkSession, like: DataFrame, column: str, names: list[str], rows: Iterable[tuple]) -> DataFrame:
    """Rows of (id, number, ..) as a frame; ids have the type of ``column`` in ``like``."""
    rows = list(rows)
    ids = like.select(column).schema[0].dataType.simpleString()
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    arrays = [pa.array(list(c), kinds.get(ids, pa.int64()) if n == "id" else pa.int32()) for n, c in zip(names, columns, strict=True)]
    return spark.createDataFrame(pa.table(arrays, names))


def successors(edges: list[tuple]) -> dict:
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    return out


def closure(spark: SparkSession, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, depth) of all nodes downstream of ``seeds`` (id), without these, with the distance in edges."""
    near, start = held(edges, "from_job", "to_job"), held(seeds, "id")
    if near is None or start is None:
        return closure_spread(spark, materialize(spark, edges.select("from_job", "to_job")), seeds)
    below, depth = successors(near), 0
    frontier = {i for (i,) in start}
    seen = dict.fromkeys(frontier, 0)
    while frontier:
        depth += 1
        frontier = {t for f in frontier for t in below.get(f, ()) if t not in seen}
        seen |= dict.fromkeys(frontier, depth)
    return framed(spark, seeds, "id", ["id", "depth"], ((i, d) for i, d in seen.items() if d))


def by_rows(df: DataFrame, rows: int) -> DataFrame:
    """One side of a join, with its number of rows (counted): broadcast up to ``LOCAL_EDGES``, else sorted and merged."""
    return F.broadcast(df) if rows <= LOCAL_EDGES else df.hint("merge")


def closure_spread(spark: SparkSession, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """:func:`closure` level by level; ``edges`` is a written table."""
    frontier, n = counted(spark, seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    seen, known, depth = frontier, n, 0
    while True:
        depth += 1
        step = edges.join(by_rows(frontier.select(F.col("id").alias("from_job")), n), "from_job").select(F.col("to_job").alias("id")).distinct()
        frontier, n = counted(spark, step.join(by_rows(seen.select("id"), known), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if not n:
            return seen.where("depth > 0")
        seen, known = seen.unionByName(frontier), known + n
        if depth % COMPACT == 0:
            seen = materialize(spark, seen)


def deps(spark: SparkSession, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """What ``seeds`` need, directly or not."""
    return closure(spark, reversed_edges(edges), seeds)


def rdeps(spark: SparkSession, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """What needs ``seeds``, directly or not."""
    return closure(spark, edges, seeds)


def with_seeds(found: DataFrame, seeds: DataFrame) -> DataFrame:
    return found.select("id").unionByName(seeds.select("id")).distinct()


def all_paths(spark: SparkSession, edges: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """All nodes on any path from ``start`` to ``end``, with both."""
    return with_seeds(rdeps(spark, edges, start), start).join(with_seeds(deps(spark, edges, end), end), "id", "left_semi")


def levels(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): the longest distance from a root; a topological order is by level, then id.

    Nodes whose upstream nodes are all placed are peeled off, so each edge counts once; where nothing can be peeled and
    nodes are left, there is a cycle.  Edges between nodes that aren't in ``nodes`` don't count."""
    near, mine = held(edges, "from_job", "to_job"), held(nodes, "id")
    if near is None or mine is None:
        return levels_spread(spark, nodes, edges)
    return framed(spark, nodes, "id", ["id", "level"], placed({i for (i,) in mine}, successors(near)).items())


def placed(nodes: set, below: dict) -> dict:
    """The level of each node on the driver."""
    left = dict.fromkeys(nodes, 0)
    for f, ts in below.items():
        for t in ts:
            if f in left and t in left:
                left[t] += 1
    frontier, level, out = [i for i, n in left.items() if not n], 0, {}
    while frontier:
        out |= dict.fromkeys(frontier, level)
        step = []
        for f in frontier:
            for t in below.get(f, ()):
                if t in left:
                    left[t] -= 1
                    if not left[t]:
                        step.append(t)
        frontier, level = step, level + 1
    if len(out) < len(nodes):
        raise CycleError("the graph has a cycle")
    return out


def levels_spread(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """:func:`levels` with one write of what is left for each level."""
    nodes = materialize(spark, nodes.select("id").distinct())
    known = edges.select("from_job", "to_job").distinct().join(nodes.withColumnRenamed("id", "from_job"), "from_job", "left_semi").join(nodes.withColumnRenamed("id", "to_job"), "to_job", "left_semi")
    edges = materialize(spark, known)
    into = edges.groupBy(F.col("to_job").alias("id")).agg(F.count("*").alias("n"))
    left, n = counted(spark, nodes.join(into, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    found, level = None, 0
    while n:
        frontier, peeled = counted(spark, left.where("n = 0").select("id", F.lit(level).alias("level")))
        if not peeled:
            raise CycleError("the graph has a cycle")
        met = frontier.select(F.col("id").alias("from_job")).join(edges, "from_job").groupBy(F.col("to_job").alias("id")).agg(F.count("*").alias("met"))
        after, n = counted(spark, left.where("n > 0").join(met, "id", "left").select("id", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n")))
        discard(spark, left)
        left, level = after, level + 1
        found = frontier if found is None else found.unionByName(frontier)
        if level % COMPACT == 0:
            found = materialize(spark, found)
    return found if found is not None else nodes.withColumn("level", F.lit(0))


def critical_path(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(position, id): a longest path from its root; among equals the smallest id, going back from the end."""
    near, mine = held(edges, "from_job", "to_job"), held(nodes, "id")
    if near is None or mine is None:
        return critical_path_spread(spark, nodes, edges)
    below = successors(near)
    level = placed({i for (i,) in mine}, below)
    before: dict = {}
    for f, ts in below.items():
        for t in ts:
            if f in level and t in level and level[f] == level[t] - 1:
                before[t] = min(f, before.get(t, f))
    path = []
    if level:
        at = min(level, key=lambda i: (-level[i], i))
        while at is not None:
            path.append((level[at], at))
            at = before.get(at)
    return framed(spark, nodes, "id", ["position", "id"], sorted(path))


def critical_path_spread(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """:func:`critical_path` by pointer doubling: as many rounds as the path's length has binary digits."""
    placed_ = materialize(spark, levels_spread(spark, nodes, edges))
    a, b = placed_.select(F.col("id").alias("from_job"), F.col("level").alias("l")), placed_.select(F.col("id").alias("to_job"), "level")
    jump = materialize(spark, edges.join(a, "from_job").join(b, "to_job").where("l = level - 1").groupBy(F.col("to_job").alias("id")).agg(F.min("from_job").alias("up")))
    jumps = [jump]
    last = placed_.orderBy(F.desc("level"), "id").limit(1)
    for _ in range((placed_.agg(F.max("level")).first()[0] or 0).bit_length() - 1):
        jump = materialize(spark, jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("further")), "up").select("id", F.col("further").alias("up")))
        jumps.append(jump)
    path = materialize(spark, last.select("id"))
    for jump in reversed(jumps):
        path = materialize(spark, path.unionByName(path.join(jump, "id").select(F.col("up").alias("id"))).distinct())
    return path.join(placed_, "id").select(F.col("level").alias("position"), "id")


def ready(jobs: DataFrame, edges: DataFrame, satisfied: list[str]) -> DataFrame:
    """Pending jobs of which every upstream job is satisfied."""
    unmet = edges.join(jobs.where(~F.col("status").isin(*satisfied)).select(F.col("id").alias("from_job")), "from_job").select(F.col("to_job").alias("id"))
    return jobs.where("status = 'pending'").join(unmet, "id", "left_anti")


def bridged(spark: SparkSession, edges: DataFrame, skipped: DataFrame) -> DataFrame:
    """Edges between jobs that aren't skipped, where chains of skipped jobs count as one edge."""
    gone, edges = materialize(spark, skipped.select("id").distinct()), materialize(spark, edges.select("from_job", "to_job"))
    live = edges.join(gone.withColumnRenamed("id", "from_job"), "from_job", "left_anti")
    frontier = materialize(spark, live.select("from_job", "to_job").distinct())
    done, seen = None, frontier
    while True:
        inside = frontier.join(gone.withColumnRenamed("id", "to_job"), "to_job", "left_semi")
        outside = frontier.join(gone.withColumnRenamed("id", "to_job"), "to_job", "left_anti").select("from_job", "to_job")
        done = outside if done is None else done.unionByName(outside)
        step = inside.select("from_job", F.col("to_job").alias("via")).join(edges.select(F.col("from_job").alias("via"), "to_job"), "via").select("from_job", "to_job").distinct()
        frontier, n = counted(spark, step.join(seen, ["from_job", "to_job"], "left_anti"))
        if not n:
            return done.distinct()
        seen = materialize(spark, seen.unionByName(frontier))


def in_cycles(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Nodes that stay when roots and leaves are peeled off again and again: those on cycles or between two."""
    near = held(edges, "from_job", "to_job")
    if near is not None:
        below, above = successors(near), successors([(t, f) for f, t in near])
        stay = _peeled(_peeled(below.keys() | above.keys(), above, below), below, above)
        return framed(spark, edges, "from_job", ["id"], ((i,) for i in stay))
    left, n = counted(spark, edges.select("from_job", "to_job").distinct())
    while n:
        inner = left.join(left.select(F.col("to_job").alias("from_job")).distinct(), "from_job", "left_semi").join(left.select(F.col("from_job").alias("to_job")).distinct(), "to_job", "left_semi")
        kept, m = counted(spark, inner.select("from_job", "to_job"))
        if m == n:
            break
        discard(spark, left)
        left, n = kept, m
    return left.select(F.explode(F.array("from_job", "to_job")).alias("id")).distinct()


def _peeled(nodes: Iterable, into: dict, out: dict) -> set:
    """``nodes`` without those that, again and again, have nothing in ``into``."""
    stay = set(nodes)
    left = {i: sum(u in stay for u in into.get(i, ())) for i in stay}
    todo = [i for i, n in left.items() if not n]
    while todo:
        one = todo.pop()
        stay.discard(one)
        for t in out.get(one, ()):
            if t in stay:
                left[t] -= 1
                if not left[t]:
                    todo.append(t)
    return stay


def gated(jobs: DataFrame, gates: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, gates) of the pending ``jobs`` (id, status) that wait for a gate: those with a block (gate, id) of a gate
    (gate, status) that isn't approved; a gate that isn't known blocks too."""
    shut = blocks.join(gates.where("status = 'approved'").select("gate"), "gate", "left_anti")
    waiting = shut.join(jobs.where("status = 'pending'").select("id"), "id", "left_semi")
    return waiting.groupBy("id").agg(F.array_sort(F.collect_set("gate")).alias("gates"))


def invalidate_cascade(spark: SparkSession, outputs: DataFrame, inputs: DataFrame, rules: DataFrame) -> DataFrame:
    """(id) of ``rules`` (id) and all rules that take in, by the same pattern text, what one of them puts out, directly or
    not: what an invalidation that cascades forgets."""
    return with_seeds(rdeps(spark, linked(outputs, inputs), rules), rules)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    return nodes.select("id").join(edges.select(F.explode(F.array("from_job", "to_job")).alias("id")), "id", "left_anti")


def shadows(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Outputs (rule, ref) that no rule takes in."""
    return outputs.join(inputs.select("ref"), "ref", "left_anti")


def conflicts(outputs: DataFrame) -> DataFrame:
    """References that more than one rule puts out."""
    return outputs.groupBy("ref").agg(F.count_distinct("rule").alias("producers")).where("producers > 1")


def self_overlaps(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Rules that take in what they put out."""
    return outputs.join(inputs, ["rule", "ref"], "left_semi").select("rule", "ref").distinct()


def linked(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Edges by equal references: (from_job, to_job) for each output that a job takes in."""
    o, i = outputs.select(F.col("rule").alias("from_job"), "ref"), inputs.select(F.col("rule").alias("to_job"), "ref")
    return o.join(i, "ref").where("from_job <> to_job").select("from_job", "to_job").distinct()


def sources(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """References that no job puts out."""
    return inputs.select("ref").join(outputs.select("ref"), "ref", "left_anti").distinct()


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"))
    return n.withColumn("edges", F.lit(e.first()[0]).cast("long"))


def rendered(edges: DataFrame, how: str = "dot") -> DataFrame:
    """The edges as one text: dot, mermaid or json.  For graphs that a reader can take in."""
    line = {"dot": F.format_string('  "%s" -> "%s";', F.col("from_job").cast("string"), F.col("to_job").cast("string")), "mermaid": F.format_string("  %s --> %s", F.col("from_job").cast("string"), F.col("to_job").cast("string")), "json": F.to_json(F.struct("from_job", "to_job"))}[how]
    head, tail, between = {"dot": ("digraph {\n", "\n}", "\n"), "mermaid": ("graph LR\n", "", "\n"), "json": ("[", "]", ",")}[how]
    lines = F.transform(F.array_sort(F.collect_list(F.struct("from_job", "to_job", line.alias("line")))), lambda x: x["line"])
    return edges.agg(F.concat(F.lit(head), F.array_join(lines, between), F.lit(tail)).alias("text"))
