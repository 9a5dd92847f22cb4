"""Exact top-k by inner product with M-trees and best-first search.

Vectors become integers, floor(256 * x).  With M the longest norm, o' = (o, sqrt(M*M - |o|^2)) and q' = (q, 0) turn the
inner product into a distance, |q' - o'|^2 = |q|^2 + M*M - 2 q.o, so a metric tree gives exact answers: a bound on the
distance is a bound on the score.

Equal vectors are one entry with their ``k + 1`` smallest ids (each as often as it is there, ``k`` times at most); no
other id of theirs can be among a query's best.  All entries begin as one page for each length; a page of more than
``SHARD`` entries is split among pivots drawn from a bounded sample of it, entry by entry to the nearest, until no page is
larger, so pages grow in number with the data and never hold rows that chance put together.  A page is an M-tree: paged
nodes with covering radii and parent distances.  The pages above it are nodes of the same kind (up to ``FAN`` children
with centre and covering radius), kept as rows of a table, one table for each level, so no list of pages has to fit
anywhere.

Search takes nodes by their best possible score and avoids computing distances by |d(q, parent) - d(o, parent)|.  Each
query first searches its home page; the k-th score found there is where its descent through the upper nodes starts, and
no page or node that can't reach it is visited, at any size.  Queries of one page are dealt out in groups of ``ROWS``,
each with a copy of it, so no page is one task, however many queries reach it; those of one node in groups of
``ROWS // FAN``, as each of them may go on to all of its children.  Pages that are written are checked for their size row by
row, and hold their integers in as few bytes as they need.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of different lengths
aren't compared; every row is a candidate, so a repeated row is one as often as it is there; equal queries (vec_id and
vector) are one query, and one vec_id with several vectors is a query for each; rows with the query's vec_id are its
own; rows with a null vec_id take no part; ties go to the smaller vec_id; sums are exact up to 2^53.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.session import materialize, table

K, EVERY = 5, 50
#: Entries of a page at most, pivots that a page is split among at most, rows of it that they are drawn from.
SHARD, FAN, PICK = 8192, 256, 1024
#: Entries of a leaf within a page, children of a node within a page.
LEAF, FANOUT = 256, 8
#: Rows that go to a page together; a group of queries and a node make no more rows than this either.
ROWS = 16_384
#: A page is a row of up to some MB; Parquet's writer looks only at every 100th row else, and readers take what it wrote at once.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double with integer values) of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where("vec_id is not null and embedding is not null").where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def pivots_of(x: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first choice, from the row nearest to the mean."""
    first = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    chosen, near = [first], ((x - x[first]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)) and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


class Tree:
    """Nodes by number; node 0 is the root.  A leaf has entries (row, distance to the node's pivot), another node has
    routing entries (child, pivot, covering radius, distance to the node's pivot)."""

    def __init__(self, x: np.ndarray, ids: list[list[int]], norm: float):
        self.x, self.ids = x, ids
        self.full = np.c_[x, np.sqrt(np.maximum(norm - (x * x).sum(1), 0))]
        self.norm, self.nodes = norm, []
        self._build(np.arange(len(x)), pivots_of(self.full, 1)[0])
        del self.full

    def __getstate__(self) -> dict:
        kind = next((t for t in ("i1", "i2", "i4") if not len(self.x) or np.abs(self.x).max() <= np.iinfo(t).max), "f8")
        return vars(self) | {"x": self.x.astype(kind)}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state | {"x": state["x"].astype("f8")})

    def _build(self, rows: np.ndarray, pivot: int) -> int:
        number = len(self.nodes)
        self.nodes.append(None)
        to_pivot = np.sqrt(((self.full[rows] - self.full[pivot]) ** 2).sum(1))
        chosen = rows[pivots_of(self.full[rows], FANOUT)] if len(rows) > LEAF else []
        if len(chosen) < 2:  # few rows
            self.nodes[number] = (True, rows, to_pivot)
            return number
        own = np.argmin(distances(self.full[rows], self.full[chosen]), 1)
        kids, radii, parent, heads = [], [], [], []
        for c, head in enumerate(chosen):
            part = rows[own == c]
            if not len(part):
                continue
            # rows that are too close to tell apart stay in one leaf of any size, which a tree's size bounds
            radii.append(float(np.sqrt(((self.full[part] - self.full[head]) ** 2).sum(1)).max()))
            parent.append(float(np.sqrt(((self.full[head] - self.full[pivot]) ** 2).sum())))
            heads.append(self.full[head])
            kids.append(self._leaf(part, head) if len(part) == len(rows) else self._build(part, head))
        self.nodes[number] = (False, np.array(kids), np.array(heads), np.array(radii), np.array(parent))
        return number

    def _leaf(self, rows: np.ndarray, pivot: int) -> int:
        self.nodes.append((True, rows, np.sqrt(((self.full[rows] - self.full[pivot]) ** 2).sum(1))))
        return len(self.nodes) - 1

    def search(self, own: int, q: np.ndarray, k: int, least: float) -> list[tuple[float, int]]:
        """The k best (score, id), of those with a score of ``least`` or more; ties to smaller ids."""
        best: list[tuple[float, int]] = []  # a heap of (score, -id)
        qq, full = float(q @ q), np.append(q, 0.0)
        total = qq + self.norm
        slack = 1e-9 * (1 + total)

        def reach(score: float) -> float:
            """Largest distance at which a score can still be reached."""
            return float(np.sqrt(max(total - 2 * score + slack, 0))) if score > -np.inf else np.inf

        limit = reach(least)
        queue: list[tuple[float, int, float]] = [(0.0, 0, np.nan)]  # best possible distance, node, distance to its pivot
        while queue and queue[0][0] <= limit:
            _, number, to_pivot = heapq.heappop(queue)
            node = self.nodes[number]
            if node[0]:
                _, rows, parent = node
                if to_pivot == to_pivot:
                    rows = rows[np.abs(parent - to_pivot) <= limit]
                scores = self.x[rows] @ q
                for at in np.flatnonzero(scores >= least) if len(rows) else ():
                    score = float(scores[at])
                    for one in self.ids[rows[at]]:
                        if one != own and score >= least:
                            if len(best) < k:
                                heapq.heappush(best, (score, -one))
                            elif (score, -one) > best[0]:
                                heapq.heapreplace(best, (score, -one))
                            if len(best) == k and best[0][0] > least:
                                least = best[0][0]
                                limit = reach(least)
                continue
            _, kids, heads, radii, parent = node
            keep = np.arange(len(kids)) if to_pivot != to_pivot else np.flatnonzero(np.abs(parent - to_pivot) - radii <= limit)
            if len(keep):
                to_head = np.sqrt(((heads[keep] - full) ** 2).sum(1))
                lowest = np.maximum(to_head - radii[keep], 0)
                for c, low, d in zip(kids[keep].tolist(), lowest.tolist(), to_head.tolist(), strict=True):
                    if low <= limit:
                        heapq.heappush(queue, (low, c, d))
        return [(s, -i) for s, i in best]


def beside(spark: SparkSession, rows: DataFrame, pages: DataFrame, key: list[str], function: Callable, schema: str, group: int | None = None) -> DataFrame:
    """``function`` (some rows of a page, the page) -> frame, for all ``rows`` (page and more) beside ``pages`` (page and
    more; one row each).  Rows of one page are dealt by ``key`` into groups of about ``group`` (else ``ROWS``)."""
    parts = materialize(spark, rows.groupBy("page").agg(F.ceil(F.count("*") / (group or ROWS)).cast("int").alias("parts")))
    asked = rows.join(parts, "page").withColumn("salt", F.pmod(F.xxhash64(*key), F.col("parts")).cast("int")).drop("parts")
    held = pages.join(parts, "page").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return asked.groupBy("page", "salt").cogroup(held.groupBy("page", "salt")).applyInPandas(function, schema)


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("f8") if len(vectors) else np.zeros((0, 0))


def folded(vectors: DataFrame, k: int) -> DataFrame:
    """page (its length), v, ids of the distinct vectors."""
    rows = whole(vectors).groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    first = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)  # group limits apply before the shuffle
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "n"))), lambda x: F.array_repeat(x["vec_id"], x["n"])))
    return kept.groupBy("v").agg(ids.alias("ids")).withColumn("page", F.size("v").cast("string"))


def pivots_for(pages: DataFrame, big: DataFrame) -> DataFrame:
    """page, pivots of the pages in ``big`` (page, n), from the ``PICK`` entries with the smallest hashes."""
    drawn = pages.join(big, "page").withColumn("h", F.xxhash64("v", "page")).where(F.pmod("h", F.lit(1 << 20)) < 4 * PICK / F.col("n") * (1 << 20))
    least = drawn.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("h", "v"))).where(F.col("place") <= PICK)

    def chosen(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        x = stacked(part["v"])[: max(2, min(FAN, -(-2 * int(part["n"].iloc[0]) // SHARD)))]
        return pd.DataFrame({"page": part["page"].iloc[:1], "pivots": [x.tobytes()]})

    return least.select("page", "v", "n", "place").groupBy("page").applyInPandas(chosen, "page string, pivots binary")


def descended(spark: SparkSession, rows: DataFrame, pivots: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` (page, v and more) with the page of their nearest pivot where their page has pivots."""
    split = pivots.select("page")
    names = rows.columns

    def nearest(part: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        if len(part) and len(page):
            x = stacked(part["v"])
            p = np.frombuffer(page["pivots"].iloc[0], "f8").reshape(-1, x.shape[1])
            part = part.assign(page=[f"{at}/{c}" for at, c in zip(part["page"], np.argmin(distances(x, p), 1), strict=True)])
        return part[names]

    schema = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ", len(names))
    moved = beside(spark, rows.join(split, "page", "left_semi"), pivots, key, nearest, schema)
    return rows.join(split, "page", "left_anti").unionByName(moved)


def divided(spark: SparkSession, entries: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``entries`` with pages of up to ``SHARD``, and the pivots of each level that they were split by."""
    pages, levels = materialize(spark, entries), []
    while True:
        big = materialize(spark, pages.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") > SHARD))
        if big.isEmpty():
            return pages, levels
        levels.append(materialize(spark, pivots_for(pages, big)))
        pages = materialize(spark, descended(spark, pages, levels[-1], ["v"]))


def upper(spark: SparkSession, trees: DataFrame, depth: int) -> list[DataFrame]:
    """The nodes above the trees, level by level from the top: page, node (children, centres, radii, which are trees)."""

    def node(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("page")
        x, radius, n = stacked(part["centre"]), part["radius"].to_numpy(), part["n"].to_numpy()
        centre = (x * n[:, None]).sum(0) / n.sum()
        reach = float((np.sqrt(((x - centre) ** 2).sum(1)) + radius).max())
        own = pickle.dumps((part["page"].tolist(), x, radius, part["leaf"].tolist()))
        return pd.DataFrame({"page": part["parent"].iloc[:1], "node": [own], "centre": [centre.tolist()], "radius": [reach], "n": [int(n.sum())]})

    steps = F.size(F.split("page", "/")) - 1
    known = trees.select("page", "centre", "radius", "n", F.lit(True).alias("leaf"))
    levels, made = [], None
    for level in range(depth - 1, -1, -1):
        below = known.where(steps == level + 1)
        if made is not None:
            below = below.unionByName(made.select("page", "centre", "radius", "n", F.lit(False).alias("leaf")))
        parents = below.withColumn("parent", F.regexp_replace("page", "/[^/]*$", ""))
        made = materialize(spark, parents.groupBy("parent").applyInPandas(node, "page string, node binary, centre array<double>, radius double, n long"), LARGE_ROWS)
        levels.insert(0, made.select("page", "node"))
    return levels


VISIT = "query_id long, q long, v array<double>, home string, least double, page string, leaf boolean"


def nearest_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K, told: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of ``vectors`` (vec_id, embedding) for each row of ``queries``.  ``told``
    gets the numbers of trees, queries and trees visited."""
    entries = materialize(spark, folded(vectors, k))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    norms = {r.d: r.m for r in entries.groupBy(F.size("v").alias("d")).agg(F.max(square).alias("m")).collect()}  # a row for each length
    pages, levels = divided(spark, entries)

    def built(part: pd.DataFrame) -> pd.DataFrame:
        x = stacked(part["v"])
        order = np.argsort([i[0] for i in part["ids"]])
        tree = Tree(x[order], [list(map(int, part["ids"].iloc[i])) for i in order], norms[x.shape[1]])
        centre = x.mean(0)
        return pd.DataFrame({"page": part["page"].iloc[:1], "tree": [pickle.dumps(tree)], "centre": [centre.tolist()], "radius": [float(np.sqrt(((x - centre) ** 2).sum(1)).max())], "n": [len(x)]})

    trees = materialize(spark, pages.groupBy("page").applyInPandas(built, "page string, tree binary, centre array<double>, radius double, n long"), LARGE_ROWS)

    def scored(part: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(part) and len(page):
            tree = pickle.loads(page["tree"].iloc[0])
            for query, q, v, least in zip(part["query_id"], part["q"], part["v"], part["least"], strict=True):
                out += [(int(query), int(q), one, int(score)) for score, one in tree.search(int(query), np.asarray(v, "f8"), k, least)]
        return pd.DataFrame(out, columns=["query_id", "q", "vec_id", "score"]).astype("int64")

    key, grown = ["query_id", "q"], trees.select("page", "tree")
    found_as = "query_id long, q long, vec_id long, score long"
    asked = whole(queries).distinct().select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("q"), "v", F.size("v").cast("string").alias("page"))
    homes = materialize(spark, asked)
    for pivots in levels:
        homes = materialize(spark, descended(spark, homes, pivots, key))
    found = materialize(spark, beside(spark, homes.withColumn("least", F.lit(float("-inf"))), grown, key, scored, found_as))
    rank = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    if levels:
        least = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") == k).select(*key, F.col("score").cast("double").alias("least"))

        def reached(part: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
            if not len(part) or not len(page):
                return pd.DataFrame(columns=[c.split()[0] for c in VISIT.split(", ")]).astype({"query_id": "int64", "q": "int64", "least": "float64", "leaf": "bool"})
            children, centres, radii, leaves = pickle.loads(page["node"].iloc[0])
            x = stacked(part["v"])
            most = x @ centres.T + np.sqrt((x * x).sum(1))[:, None] * radii  # no inner product within a radius is larger
            fit = most + 1e-6 * (1 + np.abs(most)) >= part["least"].to_numpy()[:, None]
            fit &= part["home"].to_numpy()[:, None] != np.array(children, object)
            row, child = np.nonzero(fit)
            out = part[["query_id", "q", "v", "home", "least"]].iloc[row]
            return out.assign(page=np.array(children, object)[child], leaf=np.array(leaves, bool)[child])

        started = homes.withColumnRenamed("page", "home").join(least, key, "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        visits = started.select("query_id", "q", "v", "home", "least", F.size("v").cast("string").alias("page"))
        far = []
        for nodes in upper(spark, trees, len(levels)):
            met = materialize(spark, beside(spark, visits, nodes, key, reached, VISIT, max(1, ROWS // FAN)))
            far.append(met.where("leaf"))
            visits = met.where(~F.col("leaf")).drop("leaf")
        others = far[0]
        for more in far[1:]:
            others = others.unionByName(more)
        if told is not None:
            told["visits"] = others.count() + homes.count()
        found = found.unionByName(beside(spark, others.drop("leaf"), grown, key, scored, found_as))
    if told is not None:
        told |= {"trees": trees.count(), "queries": homes.count()} | ({} if levels else {"visits": homes.count()})
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_k(spark, vectors, vectors.where(F.col("vec_id") % EVERY == 0))


#: The same over DuckDB.
ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.e, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % {EVERY} = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
