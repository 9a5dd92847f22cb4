import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import mtree

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, asked, k):
    rows = [(i, tuple(np.floor(np.array(v, "f4").astype("f8") * 256).astype(int).tolist())) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in set(rows):
        if asked(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize(("leaf", "shard", "fan", "rows_together"), [(256, 8192, 256, 16_384), (4, 40, 256, 7), (8, 20, 3, 50)])
def test_against_brute_force(spark, leaf, shard, fan, rows_together, monkeypatch):
    monkeypatch.setattr(mtree, "FAN", fan)  # with 3, there are several levels above the trees
    monkeypatch.setattr(mtree, "ROWS", rows_together)
    monkeypatch.setattr(mtree, "LEAF", leaf)
    monkeypatch.setattr(mtree, "SHARD", shard)
    rng = np.random.default_rng(leaf)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * (1 + i % 3) + 0.2 * rng.normal(size=8)).tolist(), 0) for i in range(400)]
    rows += [(500 + i, rows[0][1], 0) for i in range(60)] + [(600, [0.0] * 8, 0), (650, None, 0), (700, [float("nan")] * 8, 0), (701, [None] + [1.0] * 7, 0), (702, [float("inf")] * 8, 0)]
    rows += [(None, [1.0] * 8, 0), (800, [1.0, 2.0], 0), (850, [1.0, -2.0], 0), (0, rows[0][1], 0), (900, [0.001 * j for j in range(8)], 0)]
    rows += [(910, rows[1][1], 0)] * 9 + [(911, rows[1][1], 0)] * 3 + [(100, rows[1][1], 0)] + [(150, rows[7][1], 0)] * 8 + [(920, rows[100][1], 0)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(mtree.nearest_k(spark, df, df.where(F.col("vec_id") % 50 == 0))) == brute(rows, lambda i: i % 50 == 0, 5)


def test_pages_are_avoided_at_any_number(spark, monkeypatch):
    """Clustered vectors: a query visits few of the pages, also where there are several levels of them."""
    monkeypatch.setattr(mtree, "SHARD", 30)
    monkeypatch.setattr(mtree, "FAN", 6)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=16)).tolist(), 0) for i in range(2000)]
    df, told = spark.createDataFrame(rows, SCHEMA), {}
    out = mtree.nearest_k(spark, df, df.where(F.col("vec_id") % 50 == 0), told=told)
    assert got(out) == brute(rows, lambda i: i % 50 == 0, 5)
    assert told["queries"] == 40 and told["trees"] > 60 and told["visits"] < 0.3 * told["queries"] * told["trees"]


def test_search_avoids_distances():
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.repeat(rng.normal(size=(20, 16)), 200, 0) + 3 * rng.normal(size=(4000, 16)))
    tree = mtree.Tree(x, [[i] for i in range(len(x))], float((x * x).sum(1).max()))
    seen = []
    tree.x = type("Counted", (), {"__getitem__": lambda self, rows: (seen.append(len(rows)), x[rows])[1]})()
    found = tree.search(0, x[0], 5, -np.inf)
    scores = x @ x[0]
    assert sorted((-s, i) for s, i in found) == sorted((-scores[i], i) for i in range(1, len(x)))[:5]
    assert sum(seen) < len(x) / 4


def test_empty_and_few(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mtree.nearest_k(spark, df, df).count() == 0
    df = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], SCHEMA)
    assert got(mtree.nearest_k(spark, df, df)) == [(0, 1, 1, 131072), (1, 1, 0, 131072)]


def test_query_against_sql(spark, tiny):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tiny}/embeddings.parquet'")
    assert got(mtree.op8_mtree_top_k(spark, tiny)) == sorted(db.execute(f"SELECT query_id, rank, vec_id, score FROM ({mtree.ORACLE})").fetchall())


def test_a_group_of_queries_goes_on_to_no_more_rows_than_a_page_takes(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD", 20)
    seen, beside = [], mtree.beside
    monkeypatch.setattr(mtree, "beside", lambda *args: seen.append((args[5] == mtree.VISIT, *args[6:])) or beside(*args))
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist(), 0) for i in range(200)], SCHEMA)
    mtree.nearest_k(spark, df, df.where(F.col("vec_id") % 50 == 0))
    assert [x[1] * mtree.FAN <= mtree.ROWS for x in seen if x[0]] and all(len(x) == 2 for x in seen if x[0])


def test_a_written_page_takes_two_bytes_for_a_number_of_two():
    x = np.floor(256 * np.random.default_rng(4).normal(size=(2000, 64)))
    tree = mtree.Tree(x, [[i] for i in range(len(x))], float((x * x).sum(1).max()))
    written = mtree.pickle.dumps(tree)
    again = mtree.pickle.loads(written)
    assert len(written) < 5 * x.size and again.x.dtype == x.dtype and (again.x == x).all()
    assert sorted(again.search(7, x[7], 5, -np.inf)) == sorted(tree.search(7, x[7], 5, -np.inf))
