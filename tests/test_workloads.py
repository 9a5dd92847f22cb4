"""Transforms of arrays against DuckDB, to the bit."""

import struct

import duckdb
import pytest

from loomwright.operators import workloads as w
from loomwright.plans.catalogue import ORACLES, QUERIES

ODD = [None, 0.0, -0.0, -1e-8, 1e-8, 2e-7, -2e-7, 6e-7, -6e-7, 0.0390625, -0.0390625, 1e30, -1e30, float("inf"), float("-inf"), float("nan")]


def bits(values):
    return values if values is None else [x if x is None or x != x else struct.pack("d", x) for x in values]


def same_as_sql(spark, folder, rows, name):
    """Whether a query over embeddings has its SQL's rows; NaN counts as NaN, -0.0 not as 0.0."""
    path = str(folder / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = {k: bits(v) for k, v in db.execute(f"SELECT vec_id, v FROM ({ORACLES[name]})").fetchall()}
    got = {r.vec_id: bits(r.v) for r in QUERIES[name](spark, str(folder)).collect()}
    assert str(got) == str({k: want[k] for k in got}) and got.keys() == want.keys()


def test_scaled_arrays_keep_the_sign_of_what_rounds_to_nothing(spark, tmp_path):
    same_as_sql(spark, tmp_path, [(0, ODD), (1, [-1e-8, 0.25]), (2, []), (3, None)], "w_array_scale")


@pytest.mark.parametrize("digits", [0, 6])
def test_rounded_is_duckdbs_round(spark, digits):
    values = [x for x in ODD if x is not None] + [0.49999999999999994, 0.5, -0.5, 1.5, -2.5, 1.0000005, -1.0000005, 4.35e-5, 1.7e308, -4503599627370497.0]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(w.rounded(w.F.col("x"), digits)).collect()]
    want = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), ?)", [x, digits]).fetchone()[0] for x in values]
    assert str(bits(found)) == str(bits(want))


def test_tree_means_keep_the_sign_of_what_rounds_to_nothing(spark, tmp_path):
    same_as_sql(spark, tmp_path, [(k, [-1e-8, 0.25, x]) for k, x in enumerate([0.5, None, -0.0, 1.0, -0.0, -0.0])], "w_tree_mean")


def test_tree_means_of_arrays_that_are_not_pairs(spark, tmp_path):
    one = [(0, None), (1, [1.0]), (2, [2.0]), (3, None), (8, None), (9, None), (12, None), (16, [1.0, 2.0]), (17, [3.0]), (20, []), (24, [1.0]), (28, [5.0]), (29, [7.0])]
    below = [(-1, [3.0]), (-9, [4.0]), (-10, [6.0]), (2**62 + 1, [1.0]), (2**62, [2.0]), (None, [1.0]), (None, None)]
    same_as_sql(spark, tmp_path, one + below, "w_tree_mean")
