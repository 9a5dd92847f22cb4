"""Every query with SQL, side by side with DuckDB over the same tables."""

import duckdb
import pytest

from loomwright.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    return tuple(plain(y) for y in x) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, tiny, name):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    found = db.execute(ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in found.description}
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    assert all(TYPES.get(kind, kinds[c]) == kinds[c] for c, kind in df.dtypes)
    want = sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == want


def test_every_query_but_greedy_admission_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"budget_admission"}
