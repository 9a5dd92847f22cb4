"""Queries over whole tables against formulas in plain Python."""

from collections import Counter

from loomwright.plans.catalogue import QUERIES


def parts(spark, tiny):
    return [r.p_partkey for r in spark.read.parquet(f"{tiny}/part.parquet").collect()]


def edges_of(keys):
    return {(k // n, k) for k in keys for n in (2, 3) if k // n < k}


def status(k):
    if k % 10 == 3:
        return "miss"
    for place in (0, 1):
        if (k + place) % 11 == 5:
            return "miss"
        if (k + place) % 7 == 2:
            return "missing"
        if k % 3 == 0 and k % 13 == 4:
            return "mismatch"
    return "hit"


def test_every_job_that_is_not_a_hit_makes_those_below_it_stale(spark, tiny):
    keys = parts(spark, tiny)
    want = {k: status(k) for k in keys if status(k) != "hit"}
    below = set(want)
    while more := {t for f, t in edges_of(keys) if f in below} - below:
        below |= more
    want |= {k: "upstream" for k in below - set(want)}
    rows = [tuple(r) for r in QUERIES["cache_stale_propagation"](spark, tiny).select("id", "reason").collect()]
    assert len(rows) == len(want) and dict(rows) == want
    assert set(Counter(want.values())) == {"miss", "missing", "mismatch", "upstream"}


def test_orphans_have_no_edge_in_the_whole_table(spark, tiny):
    linked = {x for e in edges_of(parts(spark, tiny)) for x in e}
    orders = {r.o_orderkey for r in spark.read.parquet(f"{tiny}/orders.parquet").collect()}
    rows = [r.id for r in QUERIES["graph_orphans"](spark, tiny).collect()]
    assert sorted(rows) == sorted((orders | set(parts(spark, tiny))) - linked) and rows
