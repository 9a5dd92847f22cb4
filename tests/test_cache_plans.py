"""Whole tables of keys, paths and hashes never go through the driver."""

import pytest

from loomwright.operators import cache, graph
from loomwright.plans.catalogue import QUERIES


def merges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["cache_lookup_status", "cache_lookup_mtime", "cache_lookup_content", "cache_self_heal"])
def test_lookups_broadcast_nothing(spark, tiny, name):
    assert merges(QUERIES[name](spark, tiny))


def test_what_is_looked_up_for_staleness_is_not_broadcast(spark, tiny, monkeypatch):
    written = []
    monkeypatch.setattr(cache, "materialize", lambda session, df: written.append(df) or df)
    QUERIES["cache_stale_propagation"](spark, tiny)
    assert len(written) == 1 and merges(written[0])


def test_what_goes_stale_downstream_is_not_broadcast(spark, tiny, monkeypatch):
    """As where there are more jobs than are walked on the driver: no level is broadcast, nor is anything in the result."""
    query = QUERIES["cache_stale_propagation"]
    want = sorted(query(spark, tiny).collect())
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    written, count = [], graph.counted
    monkeypatch.setattr(graph, "counted", lambda session, df: written.append(df) or count(session, df))
    found = query(spark, tiny)
    assert len(written) > 2 and all(merges(df) for df in written[1:])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(found.collect()) == want
