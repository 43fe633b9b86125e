"""Registered queries against their SQL counterparts on the smallest tables, and the entry contract."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connection

SMALL = "/root/testdata/sf0.001"
CHECKED = (
    "fused_edges", "daily_log", "actor_candidates", "name_predicates", "month_parse", "merged_interval_pairs", "pair_examples",
    "interval_ids", "instance_ids", "source_evidence", "fuzzy_merged", "feed_scan", "stream_log", "all_instances", "timeline_links", "timeline_nodes", "review_sample", "hidden_sample", "alignment_sample", "response_extraction",
    "constraint_scores", "decisions", "edge_updates", "method_evidence", "constraint_quality", "timeline", "graph_query",
)


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SMALL, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_invariants_of_an_update(spark):
    """Counts that must agree across the result tables."""
    from edgeloom.catalog import queries as q

    c = q.check(spark, SMALL, manual=True)
    after, found, log = c.after, c.conflicts, c.decisions
    assert log.count() == 2 * found.count()
    assert after.count() == c.graph.scored.count()
    scores = c.scored
    assert scores.where("support_count + negative_count <> instantiation_count").isEmpty()
    assert scores.where("before_count + after_count + meet_count <> support_count").isEmpty()
    assert scores.where("abs(structural_confidence + violation_rate - 1) > 1e-5 and instantiation_count > 0").isEmpty()
    m = q.method_metrics(spark, SMALL)
    assert m.where("kept_edges + changed_edges <> total_edges").isEmpty()


def test_one_window_over_edges(spark):
    """Conflicts, decisions and updated edges are read from one staged frame."""
    from edgeloom.catalog import queries as q

    c = q.check(spark, SMALL, manual=True)
    for frame in (c.entries, c.sides, c.decisions):
        assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()
