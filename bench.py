"""Times the headline stages on the benchmark tables and prints one JSON line.

The feeds are derived from the tables and written before the clock starts. Stages read
the tables of the stages before them, as separate runs would. Each is measured once after
a warm-up of the session on the smallest tables. `rows` says how much each worked on.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from edgeloom.operators import actors, candidates, constraints, metrics, pairs, scoring, update, views
from edgeloom.plans.build import Check, Graph
from edgeloom.session import cut_lineage, local_session
from edgeloom.sources import testfeed

SCALE_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
WARM_DIR = "/root/testdata/sf0.001"


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def stages(spark, folder):
    """Name and action of each stage, in order; the actions share what earlier ones built."""
    held = {}
    feed_a, feed_b, names, aliases = (cut_lineage(f(spark, folder)) for f in (testfeed.feed_a, testfeed.feed_b, testfeed.organizations, testfeed.aliases))
    parties = cut_lineage(testfeed.feed_b(spark, folder, parties=True))
    held["rows"] = {"feed_a": feed_a.count(), "feed_b": feed_b.count(), "feed_b_parties": parties.count()}

    def graph():
        return held["graph"]

    def fuse_edges():
        held["graph"] = Graph(feed_a, feed_b, names, aliases, cut=True)
        graph().edges  # writes the edge table

    def timeline(after):
        """All nodes and links of all months."""
        for rows in views.timeline_rows(views.links(after)):
            run(rows)

    def final():
        held["check"] = Check(graph(), candidates.candidates_from_pool(graph().pool))
        held["check"].final

    def graph_update():
        c = held["check"]
        c.conflicts  # written
        c.after  # written
        run(c.decisions)

    def scores():
        g = graph()
        # Counts are built anew: nothing of the pair summary's work is reused here.
        run(constraints.score_constraints(g.intervals, candidates.candidates_from_pool(g.pool), g.weights, pairs.pair_counts(g.intervals)))

    yield "fuse_edges", fuse_edges
    yield "score_edges", lambda: run(graph().scored)
    yield "source_weights", lambda: run(scoring.source_weights(graph().scored))
    yield "month_intervals", lambda: run(graph().interval_table)
    yield "pair_summary", lambda: run(pairs.pair_summary(graph().intervals, pairs.pair_counts(graph().intervals)))
    yield "relation_inventory", lambda: run(graph().inventory)
    yield "candidate_pool", lambda: graph().pool
    yield "constraint_scores", scores
    yield "final_constraints", final
    yield "conflict_detection", lambda: run(update.conflicts(held["check"].sides))
    yield "graph_update", graph_update
    yield "effectiveness", lambda: run(metrics.effectiveness(held["check"].after, held["check"].conflicts))
    yield "method_comparison", lambda: run(metrics.method_metrics(held["check"].methods))
    yield "constraint_quality", lambda: run(metrics.constraint_quality(held["check"].final, held["check"].conflicts, held["check"].after))
    yield "timeline", lambda: timeline(held["check"].after)
    yield "actor_candidates", lambda: run(actors.actor_candidates(actors.actors(
        actors.feed_a_hits(feed_a), actors.feed_b_hits(parties))))

    def counts():
        g, c = graph(), held["check"]
        held["rows"] |= {
            "edges": g.edges.count(), "intervals": g.interval_table.count(), "groups": g.intervals.select("subject_org_id", "object_org_id").distinct().count(),
            "pairs_judged": c.scored.agg(F.sum("instantiation_count")).first()[0], "conflicts": c.conflicts.count(), "updated_edges": c.after.count(),
        }
        return held["rows"]

    yield "rows", counts


def main() -> None:
    spark = local_session("edgeloom-bench", CORES, int(CORES))
    spark.sparkContext.setLogLevel("ERROR")
    for _, action in stages(spark, WARM_DIR):
        action()
    times, rows = {}, {}
    for name, action in stages(spark, SCALE_DIR):
        if name == "rows":
            rows = action()
            continue
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "edgeloom_stages_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rows": rows, "sf": SCALE_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
