"""Four ways to treat contradictions, on one common evidence base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.constants import FEED_A, FEED_B, HIGH_EVIDENCE, LOW_EVIDENCE
from edgeloom.functions.codes import relation_light
from edgeloom.functions.parse import action_or_keep, to_double, to_flag
from edgeloom.sources.columns import find_column, resolve

GROUP = ("subject_org_id", "object_org_id", "event_month")


def evidence(edges: DataFrame, confidence: tuple[str, ...] = ("final_confidence", "confidence", "score")) -> dict[str, Column]:
    """Cross-source, high and low evidence of an edge, by a chosen confidence column."""
    value = to_double(resolve(edges, confidence, F.lit(0.0)))
    sources = F.upper(F.coalesce(resolve(edges, ("source_datasets", "sources", "source_dataset", "source"), F.lit("")), F.lit("")))

    def count(names: tuple[str, ...], feed: str) -> Column:
        found = find_column(edges, names)
        return to_double(found) if found else F.when(sources.contains(feed), 1.0).otherwise(0.0)

    cross = (count(("icews_event_count", "icews_count"), FEED_A) > 0) & (count(("gdelt_event_count", "gdelt_count"), FEED_B) > 0)
    return {
        "evidence_confidence": value,
        "is_cross_source": cross,
        "is_high_evidence": cross | (value >= HIGH_EVIDENCE),
        "is_low_evidence": ~cross & (value < LOW_EVIDENCE),
    }


def evidence_group() -> Column:
    return F.when(F.col("is_high_evidence"), "high").when(F.col("is_low_evidence"), "low").otherwise("middle")


def evidence_base(edges: DataFrame) -> DataFrame:
    """Edges with the columns every method needs and nothing else."""
    return edges.withColumns(evidence(edges)).select(
        "edge_id", *GROUP, relation_light("relation_type").alias("relation_type"),
        to_double(resolve(edges, ("event_count",), F.lit(0))).alias("events"),
        "evidence_confidence", "is_cross_source", "is_high_evidence", "is_low_evidence",
    ).withColumn("evidence_group", evidence_group())


def _result(base: DataFrame, method: str, action: Column, triggered: Column, reason: Column) -> DataFrame:
    return base.select(
        F.lit(method).alias("method"), "edge_id", *GROUP, "relation_type", "evidence_confidence",
        "is_cross_source", "is_high_evidence", "is_low_evidence", "evidence_group",
        action.alias("action"), triggered.alias("triggered"), reason.alias("reason"),
    )


def keep_all(base: DataFrame) -> DataFrame:
    return _result(base, "keep_all", F.lit("keep"), F.lit(False), F.lit(""))


def relation_variety(base: DataFrame) -> DataFrame:
    """Distinct relations per subject, object and month."""
    return base.groupBy(*GROUP).agg(F.count_distinct("relation_type").alias("relations"))


def single_relation(base: DataFrame) -> DataFrame:
    """One relation per subject, object and month: the most confident edge stays, the others are filtered.

    Variety and the best edge come from windows over one partitioning of at
    most 20 edges each, so nothing is joined back.
    """
    group = Window.partitionBy(*GROUP)
    best = group.orderBy(F.desc("evidence_confidence"), F.desc("events"), F.asc("edge_id"))
    seen = base.withColumns({
        "_several": F.min("relation_type").over(group) != F.max("relation_type").over(group),
        "_rank": F.row_number().over(best),
    })
    several = F.col("_several")
    return _result(
        seen, "single_relation", F.when(several & (F.col("_rank") > 1), "filtered").otherwise("keep"), several,
        F.when(several, "same_subject_object_month_multi_relation").otherwise(""),
    )


def all_pairs(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every candidate pair enforced as it is: of two edges in conflict the less confident (on a tie the later id) is filtered.

    No edge pairs are built. A window shows each edge the relations, confidences
    and ids of its group (at most 20); each constraint then compares the edge
    with the other side's entries.
    """
    ordered = pairs.select(F.least("relation_a", "relation_b").alias("p"), F.greatest("relation_a", "relation_b").alias("q")).where("p <> q").distinct()
    rivals = ordered.select(F.col("p").alias("own"), F.col("q").alias("rival")).unionByName(
        ordered.select(F.col("q").alias("own"), F.col("p").alias("rival"))
    ).groupBy("own").agg(F.collect_set("rival").alias("rivals"))
    group = Window.partitionBy(*GROUP)
    entry = F.struct("relation_type", "evidence_confidence", "edge_id")
    # Candidate pairs are bounded by the relation pairs, so at most 20 rows here.
    marked = base.join(F.broadcast(rivals), F.col("relation_type") == F.col("own"), "left")
    seen = marked.withColumn("_group", F.collect_list(F.when(F.col("rivals").isNotNull(), entry)).over(group))
    met = F.filter("_group", lambda x: F.array_contains("rivals", x["relation_type"]))
    mine, my_id = F.col("evidence_confidence"), F.col("edge_id")

    def beats(x: Column) -> Column:
        return (x["evidence_confidence"] > mine) | ((x["evidence_confidence"] == mine) & (x["edge_id"] < my_id))

    judged = seen.withColumns({
        "_met": F.coalesce(F.size(met) > 0, F.lit(False)),
        "_lost": F.coalesce(F.exists(met, beats), F.lit(False)),
    })
    return _result(
        judged, "all_pairs", F.when(F.col("_lost"), "filtered").otherwise("keep"), F.col("_met"),
        F.when(F.col("_met"), "candidate_pair_triggered").otherwise(""),
    )


def actual_update(base: DataFrame, after: DataFrame) -> DataFrame:
    """The real update result, on the evidence known before it."""
    action = action_or_keep(resolve(after, ("update_action", "after_check_status", "status"), F.lit("keep")))
    flag = find_column(after, ("is_mutex_triggered", "mutex_triggered", "triggered"))
    triggered = to_flag(flag) if flag else action != "keep"
    outcome = after.select("edge_id", action.alias("_action"), triggered.alias("_triggered")).groupBy("edge_id").agg(
        F.first("_action").alias("_action"), F.first("_triggered").alias("_triggered")
    )
    joined = base.join(outcome, "edge_id", "left")
    return _result(
        joined, "constraint_update", F.coalesce("_action", F.lit("keep")), F.coalesce("_triggered", F.lit(False)),
        F.lit("actual_output"),
    )


def compare_methods(edges_before: DataFrame, pairs: DataFrame, edges_after: DataFrame | None = None) -> DataFrame:
    """All methods' results as one long table."""
    base = evidence_base(edges_before)
    result = keep_all(base).unionByName(single_relation(base)).unionByName(all_pairs(base, pairs))
    return result if edges_after is None else result.unionByName(actual_update(base, edges_after))
