"""Constraints applied to edges: conflicts, decisions and updated edges.

All three come from one frame of edges with their conflicts, which a plan writes once
(`plans/build.py`), so one window shuffles the edges. Edges are placed by (subject, object, month);
a window tells each edge which relations its group holds, and a broadcast join
hands it the constraints on its own relation. No edge is ever paired with
another, and nothing is joined back: an edge carries its own list of conflicts.
Later grouping keys contain the placement, so Spark keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.constants import (
    ACTION_LABELS,
    ACTION_SEVERITY,
    ACTION_STATUS,
    DOWNGRADE_FACTOR,
    HIDE_FACTOR,
    LEGACY_ACTION,
    LEGACY_DECISION,
    LEGACY_FINAL_SOURCE,
    RELATION_LABELS,
)
from edgeloom.functions.codes import relation_light
from edgeloom.functions.parse import clean_text, derived_flag, lookup, month_prefix, to_double
from edgeloom.operators.scoring import source_profile
from edgeloom.sources.columns import resolve

GROUP = ("subject_org_id", "object_org_id", "event_month")
SCORES = ("structural_confidence", "source_weighted_confidence", "violation_rate", "auto_filter_status", "candidate_level")


def prepare_edges(edges: DataFrame) -> DataFrame:
    """Edges with normalized codes and months and the original confidence."""
    return edges.withColumns({
        "relation_type": relation_light("relation_type"),
        "event_month": month_prefix("event_month"),
        "original_confidence": to_double(resolve(edges, ("confidence", "final_confidence", "score"), F.lit(0.0))),
    })


CONSTRAINT_FIELDS = (
    "constraint_seq", "constraint_id", "constraint_key", "constraint_name", "relation_a", "relation_b", "final_status",
    "expected_action", "reason", *SCORES,
)


def usable_constraints(final: DataFrame) -> DataFrame:
    """Constraints in force by the relation they ask about, in id order: one row per relation with the list of its
    constraints and the other relation of each. Bounded by the relation pairs."""
    order = Window.orderBy("constraint_id")
    rows = final.where("use_for_review and relation_a <> '' and relation_b <> '' and relation_a <> relation_b").select(
        F.row_number().over(order).alias("constraint_seq"),
        "constraint_id", "constraint_key", "constraint_name", "relation_a", "relation_b", "final_status",
        F.col("proposed_action").alias("expected_action"), F.col("proposed_reason").alias("reason"), *SCORES,
    )
    sides = F.array(
        F.struct(F.lit("a").alias("side"), F.col("relation_a").alias("own"), F.col("relation_b").alias("other")),
        F.struct(F.lit("b").alias("side"), F.col("relation_b").alias("own"), F.col("relation_a").alias("other")),
    )
    entry = F.struct(*CONSTRAINT_FIELDS, "side", "other")
    return rows.select("*", F.inline(sides)).groupBy("own").agg(F.array_sort(F.collect_list(entry)).alias("constraints"))


def edge_action(final_status: Column, expected: Column, derived: Column, cross: Column, low: Column) -> Column:
    """What one constraint does to one edge."""
    cautious = F.when(low, "hide_low_evidence").otherwise("mark_mixed")
    softer = F.when(low, "downgrade").otherwise("mark_mixed")
    return (
        F.when(final_status == "enabled_for_mark_mixed", "mark_mixed")
        .when((final_status != "enabled_for_update") | ~derived, "review")
        .when(cross, "mark_mixed")
        .when(expected == "hide", cautious)
        .when(expected == "downgrade", "downgrade")
        .when(expected == "mark_mixed_or_downgrade", softer)
        .otherwise("mark_mixed")
    )


def severity(action: Column | str) -> Column:
    return lookup(action, ACTION_SEVERITY, F.lit(0))


def edge_entries(edges: DataFrame, final: DataFrame) -> DataFrame:
    """All edges, each with the constraints it conflicts with (`entries`) and what they do to it, in order.

    An edge is in conflict with a constraint when its relation is one side and
    its group holds the other. Edges are unique per subject, object, month and
    relation, so a window partition holds at most 20 of them.
    """
    prepared = prepare_edges(edges)
    profile = source_profile(prepared, "original_confidence")
    derived = derived_flag(resolve(prepared, ("is_derived_relation", "derived", "is_derived"), F.lit("true")))
    rows = prepared.withColumns({
        "cross_source": profile["cross_source"], "low_evidence": profile["low_evidence"], "derived": derived,
        "_held": F.collect_set("relation_type").over(Window.partitionBy(*GROUP)),
    })
    joined = rows.join(F.broadcast(usable_constraints(final)), F.col("relation_type") == F.col("own"), "left")
    met = F.when(F.col("event_month") != "", F.filter("constraints", lambda c: F.array_contains("_held", c["other"])))

    def with_action(c: Column) -> Column:
        action = edge_action(c["final_status"], c["expected_action"], F.col("derived"), F.col("cross_source"), F.col("low_evidence"))
        return F.struct(*[c[f].alias(f) for f in (*CONSTRAINT_FIELDS, "side")], action.alias("update_action"))

    return joined.withColumn("entries", F.transform(met, with_action)).drop("_held", "own", "constraints")


def edge_sides(entries: DataFrame) -> DataFrame:
    """One row per edge and constraint in conflict."""
    return entries.select(
        "edge_id", *GROUP, "relation_type", "original_confidence", "cross_source", "low_evidence", "derived", F.inline("entries")
    )


def conflicts(sides: DataFrame) -> DataFrame:
    """One row per constraint, subject, object and month where both relations occur; the strongest action stands for it."""
    constraint = (
        "constraint_id", "constraint_key", "constraint_name", "relation_a", "relation_b", "final_status",
        "expected_action", *SCORES, "reason",
    )

    def ids(side: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("edge_id")))), ";")

    first = F.struct("side", "edge_id")
    grouped = sides.groupBy(*GROUP, "constraint_id").agg(
        *[F.first(c).alias(c) for c in constraint if c != "constraint_id"],
        ids("a").alias("edge_ids_a"), ids("b").alias("edge_ids_b"),
        F.max_by("update_action", F.struct(severity("update_action"), first)).alias("conflict_action"),
    )
    return grouped.select(
        *constraint[:3], *GROUP, "relation_a", "relation_b", "edge_ids_a", "edge_ids_b", "final_status",
        "conflict_action", "expected_action", *SCORES, "reason",
    ).withColumnRenamed("event_month", "month")


def fold_actions(steps: Column, start: Column, factor: float = DOWNGRADE_FACTOR) -> Column:
    """Actions applied in order to a confidence.

    An action at least as severe as the current one replaces it; a downgrade
    then multiplies by the factor, a hide by the factor but at most a half. Each
    step is rounded to six places. Returns the final action, the final
    confidence and the confidence after every step.
    """
    hide = min(factor, HIDE_FACTOR)

    def step(acc: Column, action: Column) -> Column:
        applies = severity(action) >= severity(acc["action"])
        scale = F.when(action == "downgrade", factor).when(action.isin("hide", "hide_low_evidence"), hide)
        scaled = F.when(applies & scale.isNotNull(), F.round(acc["confidence"] * scale, 6)).otherwise(acc["confidence"])
        return F.struct(
            F.when(applies, action).otherwise(acc["action"]).alias("action"),
            scaled.alias("confidence"),
            F.concat(acc["history"], F.array(scaled)).alias("history"),
        )

    zero = F.struct(
        F.lit("keep").alias("action"), start.alias("confidence"), F.array().cast("array<double>").alias("history")
    )
    return F.aggregate(steps, zero, step)


def _outcome(factor: float) -> Column:
    steps = F.transform(F.coalesce("entries", F.array()), lambda e: e["update_action"])
    return fold_actions(steps, F.col("original_confidence"), factor)


def decisions(entries: DataFrame, factor: float = DOWNGRADE_FACTOR) -> DataFrame:
    """Log with one row per edge and constraint: the action asked for and the confidence after it."""
    return entries.where(F.size("entries") > 0).withColumn("_outcome", _outcome(factor)).select(
        *GROUP, "edge_id", "relation_type", "original_confidence", "_outcome", F.posexplode("entries").alias("position", "e")
    ).select(
        F.col("e.constraint_id").alias("constraint_id"), F.col("e.constraint_key").alias("constraint_key"),
        "subject_org_id", "object_org_id", F.col("event_month").alias("month"), "edge_id", "relation_type",
        F.col("e.final_status").alias("final_status"), F.col("e.update_action").alias("update_action"),
        "original_confidence", F.element_at("_outcome.history", F.col("position") + 1).alias("final_confidence"),
        F.col("e.reason").alias("reason"), *[F.col(f"e.{c}").alias(c) for c in SCORES],
    )


def _joined_unique(part) -> Column:
    texts = F.filter(F.transform("entries", part), lambda x: x != "")
    return F.coalesce(F.array_join(F.array_distinct(texts), ";"), F.lit(""))


def updated_edges(entries: DataFrame, factor: float = DOWNGRADE_FACTOR) -> DataFrame:
    """All edges with the outcome of their conflicts; untouched ones are kept as they are."""
    return entries.withColumn("_outcome", _outcome(factor)).withColumns({
        "is_mutex_triggered": F.coalesce(F.size("entries") > 0, F.lit(False)),
        "update_action": F.col("_outcome.action"),
        "after_check_status": lookup(F.col("_outcome.action"), ACTION_STATUS),
        "final_confidence": F.col("_outcome.confidence"),
        "update_reason": _joined_unique(lambda e: clean_text(e["reason"])),
        "triggered_constraint_ids": _joined_unique(lambda e: clean_text(e["constraint_id"])),
        "triggered_constraint_keys": _joined_unique(lambda e: clean_text(e["constraint_key"])),
        "triggered_mutex_relations": _joined_unique(lambda e: F.concat_ws("-", e["relation_a"], e["relation_b"])),
    }).drop("_outcome", "entries", "cross_source", "low_evidence", "derived")


# ---- older column names ---------------------------------------------------------

def legacy_edges(after: DataFrame) -> DataFrame:
    """Updated edges with the older status, action and label columns added."""
    hidden = F.col("after_check_status").isin("hidden", "removed") | F.col("update_action").isin("hide", "hide_low_evidence")
    return after.withColumns({
        "status": F.when(hidden, "hidden").otherwise("active"),
        "check_action": lookup(F.col("update_action"), LEGACY_ACTION),
        "check_reason": F.col("update_reason"),
        "triggered_constraints": F.col("triggered_constraint_keys"),
        "relation_type_label": lookup(F.col("relation_type"), RELATION_LABELS),
        "update_action_label": lookup(F.col("update_action"), ACTION_LABELS),
    })


def legacy_conflicts(found: DataFrame) -> DataFrame:
    action = F.coalesce(F.nullif(lookup(clean_text("conflict_action"), LEGACY_ACTION), F.lit("")), F.lit("review"))
    return found.withColumns({
        "action": action, "check_action": action, "triggered_constraints": F.col("constraint_key"),
    })


def legacy_constraints(final: DataFrame) -> DataFrame:
    decision = F.coalesce(F.nullif(lookup(clean_text("final_status"), LEGACY_DECISION), F.lit("")), F.lit("disabled"))
    return final.withColumns({
        "source": F.lit(LEGACY_FINAL_SOURCE), "hard_or_soft": F.col("proposed_hard_or_soft"), "enabled": F.col("is_enabled"),
        "final_decision": decision, "final_reason": F.col("proposed_reason"), "reason": F.col("proposed_reason"),
        "forbidden_relation": F.col("forbidden_temporal_relation"),
    })
