"""Counts, rates and distributions over edges, conflicts, constraints and methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.constants import (
    FEED_A,
    FEED_B,
    FILTER_ACTIONS,
    FORCED_ACTIONS,
    METHOD_PROCESSED_ACTIONS,
    PROCESSED_ACTIONS,
    QUALITY_STATUS_ORDER,
    RELATION_LABELS,
    UPDATE_STATUSES,
    WEAK_STATUSES,
)
from edgeloom.functions.codes import relation_light
from edgeloom.functions.parse import clean_text, list_text, lookup, percent_text, ratio, to_double, to_flag
from edgeloom.operators.baselines import evidence, evidence_group
from edgeloom.sources.columns import find_column, resolve


def long_form(row: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """One-row table to metric and value rows, values as text."""
    entries = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in row.columns])
    return row.select(F.inline(entries))


# ---- summaries ------------------------------------------------------------------

def organization_scale(organizations: DataFrame, aliases: DataFrame) -> DataFrame:
    orgs = organizations.agg(F.count(F.lit(1)).alias("organization_count"))
    named = aliases.agg(
        F.count(F.lit(1)).alias("alias_count"), F.count_distinct("org_id").alias("organizations_with_alias_count")
    )
    return orgs.join(F.broadcast(named))  # one row each


def in_feed(feed: str) -> Column:
    return F.coalesce(F.col("source_datasets"), F.lit("")).contains(feed)


def source_class() -> Column:
    """cross, a, b or none, from the source list of an edge."""
    return (
        F.when(in_feed(FEED_A) & in_feed(FEED_B), "cross").when(in_feed(FEED_A), "a_only")
        .when(in_feed(FEED_B), "b_only").otherwise("none")
    )


def fusion_summary(before: DataFrame, scored: DataFrame, after: DataFrame) -> DataFrame:
    """Edge counts of the three stages, in one row."""
    kind = source_class()
    first = before.agg(
        F.count(F.lit(1)).alias("edges_before_check"),
        F.count_if(kind == "b_only").alias("gdelt_only_edges"),
        F.count_if(kind == "a_only").alias("icews_only_edges"),
        F.count_if(kind == "cross").alias("cross_source_edges"),
    )
    second = scored.agg(F.count(F.lit(1)).alias("edges_scored"))
    third = after.agg(
        F.count(F.lit(1)).alias("edges_after_check"),
        F.count_if(F.col("status") == "hidden").alias("hidden_edges"),
        F.count_if(F.col("status") == "active").alias("active_edges"),
        F.count_if(F.col("check_action") == "mark_complex").alias("mixed_relation_edges"),
    )
    return first.join(F.broadcast(second)).join(F.broadcast(third))  # one row each


def constraint_summary(final: DataFrame) -> DataFrame:
    return final.agg(
        F.count(F.lit(1)).alias("final_constraints"), F.count_if(to_flag("enabled")).alias("enabled_constraints")
    )


def value_counts(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit("")).alias(name or column)).agg(F.count(F.lit(1)).alias("count"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts per value and their share of all rows; the total is a sum over the few values."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("count").alias("_total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.round(ratio("count", "_total"), 6)).drop("_total")


def conflict_summary(found: DataFrame) -> DataFrame:
    """Conflicts by their (older) action names, in one row."""
    action = F.coalesce("action", F.lit(""))
    return found.agg(
        F.count(F.lit(1)).alias("detected_conflicts"),
        F.count_if(action == "hide").alias("hidden_conflicts"),
        F.count_if(action == "downgrade").alias("downgrade_conflicts"),
        F.count_if(F.lower(action).contains("mixed") | (action == "mark_complex")).alias("mark_mixed_conflicts"),
        F.count_if(action == "review").alias("review_conflicts"),
    )


# ---- effectiveness --------------------------------------------------------------

def enriched(after: DataFrame) -> DataFrame:
    """Updated edges with action, trigger and evidence flags for the metrics."""
    action = F.coalesce(resolve(after, ("update_action", "action", "after_check_status", "status"), F.lit("keep")), F.lit("keep"))
    flag = find_column(after, ("is_mutex_triggered", "mutex_triggered", "triggered"))
    rows = after.withColumns({**evidence(after), "_action": clean_text(action)})
    return rows.withColumns({
        "_triggered": to_flag(flag) if flag else F.col("_action") != "keep",
        "_processed": F.col("_action").isin(*PROCESSED_ACTIONS),
        "_protected": ~F.col("_action").isin(*FORCED_ACTIONS),
        "evidence_group": evidence_group(),
    })


def effectiveness(after: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Protection, handling and impact rates with numerator and denominator, from one pass over the edges."""
    e = enriched(after)
    low = F.col("is_low_evidence") & F.col("_triggered")
    one = e.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_action") == "keep").alias("kept"),
        F.count_if(F.col("_triggered")).alias("triggered"),
        F.count_if(F.col("_action") != "keep").alias("changed"),
        F.count_if(F.col("is_high_evidence")).alias("high"),
        F.count_if(F.col("is_high_evidence") & F.col("_protected")).alias("high_protected"),
        F.count_if(low).alias("low_triggered"),
        F.count_if(low & F.col("_processed")).alias("low_processed"),
    )
    rates = (
        ("high_evidence_protection_rate", "high_protected", "high"),
        ("low_evidence_handling_rate", "low_processed", "low_triggered"),
        ("update_impact_control_rate", "kept", "total"),
        ("triggered_conflict_coverage", "triggered", "total"),
        ("changed_edge_share", "changed", "total"),
        ("source_evidence_retention", "total", "total"),
    )
    table = one.select(F.inline(F.array(*[
        F.struct(
            F.lit(n).alias("metric"), percent_text(ratio(a, b)).alias("value"),
            F.col(a).alias("numerator"), F.col(b).alias("denominator"),
        ) for n, a, b in rates
    ])))
    if found is None:
        return table
    counted = found.agg(F.count(F.lit(1)).alias("k")).where("k > 0").select(
        F.lit("triggered_conflict_records").alias("metric"), F.col("k").cast("string").alias("value"),
        F.col("k").alias("numerator"), F.lit(None).cast("bigint").alias("denominator"),
    )
    return table.unionByName(counted)


PIVOT_ACTIONS = ("keep", "review", "mark_mixed", "downgrade", "hide_low_evidence", "hide")


def evidence_pivot(after: DataFrame, actions: tuple[str, ...] = PIVOT_ACTIONS) -> DataFrame:
    """Edges per evidence group and action, with row totals and shares."""
    counts = enriched(after).groupBy("evidence_group").pivot("_action", list(actions)).count().na.fill(0)
    total = sum((F.col(a) for a in actions), F.lit(0).cast("bigint"))
    return counts.withColumn("total", total).withColumns({f"{a}_share": percent_text(ratio(a, "total")) for a in actions})


def constraint_metrics(final: DataFrame) -> DataFrame:
    """Weak share, selected share and the three means over all constraints."""
    status = clean_text(resolve(final, ("auto_filter_status", "filter_status", "status"), F.lit("")))
    ends = clean_text(resolve(final, ("final_status",), F.lit("")))
    flag = find_column(final, ("use_for_update", "is_enabled"))
    chosen = to_flag(flag) if flag else ends.isin(*UPDATE_STATUSES)

    def mean(*names: str) -> Column:
        return F.coalesce(F.avg(to_double(resolve(final, names, F.lit(0.0)))), F.lit(0.0))

    one = final.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status.isin(*WEAK_STATUSES)).alias("weak"), F.count_if(chosen).alias("selected"),
        mean("source_weighted_confidence", "weighted_confidence").alias("weighted"),
        mean("structural_confidence", "confidence").alias("structural"), mean("violation_rate").alias("violation"),
    )
    none = F.lit(None).cast("bigint")

    def rate(name: str, a: str) -> Column:
        return F.struct(F.lit(name).alias("metric"), percent_text(ratio(a, "total")).alias("value"), F.col(a).alias("numerator"), F.col("total").alias("denominator"))

    def plain(name: str, c: str) -> Column:
        return F.struct(F.lit(name).alias("metric"), F.format_string("%.4f", F.round(c, 4)).alias("value"), none.alias("numerator"), none.alias("denominator"))

    return one.select(F.inline(F.array(
        rate("weak_constraint_share", "weak"), rate("selected_constraint_share", "selected"),
        plain("mean_weighted_confidence", "weighted"), plain("mean_structural_confidence", "structural"),
        plain("mean_violation_rate", "violation"),
    )))


# ---- method comparison ----------------------------------------------------------

def method_metrics(results: DataFrame) -> DataFrame:
    """One row of counts and rates per method, all methods in one grouping."""
    filtered, low = F.col("action").isin(*FILTER_ACTIONS), F.col("is_low_evidence") & F.col("triggered")
    counts = results.groupBy("method").agg(
        F.count(F.lit(1)).alias("total_edges"),
        F.count_if(F.col("triggered")).alias("triggered_edges"),
        F.count_if(F.col("action") != "keep").alias("changed_edges"),
        F.count_if(F.col("action") == "keep").alias("kept_edges"),
        F.count_if(filtered).alias("filtered_edges"),
        F.count_if(F.col("action") == "review").alias("review_edges"),
        F.count_if(F.col("action") == "mark_mixed").alias("mark_mixed_edges"),
        F.count_if(F.col("is_high_evidence")).alias("high_evidence_edges"),
        F.count_if(F.col("is_high_evidence") & filtered).alias("high_evidence_filtered"),
        F.count_if(low).alias("low_evidence_triggered"),
        F.count_if(low & F.col("action").isin(*METHOD_PROCESSED_ACTIONS)).alias("low_evidence_processed"),
    )
    return counts.withColumns({
        "triggered_coverage": percent_text(ratio("triggered_edges", "total_edges")),
        "changed_share": percent_text(ratio("changed_edges", "total_edges")),
        "impact_control_rate": percent_text(ratio("kept_edges", "total_edges")),
        "high_evidence_protection_rate": percent_text(
            ratio(F.col("high_evidence_edges") - F.col("high_evidence_filtered"), "high_evidence_edges")),
        "low_evidence_handling_rate": percent_text(ratio("low_evidence_processed", "low_evidence_triggered")),
        "source_evidence_retention": F.lit("100.00%"),
    })


def _shares(results: DataFrame, within: tuple[str, ...]) -> DataFrame:
    counts = results.groupBy(*within, "action").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*within))  # over the few counted rows
    return counts.withColumn("share", percent_text(ratio(F.col("count"), total)))


def method_actions(results: DataFrame) -> DataFrame:
    return _shares(results, ("method",))


def method_evidence_actions(results: DataFrame) -> DataFrame:
    return _shares(results, ("method", "evidence_group"))


# ---- constraint quality ---------------------------------------------------------

def conflicts_per_constraint(final: DataFrame, found: DataFrame) -> DataFrame:
    """Conflicts by constraint id, or by relation pair where a constraint has none under its id."""
    by_id = found.groupBy("constraint_id").agg(F.count(F.lit(1)).alias("by_id"))
    a, b = relation_light("relation_a"), relation_light("relation_b")
    by_pair = found.groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(F.count(F.lit(1)).alias("by_pair"))
    keys = final.select("constraint_id", F.least("relation_a", "relation_b").alias("low"), F.greatest("relation_a", "relation_b").alias("high"))
    # Counts per constraint and per relation pair are bounded by the constraints.
    joined = keys.join(F.broadcast(by_id), "constraint_id", "left").join(F.broadcast(by_pair), ["low", "high"], "left")
    return joined.select("constraint_id", F.coalesce("by_id", "by_pair", F.lit(0).cast("bigint")).alias("conflict_count"))


def edges_per_constraint(after: DataFrame) -> DataFrame:
    """Triggered, reviewed and mixed edges per constraint id."""
    return (
        after.where("is_mutex_triggered").select("update_action", F.explode(list_text("triggered_constraint_ids")).alias("constraint_id"))
        .groupBy("constraint_id").agg(
            F.count(F.lit(1)).alias("triggered_edges"),
            F.count_if(F.col("update_action") == "review").alias("review_edges"),
            F.count_if(F.col("update_action") == "mark_mixed").alias("mark_mixed_edges"),
        )
    )


def constraint_quality(final: DataFrame, found: DataFrame, after: DataFrame) -> DataFrame:
    """Per constraint: its evidence, its status and what it did to the graph, best status first."""
    label = lambda c: lookup(c, RELATION_LABELS)
    joined = final.join(F.broadcast(conflicts_per_constraint(final, found)), "constraint_id", "left").join(
        F.broadcast(edges_per_constraint(after)), "constraint_id", "left"
    )
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "constraint_id", "constraint_key", F.concat_ws("_", "relation_a", "relation_b").alias("relation_pair"),
        F.concat(label("relation_a"), F.lit(" - "), label("relation_b")).alias("relation_meaning"),
        "comparable_count", "support_count", "violation_count",
        F.round("structural_confidence", 4).alias("structural_confidence"), F.round("violation_rate", 4).alias("violation_rate"),
        F.round("source_weighted_confidence", 4).alias("source_weighted_confidence"),
        "auto_filter_status", "final_status", "use_for_update",
        F.coalesce("conflict_count", zero).alias("conflict_count"), F.coalesce("triggered_edges", zero).alias("triggered_edges"),
        F.coalesce("review_edges", zero).alias("review_edges"), F.coalesce("mark_mixed_edges", zero).alias("mark_mixed_edges"),
    ).orderBy(lookup("auto_filter_status", QUALITY_STATUS_ORDER, F.lit(9)), F.desc("comparable_count"), "constraint_id")
