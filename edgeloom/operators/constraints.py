"""Support of candidate constraints in the interval data, and their final status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.constants import (
    MANUAL_STATUS_MAP,
    REVIEW_STATUSES,
    STATUS_THRESHOLDS,
    UPDATE_STATUSES,
)
from edgeloom.functions.codes import relation_light
from edgeloom.functions.parse import clean_text, lookup, month_text, ratio, to_double, to_long
from edgeloom.functions.temporal import exclusion_truth
from edgeloom.operators.pairs import (
    COUNT_COLUMNS,
    PAIR,
    PAIR_ORDER,
    RELATION_KINDS,
    expand_pairs,
    first_groups,
    pair_counts,
)
from edgeloom.sources.columns import find_column, resolve


def standard_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with normalized codes and the default key, name, scope and action."""
    a, b = relation_light("relation_a"), relation_light("relation_b")

    def text(*names: str, default: str = "") -> Column:
        found = find_column(candidates, names)
        return clean_text(found) if found else F.lit(default)

    forbidden = text("forbidden_temporal_relation", default="overlap")
    key = F.coalesce(F.nullif(text("constraint_key"), F.lit("")), F.concat_ws("_", F.least(a, b), F.greatest(a, b), forbidden))
    return candidates.select(
        text("constraint_id").alias("constraint_id"), key.alias("constraint_key"),
        F.coalesce(F.nullif(text("constraint_name"), F.lit("")), text("constraint_id")).alias("constraint_name"),
        a.alias("relation_a"), b.alias("relation_b"),
        text("scope", default="same_subject_object").alias("scope"), forbidden.alias("forbidden_temporal_relation"),
        text("candidate_level").alias("candidate_level"),
        text("program_candidate_reason").alias("program_candidate_reason"),
        text("program_recommended_action").alias("program_recommended_action"),
        text("hard_or_soft", default="soft").alias("proposed_hard_or_soft"),
        text("expected_action", default="review").alias("proposed_action"),
        text("reason").alias("proposed_reason"), text("exception").alias("proposed_exception"),
    )


def _oriented(counts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pair counts per constraint, seen from the constraint's own side a.

    Candidates are bounded by the relation pairs, so they broadcast; a candidate
    written with its larger code first mirrors the direction-dependent counts.
    """
    ordered = candidates.select(
        "constraint_id", "forbidden_temporal_relation",
        F.least("relation_a", "relation_b").alias("relation_a"), F.greatest("relation_a", "relation_b").alias("relation_b"),
        (F.col("relation_a") > F.col("relation_b")).alias("mirrored"),
    )
    joined = counts.join(F.broadcast(ordered), ["relation_a", "relation_b"])
    mirror = {"before": "after", "after": "before", "during": "contains", "contains": "during"}
    return joined.withColumns({
        f"{k}_count": F.when(F.col("mirrored"), F.col(f"{mirror[k]}_count")).otherwise(F.col(f"{k}_count")) for k in mirror
    })


def _truth_sum(value: int) -> Column:
    zero = F.lit(0).cast("bigint")
    return sum(
        (F.when(exclusion_truth(F.lit(k), "forbidden_temporal_relation") == value, F.col(f"{k}_count")).otherwise(zero) for k in RELATION_KINDS),
        zero,
    )


def group_support(counts: DataFrame, candidates: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Support of every constraint in every (subject, object) that holds both relations.

    A source weight belongs to (subject, relation, object), so it is constant
    within a group: it joins here, once per group, not once per interval pair.
    """
    rows = _oriented(counts, candidates).withColumns({
        "support": _truth_sum(1), "negative": _truth_sum(-1), "unknown": _truth_sum(0),
    })
    if weights is None:
        return rows.withColumn("pair_weight", F.lit(1.0))

    def side(s: str) -> DataFrame:
        return weights.select(
            *PAIR, F.col("relation_type").alias(f"relation_{s}"), F.col("source_weight").alias(f"weight_{s}")
        )

    rows = rows.join(side("a"), [*PAIR, "relation_a"], "left").join(side("b"), [*PAIR, "relation_b"], "left")
    return rows.withColumn(
        "pair_weight", (F.coalesce("weight_a", F.lit(1.0)) + F.coalesce("weight_b", F.lit(1.0))) / 2
    ).drop("weight_a", "weight_b")


def auto_status(thresholds: dict = STATUS_THRESHOLDS) -> Column:
    """Status from the number of judged pairs, both confidences, the violation rate, level and proposed action."""
    n, conf, weighted, viol = (
        F.col("instantiation_count"), F.col("_confidence"), F.col("_weighted"), F.col("_violation")
    )
    t = thresholds
    return (
        F.when(
            (n >= t["pass"]["comparable"]) & (conf >= t["pass"]["confidence"])
            & (weighted >= t["pass"]["weighted"]) & (viol <= t["pass"]["violation"]), "pass")
        .when(
            (F.col("candidate_level") == "strong_candidate") & (n >= t["strong_soft"]["comparable"])
            & (conf >= t["strong_soft"]["confidence"]) & (weighted >= t["strong_soft"]["weighted"])
            & (viol <= t["strong_soft"]["violation"]), "strong_soft")
        .when(
            (F.col("proposed_action") == "mark_mixed") & (n >= t["mixed_candidate"]["comparable"])
            & (conf >= t["mixed_candidate"]["confidence"]) & (viol <= t["mixed_candidate"]["violation"]), "mixed_candidate")
        .when((n >= t["review"]["comparable"]) & (conf >= t["review"]["confidence"]), "review")
        .when((n >= t["weak_review"]["comparable"]) & (conf >= t["weak_review"]["confidence"]), "weak_review")
        .otherwise("weak")
    )


def score_constraints(
    intervals: DataFrame, candidates: DataFrame, weights: DataFrame | None = None,
    counts: DataFrame | None = None, thresholds: dict = STATUS_THRESHOLDS,
) -> DataFrame:
    """All candidates scored in one job: pair-level, source-weighted and entity-level confidence, and a status.

    Candidates without a single comparable pair stay, with zeros.
    """
    standard = standard_candidates(candidates)
    counts = pair_counts(intervals) if counts is None else counts
    support = group_support(counts, standard, weights)
    judged = F.col("support") + F.col("negative")
    flag = lambda c: F.count_if(c)
    scored = support.groupBy("constraint_id").agg(
        F.sum("comparable_count").alias("comparable_count"),
        F.sum("support").alias("support_count"), F.sum("negative").alias("negative_count"), F.sum("unknown").alias("unknown_count"),
        F.sum(F.col("support") * F.col("pair_weight")).alias("_weighted_support"),
        F.sum(judged * F.col("pair_weight")).alias("_weighted_judged"),
        flag(F.col("negative") > 0).alias("entity_negative_count"),
        flag((F.col("negative") == 0) & (F.col("support") > 0)).alias("entity_support_count"),
        flag(judged == 0).alias("entity_unknown_count"),
        *[F.sum(c).alias(c) for c in COUNT_COLUMNS],
    )
    whole = [
        "comparable_count", "support_count", "negative_count", "unknown_count", "entity_negative_count",
        "entity_support_count", "entity_unknown_count", *COUNT_COLUMNS,
    ]
    full = standard.join(F.broadcast(scored), "constraint_id", "left").na.fill(0, whole)
    full = full.withColumns({
        "instantiation_count": F.col("support_count") + F.col("negative_count"),
        "entity_instantiation_count": F.col("entity_support_count") + F.col("entity_negative_count"),
    }).withColumns({
        "_confidence": ratio("support_count", "instantiation_count"),
        "_violation": ratio("negative_count", "instantiation_count"),
        "_weighted": ratio("_weighted_support", "_weighted_judged"),
    })
    return full.select(
        "constraint_id", "constraint_key", "constraint_name", "relation_a", "relation_b", "scope",
        "forbidden_temporal_relation", "comparable_count",
        F.col("support_count").alias("non_overlap_count"), F.col("negative_count").alias("violation_count"),
        "support_count", "negative_count", "unknown_count", "instantiation_count",
        F.round("_confidence", 6).alias("structural_confidence"),
        F.round("_weighted", 6).alias("source_weighted_confidence"),
        F.round("_violation", 6).alias("violation_rate"),
        "entity_support_count", "entity_negative_count", "entity_unknown_count", "entity_instantiation_count",
        F.round(ratio("entity_support_count", "entity_instantiation_count"), 6).alias("entity_level_confidence"),
        F.round(ratio("entity_negative_count", "entity_instantiation_count"), 6).alias("entity_violation_rate"),
        *COUNT_COLUMNS,
        "candidate_level", "program_candidate_reason", "program_recommended_action",
        "proposed_hard_or_soft", "proposed_action", "proposed_reason", "proposed_exception",
        auto_status(thresholds).alias("auto_filter_status"),
    )


def trigger_instances(
    intervals: DataFrame, candidates: DataFrame, weights: DataFrame | None = None, counts: DataFrame | None = None,
    limit: int | None = None, violations_only: bool = False,
) -> DataFrame:
    """Interval pairs of each constraint with their verdict, or the violations only.

    All of them, without a number; with a limit the first per constraint, numbered.
    The counts then say which (subject, object) groups the first pairs lie in,
    so only those groups are expanded into pairs.
    """
    standard = standard_candidates(candidates)
    counts = pair_counts(intervals) if counts is None else counts
    support = group_support(counts, standard, weights)
    size = F.col("negative") if violations_only else F.col("comparable_count")
    groups = support.select(
        "constraint_id", *PAIR, "relation_a", "relation_b", "mirrored", "forbidden_temporal_relation", "pair_weight",
        size.alias("_size"),
    )
    chosen = (groups.where("_size > 0") if limit is None else first_groups(groups, "_size", limit, "constraint_id")).drop("_size")
    swap = chosen.select(
        "constraint_id", *PAIR, "forbidden_temporal_relation", "pair_weight",
        F.when(F.col("mirrored"), F.col("relation_b")).otherwise(F.col("relation_a")).alias("relation_a"),
        F.when(F.col("mirrored"), F.col("relation_a")).otherwise(F.col("relation_b")).alias("relation_b"),
    )
    pairs = expand_pairs(swap, intervals).withColumn("truth", exclusion_truth("interval_relation", "forbidden_temporal_relation"))
    if violations_only:
        pairs = pairs.where("truth = -1")
    first = pairs
    if limit is not None:
        order = Window.partitionBy("constraint_id").orderBy(*PAIR_ORDER)
        first = pairs.withColumn("instance", F.row_number().over(order)).where(F.col("instance") <= limit)
    names = F.broadcast(standard.select("constraint_id", "constraint_key", "constraint_name"))
    ids = [c for c in ("interval_a_id", "interval_b_id") if c in first.columns]
    return first.join(names, "constraint_id").select(
        "constraint_id", "constraint_key", "constraint_name", *([] if limit is None else ["instance"]), *PAIR, "relation_a", "relation_b", *ids,
        month_text("a_start").alias("a_start_time"), month_text("a_end").alias("a_end_time"),
        month_text("b_start").alias("b_start_time"), month_text("b_end").alias("b_end_time"),
        "interval_relation", "truth", (F.col("truth") == -1).alias("is_violation"),
        F.round("pair_weight", 6).alias("pair_weight"),
    )


# ---- final status -------------------------------------------------------------

def auto_final_status() -> Column:
    """Status a constraint takes without a reviewer."""
    status, level, action = clean_text("auto_filter_status"), clean_text("candidate_level"), clean_text("proposed_action")
    conf, weighted = to_double("structural_confidence"), to_double("source_weighted_confidence")
    viol, n = to_double("violation_rate", 1.0), to_long("comparable_count")
    soft, mixed = STATUS_THRESHOLDS["strong_soft"], STATUS_THRESHOLDS["mixed_candidate"]
    near_strong = (
        (status == "review") & (level == "strong_candidate") & (n >= soft["comparable"]) & (conf >= soft["confidence"])
        & (weighted >= soft["weighted"]) & (viol <= soft["violation"])
    )
    in_review = status.isin("review", "weak_review")
    near_mixed = (
        in_review & (action == "mark_mixed") & (n >= mixed["comparable"]) & (conf >= mixed["confidence"])
        & (viol <= mixed["violation"])
    )
    return (
        F.when(status == "pass", "enabled_for_update")
        .when(status.isin("strong_soft", "mixed_candidate") | near_strong | near_mixed, "enabled_for_mark_mixed")
        .when(in_review, "review_only")
        .otherwise("disabled")
    )


def manual_status(c: Column) -> Column:
    """Reviewer's word for a status in standard form; unknown words stay."""
    return lookup(clean_text(c), MANUAL_STATUS_MAP)


def _first_filled(df: DataFrame, *names: str) -> Column:
    present = [F.nullif(clean_text(n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present, F.lit("")) if present else F.lit("")


def final_constraints(scored: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Scored constraints with automatic and reviewed status; a review by id outranks one by key.

    Of several reviews for one constraint the last one counts, by review_seq or,
    where there is none, by the place in the review file.
    """
    base = scored.withColumn("auto_final_status", auto_final_status())
    empty = {c: F.lit("") for c in ("manual_final_status", "manual_score", "manual_comment")}
    if manual is None:
        joined = base.withColumns(empty)
    else:
        key = resolve(manual, ("constraint_key",), F.lit("")) if "constraint_key" in manual.columns else (
            F.concat_ws("_", relation_light("relation_a"), relation_light("relation_b"), "forbidden_temporal_relation")
            if {"relation_a", "relation_b", "forbidden_temporal_relation"} <= set(manual.columns) else F.lit("")
        )
        cid = clean_text("constraint_id") if "constraint_id" in manual.columns else F.lit("")
        seq = F.col("review_seq") if "review_seq" in manual.columns else F.monotonically_increasing_id()
        reviews = manual.select(
            cid.alias("cid"), F.when(cid == "", clean_text(key)).otherwise("").alias("ckey"), seq.alias("seq"),
            F.struct(
                manual_status(_first_filled(manual, "final_status", "manual_decision", "review_decision", "decision", "use_status")).alias("status"),
                _first_filled(manual, "manual_score", "score", "review_score").alias("score"),
                _first_filled(manual, "manual_comment", "comment", "review_comment", "reason").alias("comment"),
            ).alias("review"),
        )
        by_id = reviews.where("cid <> ''").groupBy("cid").agg(F.max_by("review", "seq").alias("by_id"))
        by_key = reviews.where("ckey <> ''").groupBy("ckey").agg(F.max_by("review", "seq").alias("by_key"))
        joined = (
            base.join(by_id, F.col("constraint_id") == F.col("cid"), "left")
            .join(by_key, F.col("constraint_key") == F.col("ckey"), "left")
            .withColumn("_review", F.coalesce("by_id", "by_key"))
            .withColumns({
                "manual_final_status": F.coalesce("_review.status", F.lit("")),
                "manual_score": F.coalesce("_review.score", F.lit("")),
                "manual_comment": F.coalesce("_review.comment", F.lit("")),
            })
            .drop("cid", "ckey", "by_id", "by_key", "_review")
        )
    final = F.coalesce(F.nullif("manual_final_status", F.lit("")), "auto_final_status")
    return joined.withColumn("final_status", final).withColumns({
        "is_enabled": F.col("final_status").isin(*REVIEW_STATUSES),
        "use_for_update": F.col("final_status").isin(*UPDATE_STATUSES),
        "use_for_review": F.col("final_status").isin(*REVIEW_STATUSES),
    })


