"""Fixed dimensions: the 20 relation types, the 190 relation pairs with their rule, the update actions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import constants as C


def relation_dimension(spark: SparkSession) -> DataFrame:
    """One row per relation code. 20 rows, so joins against it may broadcast."""
    groups = F.lit("")
    for name, (low, high) in C.EVALUATION_GROUPS.items():
        groups = F.when(F.col("code").between(low, high), name).otherwise(groups)
    rows = [(c, C.RELATION_LABELS[c], C.RELATION_DESCRIPTIONS[c]) for c in C.RELATION_CODES]
    return spark.createDataFrame(rows, "code string, label string, description string").withColumns({
        "eval_group": groups,
        "is_cooperation": F.col("code").between("01", "08"),
        "is_broad": F.col("code").isin(*C.BROAD_RELATIONS),
    })


# First rule whose two sides hold the pair (either way round) decides.
_SIDED_RULES = (
    ("inside_verbal", C.RULE_VERBAL_CONFLICT, C.RULE_VERBAL_CONFLICT, "blocked", "review"),
    ("inside_severe", C.SEVERE_CONFLICT, C.SEVERE_CONFLICT, "blocked", "review"),
    ("material_vs_severe", C.MATERIAL_COOPERATION, C.SEVERE_CONFLICT, "strong_candidate", "mark_mixed_or_downgrade"),
    ("diplomacy_vs_force", C.VERBAL_DIPLOMACY, C.MILITARY_OR_COERCIVE, "weak_candidate", "mark_mixed"),
    ("negotiation_vs_sanction", C.NEGOTIATION, C.SANCTION_OR_BREAK, "weak_candidate", "mark_mixed"),
    ("cooperation_vs_threat", C.COOPERATION_ALL, C.THREAT_REJECT_CRITICIZE, "weak_candidate", "review"),
    ("aid_vs_protest", C.AID_OR_CONCESSION, C.PROTEST_OR_UNCONVENTIONAL, "weak_candidate", "review"),
)


def pair_rule(a: str, b: str) -> tuple[str, str, str]:
    """Level, reason and recommended action of an ordered pair of different relation codes."""
    listed = (
        ("broad", a in C.BROAD_RELATIONS or b in C.BROAD_RELATIONS),
        ("process_chain", (a, b) in C.PROCESS_CHAIN_PAIRS),
        ("internal_conflict", (a, b) in C.INTERNAL_CONFLICT_PAIRS),
    )
    for name, holds in listed:
        if holds:
            return "blocked", C.PAIR_RULE_TEXTS[name], "review"
    for name, left, right, level, action in _SIDED_RULES:
        if (a in left and b in right) or (b in left and a in right):
            return level, C.PAIR_RULE_TEXTS[name], action
    return "blocked", C.PAIR_RULE_TEXTS["other"], "review"


def pair_rules(spark: SparkSession) -> DataFrame:
    """One row per unordered pair of relation codes: 190 rows, fixed."""
    rows = [(a, b, *pair_rule(a, b)) for a, b in combinations(C.RELATION_CODES, 2)]
    return spark.createDataFrame(
        rows,
        "relation_a string, relation_b string, candidate_level string, candidate_reason string, recommended_action string",
    )


def usable_pair_rules(spark: SparkSession) -> DataFrame:
    return pair_rules(spark).where("candidate_level <> 'blocked'")


def with_relation_label(df: DataFrame, column: str, label: str, dimension: DataFrame) -> DataFrame:
    """Join a label by relation code; unknown codes show themselves."""
    names = dimension.select(F.col("code").alias("_code"), F.col("label").alias("_label"))
    return (
        df.join(F.broadcast(names), F.col(column) == F.col("_code"), "left")
        .withColumn(label, F.coalesce("_label", F.col(column))).drop("_code", "_label")
    )
