"""Review samples and case extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.constants import FEED_A, FEED_B, STRONG_REASON_PATTERN
from edgeloom.functions.parse import to_double, to_long

HIDE_ACTIONS = ("hide", "hide_low_evidence")


def seeded_sample(df: DataFrame, n: int, *key: str, seed: int = 42) -> DataFrame:
    """n rows in a pseudo-random order that depends only on key and seed, by a hash that SQL has too. Spark keeps n rows per task, then n in all."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *key)), *key).limit(n)


def review_sample(df: DataFrame, n: int, *key: str, fields: tuple[str, ...] = ("manual_is_reasonable", "manual_note"), seed: int = 42) -> DataFrame:
    """A sample with blank columns for a reviewer."""
    return seeded_sample(df, n, *key, seed=seed).withColumns({f: F.lit("") for f in fields})


def first_aliases(aliases: DataFrame, k: int = 5) -> DataFrame:
    """First k aliases per organization as one text; only those k are ever collected."""
    rank = Window.partitionBy("org_id").orderBy("alias")
    first = aliases.select("org_id", "alias").distinct().withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= k)
    return first.groupBy("org_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), "; ").alias("sample_aliases"))


def alignment_sample(organizations: DataFrame, aliases: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """Sampled organizations with some aliases; aliases of other organizations are dropped before they are collected."""
    chosen = seeded_sample(organizations, n, "org_id", seed=seed)
    own = aliases.join(F.broadcast(chosen.select("org_id")), "org_id", "left_semi")  # n ids
    return chosen.join(first_aliases(own), "org_id", "left").withColumns({
        "manual_is_correct_alignment": F.lit(""), "manual_note": F.lit(""),
    })


def hidden_sample(after: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """Sample of hidden or removed edges; if the status names none, of those whose action says so."""
    by_status = F.col("status").isin("hidden", "removed")
    by_action = F.col("check_action").isin("hide", "remove")
    rows = after.where(by_status | by_action).withColumn("_by_status", by_status)
    any_status = rows.agg(F.coalesce(F.bool_or("_by_status"), F.lit(False)).alias("_any"))
    target = rows.join(F.broadcast(any_status)).where("_by_status or not _any").drop("_by_status", "_any")
    return review_sample(target, n, "edge_id", seed=seed)


# ---- cases ----------------------------------------------------------------------

def cross_source_cases(before: DataFrame, n: int = 30) -> DataFrame:
    both = F.col("source_datasets").contains(FEED_A) & F.col("source_datasets").contains(FEED_B)
    return before.where(both).orderBy(to_double("confidence").desc(), "edge_id").limit(n)


def single_source_cases(after: DataFrame, n: int = 30) -> DataFrame:
    """Edges of feed B alone with the fewest events; only hidden ones if there are any."""
    alone = after.where(F.col("source_datasets").contains(FEED_B) & ~F.col("source_datasets").contains(FEED_A))
    hidden = F.coalesce(F.col("status") == "hidden", F.lit(False))
    ranked = alone.withColumn("_hidden", hidden).orderBy(F.desc("_hidden"), to_long("event_count"), "edge_id").limit(n)
    # Hidden rows sort first, so the first n rows tell whether there are any.
    any_hidden = ranked.agg(F.coalesce(F.bool_or("_hidden"), F.lit(False)).alias("_any"))
    return ranked.join(F.broadcast(any_hidden)).where("_hidden or not _any").drop("_hidden", "_any")


def filtered_constraint_cases(legacy_final: DataFrame, n: int = 30) -> DataFrame:
    """Disabled or too strong constraints, else those whose reason says so."""
    first = F.lower("final_decision").rlike("disabled|too_strong")
    second = F.coalesce("reason", F.lit("")).rlike(STRONG_REASON_PATTERN)
    rows = legacy_final.where(first | second).withColumn("_rank", F.when(first, 1).otherwise(2))
    best = rows.agg(F.min("_rank").alias("_best"))
    return rows.join(F.broadcast(best)).where("_rank = _best").orderBy("constraint_id").limit(n).drop("_rank", "_best")


def complex_cases(after: DataFrame, n: int = 30) -> DataFrame:
    """Edges marked complex, else of the mixed relation type, else triggered by a mixed-relation rule."""
    triggers = "cooperation_conflict|multiple_cameo|multiple_conflict|material_cooperation"
    rank = (
        F.when(F.col("check_action").isin("mark_complex", "create_mixed_relation"), 1)
        .when(F.col("relation_type") == "mixed_relation", 2)
        .when(F.lower("triggered_constraints").rlike(triggers), 3)
    )
    top = after.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "edge_id").limit(n)
    best = top.agg(F.min("_rank").alias("_best"))
    return top.join(F.broadcast(best)).where("_rank = _best").drop("_rank", "_best")


def conflict_cases(found: DataFrame, *actions: str, n: int = 100) -> DataFrame:
    return found.where(F.col("conflict_action").isin(*actions)).orderBy(
        "subject_org_id", "object_org_id", "month", "constraint_id").limit(n)


def decision_cases(log: DataFrame, *actions: str, n: int = 100) -> DataFrame:
    return log.where(F.col("update_action").isin(*actions)).orderBy(
        "subject_org_id", "object_org_id", "month", "constraint_id", "edge_id").limit(n)


def update_cases(found: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """The five case tables of an update run, by name."""
    return {
        "case_mutex_mark_mixed": conflict_cases(found, "mark_mixed"),
        "case_mutex_hide_low_evidence": conflict_cases(found, *HIDE_ACTIONS),
        "case_mutex_review": conflict_cases(found, "review"),
        "case_mutex_downgrade": decision_cases(log, "downgrade"),
        "case_mutex_keep_cross_source": decision_cases(log, "mark_mixed"),
    }
