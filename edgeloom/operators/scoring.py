"""Edge confidence, level, reason and source weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.constants import (
    FEED_A,
    FEED_B,
    LEVEL_HIGH,
    LEVEL_MEDIUM,
    LOW_EVIDENCE,
    REASON_SEPARATOR,
    REASON_TEXTS,
    SCORE_BASE,
    SCORE_COUNT_CAP,
    SCORE_CROSS_BONUS,
    SCORE_PENALTY,
    SOURCE_WEIGHTS,
)
from edgeloom.functions.codes import relation_light
from edgeloom.functions.parse import to_double, to_long
from edgeloom.sources.columns import require, resolve

SCORED_FROM = (
    "edge_id", "subject_org_id", "object_org_id", "event_month", "relation_type", "event_count",
    "source_datasets", "icews_event_count", "gdelt_event_count",
)


def _named(feed: str) -> Column:
    return F.coalesce(F.col("source_datasets"), F.lit("")).contains(feed)


def _counts() -> tuple[Column, Column, Column]:
    return to_long("event_count"), to_long("icews_event_count"), to_long("gdelt_event_count")


def edge_confidence() -> Column:
    """Base by source, plus a cross-source bonus, plus a capped logarithm of the event count, minus low-evidence penalties."""
    events, a, b = _counts()
    in_a, in_b = _named(FEED_A), _named(FEED_B)
    base = (
        F.when(in_a & in_b, SCORE_BASE["cross"]).when(in_a, SCORE_BASE["a"]).when(in_b, SCORE_BASE["b"])
        .otherwise(to_double("confidence", 0.4))
    )
    bonus = F.when((a > 0) & (b > 0), SCORE_CROSS_BONUS).otherwise(0.0)
    volume = F.when(events > 0, F.least(F.log1p(events) / 10.0, F.lit(SCORE_COUNT_CAP))).otherwise(0.0)
    few = F.when(events <= 1, SCORE_PENALTY).otherwise(0.0)
    weak = F.when(in_b & ~in_a & (b <= 2), SCORE_PENALTY).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + bonus + volume - few - weak)), 4)


def confidence_level(score: str | Column = "confidence") -> Column:
    value = F.col(score) if isinstance(score, str) else score
    return F.when(value >= LEVEL_HIGH, "high").when(value >= LEVEL_MEDIUM, "medium").otherwise("low")


def confidence_reason() -> Column:
    """Texts of the rules that fired, then the score."""
    events, a, b = _counts()
    in_a, in_b = _named(FEED_A), _named(FEED_B)
    return F.concat_ws(
        REASON_SEPARATOR,
        F.when(in_a, REASON_TEXTS["a"]),
        F.when(in_b, REASON_TEXTS["b"]),
        F.when((a > 0) & (b > 0), REASON_TEXTS["cross"]),
        F.when(events <= 1, REASON_TEXTS["few"]),
        F.when(in_b & ~in_a & (b <= 2), REASON_TEXTS["b_low"]),
        F.concat(F.lit(REASON_TEXTS["score"]), F.col("confidence").cast("string")),
    )


def score_edges(edges: DataFrame) -> DataFrame:
    """Scored edges; narrow, no shuffle."""
    require(edges, SCORED_FROM)
    if "confidence" not in edges.columns:
        edges = edges.withColumn("confidence", F.lit(0.4))
    if "status" not in edges.columns:
        edges = edges.withColumn("status", F.lit("active"))
    return (
        edges.withColumn("confidence", edge_confidence())
        .withColumns({
            "confidence_level": confidence_level(),
            "confidence_reason": confidence_reason(),
            "is_derived_relation": F.lit(True),
        })
    )


def source_profile(edges: DataFrame, confidence: str = "confidence") -> dict[str, Column]:
    """Which feeds support an edge and whether its evidence is low, as columns over an edge table."""
    sources = F.upper(F.coalesce(resolve(edges, ("sources", "source_datasets"), F.lit("")), F.lit("")))
    zero = F.lit(0)
    a = to_double(resolve(edges, ("icews_event_count", "icews_count"), zero))
    b = to_double(resolve(edges, ("gdelt_event_count", "gdelt_count"), zero))
    mentions = to_double(resolve(edges, ("num_mentions", "NumMentions"), zero))
    articles = to_double(resolve(edges, ("num_articles", "NumArticles"), zero))
    has_a = (a > 0) | sources.contains(FEED_A)
    has_b = (b > 0) | sources.contains(FEED_B)
    weak = (to_double(resolve(edges, (confidence,), F.lit(0.0))) < LOW_EVIDENCE) | ((mentions <= 1) & (articles <= 1))
    return {
        "has_a": has_a,
        "has_b": has_b,
        "cross_source": has_a & has_b,
        "low_evidence": has_b & ~has_a & weak,
    }


def edge_weight(edges: DataFrame) -> Column:
    """Source weight of an edge."""
    p = source_profile(edges)
    return (
        F.when(p["cross_source"], SOURCE_WEIGHTS["cross"])
        .when(p["has_a"], SOURCE_WEIGHTS["a"])
        .when(p["low_evidence"], SOURCE_WEIGHTS["b_low"])
        .when(p["has_b"], SOURCE_WEIGHTS["b"])
        .otherwise(SOURCE_WEIGHTS["none"])
    )


def source_weights(edges: DataFrame) -> DataFrame:
    """Mean source weight per subject, relation and object, over all months."""
    return (
        edges.select(
            "subject_org_id", relation_light("relation_type").alias("relation_type"), "object_org_id",
            edge_weight(edges).alias("w"),
        )
        .groupBy("subject_org_id", "relation_type", "object_org_id")
        .agg(F.avg("w").alias("source_weight"))
    )
