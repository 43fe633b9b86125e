"""What relations the graph holds, with examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.constants import RELATION_DESCRIPTIONS, RELATION_LABELS
from edgeloom.functions.codes import relation_light
from edgeloom.functions.parse import lookup, to_double, to_long

EDGE_ORDER = ("subject_org_id", "object_org_id", "event_month")


def _norm(edges: DataFrame) -> DataFrame:
    return edges.withColumns({
        "relation_type": relation_light("relation_type"),
        "_events": to_long("event_count"),
        "_confidence": to_double("confidence"),
        "_month": F.substring(F.coalesce("event_month", F.lit("")), 1, 7),
    })


def _arrow() -> Column:
    return F.format_string("%s --%s--> %s %s", "subject_name", "relation_type", "object_name", "_month")


def _top_text(edges: DataFrame, first: str, then: str | None, text: Column, name: str, k: int) -> DataFrame:
    """Example texts of the top k edges per relation, joined in order."""
    order = [F.desc(first), *([F.desc(then)] if then else []), *EDGE_ORDER]
    rank = Window.partitionBy("relation_type").orderBy(*order)
    top = edges.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    entries = F.array_sort(F.collect_list(F.struct("rank", text.alias("t"))))
    return top.groupBy("relation_type").agg(F.array_join(F.transform(entries, lambda x: x["t"]), " | ").alias(name))


def relation_inventory(edges: DataFrame, intervals: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Edges and intervals per relation code, with example texts by volume and by confidence."""
    rows = _norm(edges)
    counted = rows.groupBy("relation_type").agg(F.count(F.lit(1)).alias("edge_count"))
    if intervals is None:
        held = counted.select("relation_type", F.lit(0).cast("bigint").alias("interval_count"))
    else:
        held = intervals.groupBy("relation_type").agg(F.count(F.lit(1)).alias("interval_count"))
    with_confidence = F.concat(_arrow(), F.lit(" confidence="), F.col("_confidence").cast("string"))
    by_volume = _top_text(rows, "_events", "_confidence", _arrow(), "top_subject_object_examples", k)
    by_confidence = _top_text(rows, "_confidence", None, with_confidence, "high_confidence_examples", k)
    joined = counted.join(held, "relation_type", "left").join(by_volume, "relation_type", "left").join(by_confidence, "relation_type", "left")
    unknown = F.format_string("当前数据中出现的关系类型 %s。", "relation_type")
    return joined.select(
        "relation_type", F.col("relation_type").alias("relation_code"),
        lookup("relation_type", RELATION_LABELS).alias("relation_name_zh"),
        lookup("relation_type", RELATION_DESCRIPTIONS, unknown).alias("relation_description"),
        "edge_count", F.col("edge_count").alias("event_count"),
        F.coalesce("interval_count", F.lit(0).cast("bigint")).alias("interval_count"),
        F.coalesce("top_subject_object_examples", F.lit("")).alias("top_subject_object_examples"),
        F.coalesce("high_confidence_examples", F.lit("")).alias("high_confidence_examples"),
    )


def relation_examples(edges: DataFrame, k: int = 5) -> DataFrame:
    """The k most confident edges of each relation, as rows."""
    rank = Window.partitionBy("relation_type").orderBy(F.desc("_confidence"), F.desc("_events"), *EDGE_ORDER)
    top = _norm(edges).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return top.select(
        "relation_type", "rank", "subject_org_id", "object_org_id", "subject_name", "object_name",
        F.col("_month").alias("month"), F.col("_confidence").alias("confidence"), F.col("_events").alias("event_count"),
        F.col("source_datasets").alias("sources"), _arrow().alias("example_text"),
    )
