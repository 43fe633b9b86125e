"""Feed B fused onto seed edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.constants import (
    CROSS_SOURCE_CONFIDENCE,
    FEED_A,
    FEED_B,
    MIN_B_ONLY_EVENTS,
    NEW_EDGE_CONFIDENCE,
    RELATION_CODES,
    SEED_CONFIDENCE,
)
from edgeloom.functions.codes import relation_from_root_or_code
from edgeloom.functions.names import light_name
from edgeloom.functions.parse import clean_text, list_text, sql_date_day, sql_date_month, to_double, to_long
from edgeloom.operators.dictionary import look_up
from edgeloom.operators.facts import KEY, edge_key
from edgeloom.session import cut_lineage

REASONS = ("bad_date", "blank_name", "unmapped", "self_loop", "bad_relation", "mapped")


def classified_events(events: DataFrame, dictionary: DataFrame, hot: Sequence[str] = (), by_month: bool = False) -> DataFrame:
    """Feed B counted per day, name pair and codes, with org ids and the reason each group is used or skipped.

    Counting comes first: the lookups then run on distinct combinations. Names that are hot even then may be given.
    The counts are a stage table, else Spark would move tests of names and codes below the counting, to every event.
    With `by_month`, days are not told apart: a readable day is its month.
    """
    day, month = sql_date_day("SQLDATE"), sql_date_month("SQLDATE")
    counted = (
        events.select(
            (F.when(day != "", month).otherwise("") if by_month else day).alias("day"), month.alias("event_month"),
            "Actor1Name", "Actor2Name", "EventCode", "EventRootCode",
        )
        .groupBy("day", "event_month", "Actor1Name", "Actor2Name", "EventCode", "EventRootCode")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return classified(cut_lineage(counted), dictionary, hot)


def classified(rows: DataFrame, dictionary: DataFrame, hot: Sequence[str] = ()) -> DataFrame:
    """Org ids, relation and reason of rows with day, event_month, names, codes and n; nothing is grouped, so rows may be a stream."""
    prepared = rows.select(
        "day", "event_month", "n",
        F.nullif(light_name("Actor1Name"), F.lit("")).alias("_subject_key"),
        F.nullif(light_name("Actor2Name"), F.lit("")).alias("_object_key"),
        relation_from_root_or_code("EventRootCode", "EventCode").alias("relation_type"),
    )
    mapped = look_up(prepared, dictionary, "_subject_key", "subject", "left", hot)
    mapped = look_up(mapped, dictionary, "_object_key", "object", "left", hot)
    reason = (
        F.when(F.col("day") == "", "bad_date")
        .when(F.col("_subject_key").isNull() | F.col("_object_key").isNull(), "blank_name")
        .when(F.col("subject_org_id").isNull() | F.col("object_org_id").isNull(), "unmapped")
        .when(F.col("subject_org_id") == F.col("object_org_id"), "self_loop")
        .when(F.col("relation_type") == "", "bad_relation")
        .otherwise("mapped")
    )
    return mapped.withColumn("reason", reason)


def gate_counts(classified: DataFrame) -> DataFrame:
    """Events per reason."""
    return classified.groupBy("reason").agg(F.sum("n").alias("events"))


def _partials_from_seed(seed: DataFrame) -> DataFrame:
    """Seed rows as mergeable partial edges; keys are cleaned and rows without a valid key dropped."""
    code = clean_text("relation_type")
    sources = list_text("source_datasets", "[;,|]+")
    return seed.select(
        clean_text("subject_org_id").alias("subject_org_id"), clean_text("object_org_id").alias("object_org_id"),
        clean_text("event_month").alias("event_month"),
        F.when(F.length(code) == 1, F.lpad(code, 2, "0")).otherwise(code).alias("relation_type"),
        clean_text("subject_name").alias("subject_name"), clean_text("object_name").alias("object_name"),
        to_long("event_count").alias("event_count"), to_long("icews_event_count").alias("a_count"),
        to_long("gdelt_event_count").alias("b_count"),
        F.when(F.size(sources) == 0, F.array(F.lit(FEED_A))).otherwise(sources).alias("sources"),
        to_double("confidence", SEED_CONFIDENCE).alias("confidence"),
        F.coalesce(F.nullif(clean_text("status"), F.lit("")), F.lit("active")).alias("status"),
        F.lit(True).alias("from_seed"), F.lit(False).alias("b_added"),
    ).where(
        (F.col("subject_org_id") != "") & (F.col("object_org_id") != "") & (F.col("event_month") != "")
        & F.col("relation_type").isin(*RELATION_CODES)
    )


def _partials_from_feed_b(counts: DataFrame) -> DataFrame:
    return counts.select(
        *KEY, "subject_name", "object_name",
        F.col("n").alias("event_count"), F.lit(0).cast("bigint").alias("a_count"), F.col("n").alias("b_count"),
        F.array(F.lit(FEED_B)).alias("sources"), F.lit(NEW_EDGE_CONFIDENCE).alias("confidence"),
        F.lit("active").alias("status"), F.lit(False).alias("from_seed"), F.lit(True).alias("b_added"),
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """Fold partial edges by key. Counts add up, source sets unite, a seed row names the edge and sets its base confidence."""
    # Seed rows rank before feed B rows wherever one value must be chosen.
    rank = F.struct((~F.col("from_seed")).alias("late"), F.col("subject_name"), F.col("object_name"))
    grouped = partials.groupBy(*KEY).agg(
        F.min_by(F.struct("subject_name", "object_name", "confidence", "status"), rank).alias("base"),
        F.sum("event_count").alias("event_count"),
        F.sum("a_count").alias("icews_event_count"),
        F.sum("b_count").alias("gdelt_event_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.bool_or("b_added").alias("b_added"),
    )
    cross = F.array_contains("sources", FEED_A) & F.array_contains("sources", FEED_B)
    raised = F.when(cross & F.col("b_added"), F.greatest("base.confidence", F.lit(CROSS_SOURCE_CONFIDENCE)))
    return grouped.select(
        edge_key().alias("edge_id"), *KEY, "base.subject_name", "base.object_name", "event_count",
        F.array_join("sources", ";").alias("source_datasets"), "icews_event_count", "gdelt_event_count",
        F.round(F.coalesce(raised, "base.confidence"), 4).alias("confidence"),
        F.col("base.status").alias("status"),
    )


def keep_edge(min_b_only: int = MIN_B_ONLY_EVENTS) -> Column:
    """Edges seen by feed A stay; edges of feed B alone need enough events."""
    sources = F.col("source_datasets")
    return sources.contains(FEED_A) | (sources.contains(FEED_B) & (F.col("gdelt_event_count") >= min_b_only))


def fused_edges(seed: DataFrame, classified: DataFrame, min_b_only: int = MIN_B_ONLY_EVENTS) -> DataFrame:
    """Seed and feed B in one union and one grouping (no outer join), then weak edges pruned.

    Feed B is summed by key and names first: only a number per group, so the event-sized
    shuffle is a hash aggregation, and the grouping that picks names and sources sees edges.
    """
    usable = classified.where("reason = 'mapped'").groupBy(
        *KEY, F.col("subject_canonical").alias("subject_name"), F.col("object_canonical").alias("object_name")
    ).agg(F.sum("n").alias("n"))
    partials = _partials_from_seed(seed).unionByName(_partials_from_feed_b(usable))
    return merge_partials(partials).where(keep_edge(min_b_only))


def daily_log(seed: DataFrame, classified: DataFrame, first_days: DataFrame | None = None) -> DataFrame:
    """Events processed, mapped and skipped per day, and how many mapped events opened or updated an edge.

    A key opens on its first feed B day unless the seed already holds it. First
    days come from one grouping by key, so no window over a day's events is needed. Rows of
    keys with days may be given apart (`first_days`); of the others day, reason and n count.
    """
    by_day = classified.where("reason <> 'bad_date'").groupBy("day").agg(
        F.sum("n").alias("processed_events"),
        F.sum(F.when(F.col("reason") == "mapped", F.col("n")).otherwise(0)).alias("mapped_events"),
    )
    keyed = classified.where("reason = 'mapped'") if first_days is None else first_days
    mapped = keyed.select(*KEY, "day", F.lit(False).alias("seeded"))
    seeded = _partials_from_seed(seed).select(*KEY, F.lit(None).cast("string").alias("day"), F.lit(True).alias("seeded"))
    opened = (
        mapped.unionByName(seeded).groupBy(*KEY)
        .agg(F.min("day").alias("day"), F.bool_or("seeded").alias("seeded"))
        .where("day is not null and not seeded").groupBy("day").agg(F.count(F.lit(1)).alias("new_edges"))
    )
    new = F.coalesce("new_edges", F.lit(0).cast("bigint"))
    return by_day.join(opened, "day", "left").select(
        F.col("day").alias("date"), F.substring("day", 1, 7).alias("event_month"),
        "processed_events", "mapped_events",
        (F.col("processed_events") - F.col("mapped_events")).alias("skipped_unmapped"),
        new.alias("new_edges"), (F.col("mapped_events") - new).alias("updated_edges"),
    )


def first_seen(classified: DataFrame) -> DataFrame:
    """First feed B day of every edge key."""
    return classified.where("reason = 'mapped'").groupBy(*KEY).agg(F.min("day").alias("first_day"))

