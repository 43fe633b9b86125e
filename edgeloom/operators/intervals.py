"""Month intervals of relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.constants import INTERVAL_STATUSES
from edgeloom.functions.codes import relation_strict
from edgeloom.functions.parse import clean_text, month_first_day, month_number, month_text, to_double, to_long
from edgeloom.operators.ids import dense_ids


def edge_intervals(edges: DataFrame, min_events: int = 1, min_confidence: float = 0.0) -> DataFrame:
    """One distinct interval (first to last day of the month) per usable edge, as text and as month ordinals."""
    status = clean_text("status") if "status" in edges.columns else F.lit("active")
    first = month_first_day("event_month")
    rows = edges.where(
        status.isin(*INTERVAL_STATUSES)
        & (to_long("event_count") >= min_events)
        & (to_double("confidence") >= min_confidence)
    ).select(
        clean_text("subject_org_id").alias("subject"),
        relation_strict("relation_type").alias("property"),
        clean_text("object_org_id").alias("object"),
        first.alias("first_day"),
    )
    usable = rows.where(
        "property <> '' and first_day is not null and subject <> '' and object <> '' and subject <> object"
    ).dropDuplicates()
    month = (F.year("first_day") * 12 + F.month("first_day") - 1).cast("int")
    return usable.select(
        "subject", "property", "object",
        F.date_format("first_day", "yyyyMMdd").alias("start_time"),
        F.date_format(F.last_day("first_day"), "yyyyMMdd").alias("end_time"),
        month.alias("start_no"), month.alias("end_no"),
    )


def with_interval_ids(intervals: DataFrame) -> DataFrame:
    """The interval table with dense ids in the order of subject, relation, object and time; instances then carry them."""
    return dense_ids(intervals, ["subject", "property", "object", "start_time", "end_time"], "interval_id", "I_%09d")


def numbered(intervals: DataFrame) -> DataFrame:
    """Interval table under edge-table names; month ordinals are parsed from the texts unless they are there."""
    start, end = (
        (F.col("start_no"), F.col("end_no")) if "start_no" in intervals.columns
        else (month_number("start_time"), month_number("end_time"))
    )
    return intervals.select(
        F.col("subject").alias("subject_org_id"), F.col("property").alias("relation_type"),
        F.col("object").alias("object_org_id"), start.alias("start_no"), end.alias("end_no"),
        *(["interval_id"] if "interval_id" in intervals.columns else []),
    )


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Consecutive or overlapping months of one subject, relation and object joined into runs.

    The window partition is one relation of one pair of organizations after
    duplicates are gone, so its size is bounded by the calendar.
    """
    key = ("subject_org_id", "relation_type", "object_org_id")
    order = Window.partitionBy(*key).orderBy("start_no", "end_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    distinct = intervals.select(*key, "start_no", "end_no").dropDuplicates()
    starts = distinct.withColumn(
        "starts", F.when(F.col("start_no") <= F.max("end_no").over(before) + 1, 0).otherwise(1)
    )
    runs = starts.withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.groupBy(*key, "run")
        .agg(F.min("start_no").alias("start_no"), F.max("end_no").alias("end_no"), F.count(F.lit(1)).alias("months"))
        .select(*key, "start_no", "end_no", "months")
        .withColumns({"start_month": month_text("start_no"), "end_month": month_text("end_no")})
    )
