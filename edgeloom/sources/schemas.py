"""Table layouts. Raw feeds are text only, so that codes such as 010 keep their zeros."""

from __future__ import annotations

from pyspark.sql import types as T


def text_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


FEED_A_COLUMNS = (
    "Event Date", "Source Name", "Source Sectors", "Target Name", "Target Sectors",
    "CAMEO Code", "City", "Province", "Country", "Publisher", "Story ID",
    "Sentence Number", "Intensity",
)
FEED_A_SCHEMA = text_schema(*FEED_A_COLUMNS)


def _geo(prefix: str) -> tuple[str, ...]:
    # Public GDELT 1.0 event layout: seven fields per geography block.
    return tuple(f"{prefix}Geo_{f}" for f in ("Type", "FullName", "CountryCode", "ADM1Code", "Lat", "Long", "FeatureID"))


def _actor(prefix: str) -> tuple[str, ...]:
    fields = ("Code", "Name", "CountryCode", "KnownGroupCode", "EthnicCode",
              "Religion1Code", "Religion2Code", "Type1Code", "Type2Code", "Type3Code")
    return tuple(f"{prefix}{f}" for f in fields)


FEED_B_COLUMNS = (
    "GLOBALEVENTID", "SQLDATE", "MonthYear", "Year", "FractionDate",
    *_actor("Actor1"), *_actor("Actor2"),
    "IsRootEvent", "EventCode", "EventBaseCode", "EventRootCode", "QuadClass",
    "GoldsteinScale", "NumMentions", "NumSources", "NumArticles", "AvgTone",
    *_geo("Actor1"), *_geo("Actor2"), *_geo("Action"),
    "DATEADDED", "SOURCEURL",
)
FEED_B_SCHEMA = text_schema(*FEED_B_COLUMNS)

FEED_B_USED = (
    "SQLDATE", "Actor1Name", "Actor1KnownGroupCode", "Actor1Type1Code", "Actor1Type2Code", "Actor1Type3Code",
    "Actor2Name", "Actor2KnownGroupCode", "Actor2Type1Code", "Actor2Type2Code", "Actor2Type3Code",
    "EventCode", "EventRootCode", "QuadClass", "GoldsteinScale", "NumMentions",
    "NumSources", "NumArticles", "AvgTone", "SOURCEURL",
)

INTERVAL_TEXT_SCHEMA = text_schema("subject", "property", "object", "start_time", "end_time")

EDGE_SCHEMA = T.StructType([
    T.StructField("edge_id", T.StringType()),
    T.StructField("subject_org_id", T.StringType()),
    T.StructField("object_org_id", T.StringType()),
    T.StructField("event_month", T.StringType()),
    T.StructField("relation_type", T.StringType()),
    T.StructField("subject_name", T.StringType()),
    T.StructField("object_name", T.StringType()),
    T.StructField("event_count", T.LongType()),
    T.StructField("source_datasets", T.StringType()),
    T.StructField("icews_event_count", T.LongType()),
    T.StructField("gdelt_event_count", T.LongType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("status", T.StringType()),
])

RESPONSE_ITEM = T.StructType([
    T.StructField("constraint_name", T.StringType()),
    T.StructField("relation_a", T.StringType()),
    T.StructField("relation_b", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("forbidden_temporal_relation", T.StringType()),
    T.StructField("allowed_temporal_relations", T.ArrayType(T.StringType())),
    T.StructField("hard_or_soft", T.StringType()),
    T.StructField("expected_action", T.StringType()),
    T.StructField("typical_positive_example", T.StringType()),
    T.StructField("typical_negative_example", T.StringType()),
    T.StructField("exception", T.StringType()),
    T.StructField("reason", T.StringType()),
])

TIMELINE_LINK = T.StructType([
    *[T.StructField(n, T.StringType()) for n in (
        "source", "target", "source_name", "target_name", "source_org_id", "target_org_id",
        "edge_id", "relation", "relation_code", "relation_label", "edge_label")],
    T.StructField("confidence", T.DoubleType()),
    T.StructField("original_confidence", T.DoubleType()),
    *[T.StructField(n, T.StringType()) for n in (
        "status", "status_label", "update_action", "update_action_label", "sources",
        "triggered_constraint_ids", "triggered_constraint_keys", "triggered_mutex_relations",
        "triggered_mutex_relations_label", "update_reason")],
    T.StructField("is_mutex_triggered", T.BooleanType()),
])
TIMELINE_NODE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("org_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("symbolSize", T.LongType()),
    T.StructField("value", T.LongType()),
])
TIMELINE_SCHEMA = T.StructType([
    T.StructField("month", T.StringType()),
    T.StructField("nodes", T.ArrayType(TIMELINE_NODE)),
    T.StructField("links", T.ArrayType(TIMELINE_LINK)),
])
