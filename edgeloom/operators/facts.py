"""Feed A events to facts, evidence and seed edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.constants import FEED_A, SEED_CONFIDENCE
from edgeloom.functions.codes import event_code_padded, relation_from_padded
from edgeloom.functions.names import lookup_name
from edgeloom.functions.parse import clean_text
from edgeloom.operators.dictionary import hot_names, look_up
from edgeloom.session import cut_lineage
from edgeloom.sources.columns import FEED_A_ALIASES, find_column

KEY = ("subject_org_id", "object_org_id", "event_month", "relation_type")


def edge_key() -> Column:
    """Natural edge id. Within one subject, object and month it sorts like a dense id would: by relation."""
    return F.concat_ws("|", "event_month", "subject_org_id", "object_org_id", "relation_type")


def date_range(events: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Rows whose parsed date lies in a closed range; unreadable dates go."""
    return events.where(F.try_to_date(F.col(f"`{column}`")).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def number_range(events: DataFrame, column: str, first: int, last: int) -> DataFrame:
    """Rows whose YYYYMMDD number lies in a closed range; text that is no number goes."""
    return events.where(F.col(f"`{column}`").try_cast("double").between(first, last))


def standard_feed_a(events: DataFrame) -> DataFrame:
    """Feed A under standard names, whatever its header calls them; rows with unreadable dates dropped."""
    picked = []
    for standard, names in FEED_A_ALIASES.items():
        found = find_column(events, names, any_case=True)
        if found is None and standard in ("source_name", "target_name", "event_date", "code"):
            raise ValueError(f"feed lacks {standard}; columns are {events.columns}")
        picked.append((F.lit("") if found is None else F.col(f"`{found}`")).alias(standard))
    if "event_seq" in events.columns:
        picked.append(F.col("event_seq"))
    else:
        picked.append(F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("event_seq"))
    dated = events.select(*picked).withColumn("event_date", F.try_to_date("event_date"))
    return dated.where("event_date is not null")


def location_text(city: str = "city", province: str = "province", country: str = "country") -> Column:
    return F.concat_ws(", ", *[F.nullif(clean_text(c), F.lit("")) for c in (city, province, country)])


def event_facts(events: DataFrame, dictionary: DataFrame, spread: bool = True) -> DataFrame:
    """One row per usable feed A event: both ends mapped, relation within the 20 codes.

    Rows are events here, so a hot name holds many. With `spread`, hot names are found first, in
    one pass over the names, and looked up apart from the rest.
    """
    prepared = standard_feed_a(events).withColumns({
        "relation_type": relation_from_padded("code"),
        "event_code": event_code_padded("code"),
        "_subject_key": lookup_name("source_name"),
        "_object_key": lookup_name("target_name"),
    }).where("relation_type <> '' and _subject_key <> '' and _object_key <> ''")
    hot = hot_names(prepared, "_subject_key", "_object_key") if spread else {}
    mapped = look_up(prepared, dictionary, "_subject_key", "subject", hot=hot.get("_subject_key", ()))
    mapped = look_up(mapped, dictionary, "_object_key", "object", hot=hot.get("_object_key", ()))
    return mapped.select(
        F.lit(FEED_A).alias("source_dataset"),
        "subject_org_id", F.col("source_name").alias("subject_name"),
        "object_org_id", F.col("target_name").alias("object_name"),
        "event_code",
        F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
        F.date_format("event_date", "yyyy-MM").alias("event_month"),
        location_text().alias("location"),
        "relation_type", "intensity",
        F.lit("").alias("num_sources"), F.lit("").alias("num_articles"), F.lit("").alias("num_mentions"),
        F.coalesce("publisher", F.lit("")).alias("publisher"),
        F.coalesce("story_id", F.lit("")).alias("story_id"),
        F.coalesce("sentence_number", F.lit("")).alias("sentence_number"),
        "event_seq",
    )


FACT_COLUMNS = (
    "source_dataset", "subject_org_id", "subject_name", "object_org_id", "object_name", "event_code",
    "event_date", "event_month", "location", "relation_type", "intensity", "num_sources", "num_articles",
    "num_mentions",
)


def evidence_table(facts: DataFrame) -> DataFrame:
    return facts.select(
        "event_seq", "source_dataset", "publisher", "story_id", "sentence_number", F.lit("").alias("source_url")
    )


def seed_edges(events: DataFrame, dictionary: DataFrame, hot: Sequence[str] = ()) -> DataFrame:
    """Seed edges straight from the feed, pre-aggregated by raw names before any name is cleaned or joined.

    A hot actor shrinks to its distinct partners, months and codes in the
    map-side part of the first grouping, so the lookups never see its events.
    That grouping keeps only numbers per key and so runs as a hash aggregation. Its result is a
    stage table, else Spark would move the tests of names and codes below it, to every event.
    Names that are hot even then may be given.
    """
    raw = standard_feed_a(events).select(
        "source_name", "target_name", "code", F.date_format("event_date", "yyyy-MM").alias("event_month"),
        F.unix_date("event_date").alias("day"),
    )
    counted = raw.groupBy("source_name", "target_name", "code", "event_month").agg(
        F.count(F.lit(1)).alias("n"), F.min("day").alias("day")
    )
    prepared = cut_lineage(counted).withColumns({
        "relation_type": relation_from_padded("code"),
        "_subject_key": lookup_name("source_name"),
        "_object_key": lookup_name("target_name"),
    }).where("relation_type <> '' and _subject_key <> '' and _object_key <> ''")
    mapped = look_up(prepared, dictionary, "_subject_key", "subject", hot=hot)
    mapped = look_up(mapped, dictionary, "_object_key", "object", hot=hot)
    names = F.struct(F.col("source_name").alias("subject_name"), F.col("target_name").alias("object_name"))
    grouped = mapped.groupBy(*KEY).agg(
        F.min_by(names, F.struct("day", "source_name", "target_name")).alias("names"), F.sum("n").alias("event_count")
    )
    return _seed_columns(grouped)


def _seed_columns(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        edge_key().alias("edge_id"), *KEY, "names.subject_name", "names.object_name", "event_count",
        F.lit(FEED_A).alias("source_datasets"),
        F.col("event_count").alias("icews_event_count"),
        F.lit(0).cast("bigint").alias("gdelt_event_count"),
        F.lit(SEED_CONFIDENCE).alias("confidence"),
        F.lit("active").alias("status"),
    )
