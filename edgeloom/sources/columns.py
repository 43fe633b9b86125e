"""Late column resolution: tables from different producers name the same field differently."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First existing name wins.
EDGE_ALIASES: Mapping[str, tuple[str, ...]] = {
    "edge_id": ("edge_id", "id"),
    "subject_org_id": ("subject_org_id", "subject_id", "source_org_id", "S"),
    "object_org_id": ("object_org_id", "object_id", "target_org_id", "O"),
    "subject_name": ("subject_name", "source_name", "Actor1Name"),
    "object_name": ("object_name", "target_name", "Actor2Name"),
    "relation_type": ("relation_type", "relation_code", "event_root_code", "cameo_root", "cameo_code", "P"),
    "event_month": ("month", "event_month", "event_date", "date"),
    "confidence": ("confidence", "final_confidence", "score"),
    "source_datasets": ("sources", "source_datasets", "dataset"),
    "icews_event_count": ("icews_event_count", "icews_count"),
    "gdelt_event_count": ("gdelt_event_count", "gdelt_count"),
    "num_mentions": ("num_mentions", "NumMentions"),
    "num_articles": ("num_articles", "NumArticles"),
    "is_derived_relation": ("is_derived_relation", "derived", "is_derived"),
}
REQUIRED_EDGE_FIELDS = ("subject_org_id", "object_org_id", "relation_type", "event_month")

FEED_A_ALIASES: Mapping[str, tuple[str, ...]] = {
    "source_name": ("source_name", "Source Name", "SourceName", "Source Actor", "Source"),
    "target_name": ("target_name", "Target Name", "TargetName", "Target Actor", "Target"),
    "event_date": ("event_date", "Event Date", "EventDate", "Date"),
    "code": ("cameo_code", "CAMEO Code", "CAMEOCode", "Event Code", "EventCode"),
    "city": ("city", "City"),
    "province": ("province", "Province", "State"),
    "country": ("country", "Country"),
    "publisher": ("publisher", "Publisher"),
    "story_id": ("story_id", "Story ID", "StoryID"),
    "sentence_number": ("sentence_number", "Sentence Number", "SentenceNumber"),
    "intensity": ("intensity", "Intensity"),
}


def find_column(df: DataFrame, names: Iterable[str], any_case: bool = False) -> str | None:
    present = set(df.columns)
    lowered = {c.lower(): c for c in df.columns} if any_case else {}
    for name in names:
        if name in present:
            return name
        if name.lower() in lowered:
            return lowered[name.lower()]
    return None


def resolve(df: DataFrame, names: Iterable[str], default: Column | None = None, any_case: bool = False) -> Column:
    """Column under the first existing name, else the default, else an error that lists what is there."""
    names = tuple(names)
    found = find_column(df, names, any_case)
    if found is not None:
        return F.col(f"`{found}`")
    if default is not None:
        return default
    raise ValueError(f"none of {names} among the columns {df.columns}")


def require(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing} among {df.columns}")
    return df


def with_missing(df: DataFrame, names: Iterable[str], value: Column | None = None) -> DataFrame:
    """Add absent optional columns as blank text."""
    absent = {n: (F.lit("") if value is None else value) for n in names if n not in df.columns}
    return df.withColumns(absent) if absent else df


def standard_edges(df: DataFrame) -> DataFrame:
    """Rename whatever an edge table calls its fields to the standard names; required fields must exist."""
    renames = {}
    for standard, names in EDGE_ALIASES.items():
        found = find_column(df, names)
        if found is None and standard in REQUIRED_EDGE_FIELDS:
            raise ValueError(f"edge table lacks {standard}; columns are {df.columns}")
        if found is not None and found != standard and standard not in df.columns:
            renames[found] = standard
    return df.withColumnsRenamed(renames)


def keep_existing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    present = set(df.columns)
    return df.select(*[F.col(f"`{n}`") for n in names if n in present])
