"""Actors of both feeds, and the organizations among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.constants import FEED_A, FEED_B, MIN_ACTOR_FREQUENCY, TARGET_ORGANIZATIONS
from edgeloom.functions.names import (
    alias_name,
    has_org_name,
    is_bad_name,
    is_org_sector,
    is_org_type,
    light_name,
    packed_types,
    sector_list,
)
from edgeloom.functions.parse import clean_text
from edgeloom.operators.ids import dense_ids
from edgeloom.session import cut_lineage

LATEST = 2**31 - 1  # unreadable dates sort last


def feed_a_hits(events: DataFrame) -> DataFrame:
    """Hits per name and sector: one per sector and side; a side without sectors gives one hit.

    Events are counted per name and sector text before that text is split.
    """
    day = F.coalesce(F.unix_date(F.try_to_date(F.col("`Event Date`"))), F.lit(LATEST))
    sides = F.array(*[
        F.struct(F.col(f"`{side} Name`").alias("name"), F.col(f"`{side} Sectors`").alias("sectors")) for side in ("Source", "Target")
    ])
    counted = events.select(day.alias("day"), F.inline(sides)).groupBy("name", "sectors").agg(
        F.count(F.lit(1)).alias("n"), F.min("day").alias("day")
    )
    return counted.select("name", "n", "day", F.explode_outer(sector_list("sectors")).alias("sector_info")).select(
        "name", F.lit(None).cast("string").alias("type_info"), "sector_info", F.lit(FEED_A).alias("source"), "n",
        F.lit(0).alias("feed"), "day",
    )


def feed_b_hits(events: DataFrame) -> DataFrame:
    """Hits per name and packed type codes: one per side of an event, counted before the codes are packed."""
    day = F.coalesce(F.col("SQLDATE").try_cast("int"), F.lit(LATEST))
    fields = ("KnownGroupCode", "Type1Code", "Type2Code", "Type3Code")
    sides = F.array(*[
        F.struct(F.col(f"{p}Name").alias("name"), *[F.col(f"{p}{f}").alias(f) for f in fields]) for p in ("Actor1", "Actor2")
    ])
    counted = events.select(day.alias("day"), F.inline(sides)).groupBy("name", *fields).agg(
        F.count(F.lit(1)).alias("n"), F.min("day").alias("day")
    )
    return counted.select(
        "name", packed_types(*fields).alias("type_info"), F.lit(None).cast("string").alias("sector_info"),
        F.lit(FEED_B).alias("source"), "n", F.lit(1).alias("feed"), "day",
    )


def actors(*hits: DataFrame) -> DataFrame:
    """Hits grouped by normalized name: frequency, first raw name (feed A first, then by day), and the sets of sources, types and sectors."""
    union = hits[0]
    for more in hits[1:]:
        union = union.unionByName(more)
    # Blank names go after the groupings, by a number: a test of the name would move below them, to every event.
    named = union.withColumn("normalized_name", light_name("name"))
    # The first grouping keeps two numbers, so it is a hash aggregation; texts are picked and gathered from what it leaves.
    first = (F.col("feed").cast("bigint") * (1 << 32) + F.col("day")).alias("first")
    texts = ("normalized_name", "name", "source", "type_info", "sector_info")
    size = F.length("normalized_name").alias("size")
    counted = named.select(*texts, "n", first, size).groupBy(*texts).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("size").alias("size")).where("size > 0")
    grouped = counted.groupBy("normalized_name").agg(
        F.min_by(clean_text("name"), F.struct("first", "name")).alias("raw_name"),
        F.sum("n").alias("frequency"),
        F.array_sort(F.collect_set("source")).alias("source_set"),
        F.array_sort(F.collect_set("type_info")).alias("type_set"),
        F.array_sort(F.collect_set("sector_info")).alias("sector_set"),
    )
    return grouped.select(
        "raw_name", "normalized_name", "frequency", F.size("source_set").cast("bigint").alias("source_count"),
        F.array_join("source_set", ";").alias("sources"), F.array_join("type_set", ";").alias("type_info"),
        F.array_join("sector_set", ";").alias("sector_info"), F.col("frequency").alias("org_signal"),
        F.exists("type_set", is_org_type).alias("typed"), F.exists("sector_set", is_org_sector).alias("in_org_sector"),
    )


CANDIDATE_COLUMNS = (
    "raw_name", "normalized_name", "frequency", "source_count", "sources", "type_info", "sector_info", "org_signal",
)


def _is_candidate(min_frequency: int) -> Column:
    return ~is_bad_name("normalized_name") & (F.col("frequency") >= min_frequency)


def actor_candidates(found: DataFrame, min_frequency: int = MIN_ACTOR_FREQUENCY) -> DataFrame:
    return found.where(_is_candidate(min_frequency)).select(*CANDIDATE_COLUMNS)


def organization_actors(found: DataFrame, target: int = TARGET_ORGANIZATIONS, min_frequency: int = MIN_ACTOR_FREQUENCY) -> DataFrame:
    """Actors with an organization signal, topped up to a target size with the most frequent others.

    The top-up takes any actor that is frequent enough, and happens only when
    at least one organization passed. How many are missing is a count of the
    passed ones, read inside the job (one row), not on the driver. Actors are a stage table, as
    they are read three times: the feeds behind them only once.
    """
    signal = has_org_name("normalized_name") | F.col("typed") | F.col("in_org_sector")
    marked = cut_lineage(found).withColumn("passed", _is_candidate(min_frequency) & signal)
    passed = marked.where("passed")
    order = (F.desc("frequency"), F.desc("source_count"), F.asc("normalized_name"))
    # At most `target` rows survive the limit (top-k per partition, then merged); only they get a rank.
    others = marked.where(~F.col("passed") & (F.col("frequency") >= min_frequency)).orderBy(*order).limit(target)
    ranked = others.withColumn("_row", F.row_number().over(Window.orderBy(*order)))
    held = passed.agg(F.count(F.lit(1)).alias("_held"))
    fill = ranked.join(F.broadcast(held)).where((F.col("_held") > 0) & (F.col("_row") <= target - F.col("_held")))
    return passed.unionByName(fill.drop("_row", "_held"))


def organizations(found: DataFrame, target: int = TARGET_ORGANIZATIONS, min_frequency: int = MIN_ACTOR_FREQUENCY) -> DataFrame:
    """Organization table with dense ids by frequency."""
    chosen = organization_actors(found, target, min_frequency)
    ranked = dense_ids(chosen, [F.desc("frequency"), F.desc("source_count"), F.asc("normalized_name")], "org_id", "ORG_%06d")
    return ranked.select(
        "org_id", F.col("normalized_name").alias("canonical_name"), "raw_name", "normalized_name",
        alias_name("normalized_name").alias("clean_name"), "frequency", "source_count", "sources", "type_info",
        "sector_info", "org_signal", F.col("org_id").alias("old_org_id"),
    )
