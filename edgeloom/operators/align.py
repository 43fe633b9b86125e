"""Alignment of organization names: generic names out, equal clean names merged, aliases kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.constants import ORGANIZATION_COLUMNS
from edgeloom.functions.names import aligned_name, is_generic_org
from edgeloom.functions.parse import list_text
from edgeloom.operators.fuzzy import fuzzy_merge
from edgeloom.operators.ids import dense_ids
from edgeloom.sources.columns import with_missing

NAME_FIELDS = ("canonical_name", "raw_name", "normalized_name", "clean_name")


def cleaned(organizations: DataFrame) -> DataFrame:
    """Organizations with an alignment name; those whose own names are generic are dropped."""
    if "canonical_name" not in organizations.columns:
        organizations = organizations.withColumn(
            "canonical_name", F.col("raw_name") if "raw_name" in organizations.columns else F.lit("")
        )
    if "raw_name" not in organizations.columns:
        organizations = organizations.withColumn("raw_name", F.col("canonical_name"))
    named = organizations.withColumn("clean_name", aligned_name("canonical_name"))
    generic = F.lit(False)
    for field in NAME_FIELDS:
        if field in named.columns:
            generic = generic | is_generic_org(field)
    return named.where(~generic & (F.col("clean_name") != ""))


def survivors(named: DataFrame) -> DataFrame:
    """First organization (by id) of each clean name. A grouping with a map-side part, not a window."""
    fields = [c for c in named.columns if c != "clean_name"]
    grouped = named.groupBy("clean_name").agg(F.min_by(F.struct(*fields), "org_id").alias("row"))
    return grouped.select("clean_name", "row.*")


def alias_rows(named: DataFrame, kept: DataFrame) -> DataFrame:
    """Every non-generic name an organization goes by, under the id of its survivor."""
    extra = list_text("all_raw_names") if "all_raw_names" in named.columns else F.array().cast("array<string>")
    names = F.array_distinct(F.concat(F.array("canonical_name", "raw_name"), extra))
    owner = kept.select("clean_name", F.col("org_id").alias("old_org_id"))
    exploded = named.select("clean_name", F.explode(names).alias("alias")).where("alias <> '' and lower(alias) <> 'nan'")
    return (
        exploded.where(~is_generic_org("alias")).join(owner, "clean_name")
        .select("old_org_id", "alias", aligned_name("alias").alias("alias_clean"), F.lit("exact_clean").alias("match_type"))
        .groupBy("old_org_id", "alias_clean", "alias").agg(F.min("match_type").alias("match_type"))
    )


def redirect(aliases: DataFrame, merged: DataFrame) -> DataFrame:
    """Aliases of removed organizations moved to the survivor (old_org_id -> survivor_id)."""
    moved = merged.select(F.col("old_org_id").alias("_from"), "survivor_id")
    return aliases.join(moved, F.col("old_org_id") == F.col("_from"), "left").withColumn(
        "old_org_id", F.coalesce("survivor_id", "old_org_id")
    ).drop("_from", "survivor_id")


def align(organizations: DataFrame, fuzzy: bool = False) -> tuple[DataFrame, DataFrame]:
    """Aligned organizations with new dense ids, and their alias table."""
    named = cleaned(organizations)
    kept = survivors(named)
    found = alias_rows(named, kept)
    if fuzzy:
        merged = fuzzy_merge(kept)
        gone = merged.join(
            kept.select(F.col("org_id").alias("old_org_id"), "canonical_name", "clean_name"), "old_org_id"
        )
        extra = gone.select(
            F.col("survivor_id").alias("old_org_id"), F.col("canonical_name").alias("alias"),
            F.col("clean_name").alias("alias_clean"), F.concat(F.lit("fuzzy_"), F.round("ratio", 4)).alias("match_type"),
        )
        kept = kept.join(merged.select(F.col("old_org_id").alias("org_id")), "org_id", "left_anti")
        found = redirect(found, merged).unionByName(extra)
        found = found.groupBy("old_org_id", "alias_clean", "alias").agg(F.min("match_type").alias("match_type"))
    renamed = kept.withColumnRenamed("org_id", "_old").drop("old_org_id").withColumnRenamed("_old", "old_org_id")
    numbered = dense_ids(renamed, [F.asc("old_org_id")], "org_id", "ORG_%06d")
    table = with_missing(numbered, ORGANIZATION_COLUMNS).select(*ORGANIZATION_COLUMNS)
    aliases = found.join(table.select("old_org_id", "org_id"), "old_org_id").select(
        "org_id", "old_org_id", "alias", "alias_clean", "match_type"
    )
    return table, aliases
