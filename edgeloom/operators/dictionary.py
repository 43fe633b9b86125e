"""Name dictionary and the lookups against it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.names import light_name, lookup_name

NAME_COLUMNS = ("canonical_name", "raw_name", "clean_name", "normalized_name")
ALIAS_COLUMNS = ("alias", "alias_clean")


def _unpivot(df: DataFrame, columns: tuple[str, ...], kind: int) -> DataFrame:
    """Long form of the name columns; priority orders writes, so that the largest is the last one."""
    present = [c for c in columns if c in df.columns]
    entries = F.array(*[
        F.struct(F.col(c).alias("name"), F.lit(i).alias("position")) for i, c in enumerate(present)
    ])
    canonical = F.col("canonical_name") if "canonical_name" in df.columns else F.lit(None).cast("string")
    row_key = F.col(present[0])
    return df.select("org_id", canonical.alias("canonical_name"), row_key.alias("row_key"), F.explode(entries).alias("e")).select(
        "org_id", "canonical_name", F.col("e.name").alias("name"),
        F.struct(F.lit(kind).alias("kind"), F.col("org_id").alias("org_id"), "row_key", F.col("e.position").alias("position")).alias("priority"),
    )


def name_dictionary(
    organizations: DataFrame,
    aliases: DataFrame | None = None,
    normalizer: Callable[[Column], Column] = lookup_name,
) -> DataFrame:
    """One row per normalized name: org_id and canonical_name of its last writer (aliases write after organizations)."""
    names = _unpivot(organizations, NAME_COLUMNS, 0)
    if aliases is not None:
        names = names.unionByName(_unpivot(aliases, ALIAS_COLUMNS, 1))
    return (
        names.select(normalizer(F.col("name")).alias("name_key"), "org_id", "canonical_name", "priority")
        .where("name_key <> ''")
        .groupBy("name_key")
        .agg(F.max_by(F.struct("org_id", "canonical_name"), "priority").alias("entry"))
        .select("name_key", "entry.org_id", "entry.canonical_name")
    )


def feed_a_dictionary(organizations: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    return name_dictionary(organizations, aliases, lookup_name)


def feed_b_dictionary(organizations: DataFrame) -> DataFrame:
    return name_dictionary(organizations, None, light_name)


def hot_names(events: DataFrame, *keys: str, most: int = 50_000) -> dict[str, list[str]]:
    """Per key column the names that hold over half a shuffle partition of the rows.

    One pass: each task keeps a frequent-items sketch of bounded size, and the sketches are
    merged. There cannot be more than two such names for each partition. The sketch may
    overstate a count, so a name may be called hot that just isn't; none that is hot is missed.
    """
    partitions = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = min(2 * partitions, most)
    sketches = [F.expr(f"approx_top_k({key}, {k}, {min(32 * k, 1_000_000)})").alias(key) for key in keys]
    found = events.agg(F.count(F.lit(1)).alias("n"), *sketches).first()
    return {key: [x["item"] for x in found[key] or () if x["item"] is not None and x["count"] * 2 * partitions > found["n"]] for key in keys}


def look_up(
    events: DataFrame, dictionary: DataFrame, key: str, prefix: str, how: str = "inner", hot: Sequence[str] = (),
) -> DataFrame:
    """Attach org id and canonical name for a normalized name column.

    Rows with `hot` names (see `hot_names`, which bounds their number) never enter a shuffle:
    their dictionary rows, one for each name, are broadcast. The rest meets the dictionary
    in a join that Spark's size check picks.
    """
    table = dictionary.select(
        F.col("name_key").alias("_key"),
        F.col("org_id").alias(f"{prefix}_org_id"),
        F.col("canonical_name").alias(f"{prefix}_canonical"),
    )
    condition = F.col(key) == F.col("_key")
    if not hot:
        return events.join(table, condition, how).drop("_key")
    names = F.broadcast(events.sparkSession.createDataFrame([(n,) for n in hot], "_hot string"))
    common = events.join(names, F.col(key) == F.col("_hot"), "left_semi").join(
        F.broadcast(table.join(names, F.col("_key") == F.col("_hot"), "left_semi")), condition, how)
    rest = events.join(names, F.col(key) == F.col("_hot"), "left_anti").join(table, condition, how)
    return common.unionByName(rest).drop("_key")
