"""Comparisons of groups in blocks of bounded size.

A component's members and those to be compared with it are each dealt to chunks of about
CHUNK sets by hash; a block is a chunk of one with a chunk of the other. A task compares the
sets of a block exactly and returns links alone, so what doesn't match makes no row, however
many pairs there are, and a component of any size is spread over as many blocks as it takes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.components import components
from edgeloom.session import cut_lineage

CHUNK = 512


def linked_to_components(asked: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between each class asked and a member of the component it is asked of: one for each block that has any.

    `asked` has class and component; `labels` the component of each class that isn't its own;
    `sets` the distinct shingles of each, as sorted unsigned 64-bit hashes in bigints.
    """
    asked = cut_lineage(asked)
    wanted = asked.groupBy("component").agg(F.count(F.lit(1)).alias("others"))
    members = labels.select("class", "component").unionByName(asked.select(F.col("component").alias("class"), "component")).distinct()
    members = cut_lineage(members.join(wanted, "component"))
    sizes = members.groupBy("component", "others").agg(F.count(F.lit(1)).alias("own"))
    dealt = sizes.select("component", F.ceil(F.col("own") / chunk).cast("int").alias("rows"), F.ceil(F.col("others") / chunk).cast("int").alias("columns"))

    def placed(frame: DataFrame, own: str, other: str) -> DataFrame:
        """Each set in a chunk of its side, once for each chunk of the other."""
        return frame.select("class", "component").join(dealt, "component").select(
            "class", "component", F.pmod(F.xxhash64("class"), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other),
        ).join(sets, "class").select(*(F.col(c).alias(c) for c in ("component", "rows", "columns", "class", "shingles")))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_links(left, right, percent)) if len(left) and len(right) else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    keys = ["component", "rows", "columns"]
    grid = placed(members, "rows", "columns").groupBy(*keys).cogroup(placed(asked, "columns", "rows").groupBy(*keys))
    return grid.applyInArrow(compare, "a bigint, b bigint")


def squares(rows: DataFrame, group: list[str], key: str, chunk: int = CHUNK) -> DataFrame:
    """The rows of each group in blocks (row, column) of two chunks of about `chunk` rows, row <= column, so that any two
    rows meet in just one; `half` is 0 for the chunk of the row and 1 for that of the column."""
    rows = cut_lineage(rows)
    sizes = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    dealt = rows.join(sizes, group).withColumn("own_chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumns({
        "row": F.least("own_chunk", "other"), "column": F.greatest("own_chunk", "other"), "half": (F.col("own_chunk") > F.col("other")).cast("int"),
    }).drop("own_chunk", "other", "chunks")


def _links(members: pa.Table, asked: pa.Table, percent: int):
    """The first match of each set asked among the members."""
    column = members.column("shingles").combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    owners, values = np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy()
    names = members.column("class").to_pylist()
    order = np.argsort(values, kind="stable")
    owners, values = owners[order], values[order]
    for name, own in zip(asked.column("class").to_pylist(), asked.column("shingles").combine_chunks(), strict=True):
        mine = np.sort(own.values.to_numpy())
        first, last = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
        # The owners of all places from first to last, one after the other.
        runs = last - first
        at = np.arange(runs.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs)
        common = np.bincount(owners[at], minlength=len(sizes))
        hit = np.flatnonzero(common * 100 >= (sizes + len(mine) - common) * percent)
        hit = [k for k in hit.tolist() if names[k] != name]
        if hit:
            yield min(name, names[hit[0]]), max(name, names[hit[0]])


def outside(met: DataFrame, labels: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """The rows of `met` (with class) outside the largest component of their group, and (class, component) with that component.

    Groups of one component are left out. `labels` has the component of each class that isn't its own.
    """
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    named = met.join(labels.join(sizes, "component"), "class", "left").select(*met.columns, F.coalesce("component", "class").alias("own"), F.coalesce("n", F.lit(1)).alias("n"))
    large = named.groupBy(group).agg(F.max(F.struct("n", "own")).alias("large"), F.min("own").alias("low"), F.max("own").alias("high")).where("low < high")
    others = cut_lineage(named.join(large.select(group, F.col("large.own").alias("large")), group).where("own <> large").select(*met.columns, "large"))
    return others.select(*met.columns), others.select("class", F.col("large").alias("component")).distinct()


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (class, component) after more links (a, b) of classes, as a stage table."""
    one, other = (labels.select(F.col("class").alias(c), F.col("component").alias(o)) for c, o in (("a", "x"), ("b", "y")))
    between = cut_lineage(links.join(one, "a", "left").join(other, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    moved = components(between)
    new = between.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(labels.select("class"), "class", "left_anti").withColumn("component", F.col("class"))
    known = labels.unionByName(new)
    return cut_lineage(known.join(moved, known["component"] == moved["node"], "left").select("class", F.coalesce(moved["component"], known["component"]).alias("component")))
