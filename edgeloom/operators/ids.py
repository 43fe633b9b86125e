"""Dense ids over a global order, without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.session import cut_lineage

_ROW_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in its low 33 bits


def dense_ids(df: DataFrame, order: Sequence[Column | str], name: str, fmt: str = "%d", partitions: int | None = None) -> DataFrame:
    """Number rows 1..n in the given total order.

    Rows are range-partitioned and sorted, each partition numbers its own rows,
    and the row counts of the partitions before it (one small row per partition)
    shift the numbers. The sorted rows are checkpointed, so both passes see the
    same partitions even when an executor is lost in between.
    """
    order = list(order)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    local = ranged.sortWithinPartitions(*order).withColumn("_position", F.monotonically_increasing_id())
    placed = cut_lineage(
        local.withColumns({"_part": F.shiftright("_position", 33), "_row": F.col("_position").bitwiseAND(F.lit(_ROW_MASK))}).drop("_position")
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("k"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_offset"))
    number = F.col("_offset") + F.col("_row") + 1
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.format_string(fmt, number)).drop("_part", "_row", "_offset")
