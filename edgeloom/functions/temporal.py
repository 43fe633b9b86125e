"""Relations between month intervals, given as month ordinals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom.constants import DISJOINT_RELATIONS, OVERLAP_RELATIONS
from edgeloom.functions.parse import ColumnLike, clean_text, col


def interval_relation(a_start: ColumnLike, a_end: ColumnLike, b_start: ColumnLike, b_end: ColumnLike) -> Column:
    """One of before, after, meet, equal, contains, during, overlap. Adjacent months meet, either way round."""
    a1, a2, b1, b2 = col(a_start), col(a_end), col(b_start), col(b_end)
    return (
        F.when((a2 + 1 == b1) | (b2 + 1 == a1), "meet")
        .when(a2 < b1, "before")
        .when(b2 < a1, "after")
        .when((a1 == b1) & (a2 == b2), "equal")
        .when((a1 <= b1) & (a2 >= b2), "contains")
        .when((a1 >= b1) & (a2 <= b2), "during")
        .otherwise("overlap")
    )


def exclusion_truth(relation: ColumnLike, forbidden: ColumnLike) -> Column:
    """Does an interval pair support (1), violate (-1) or say nothing (0) about a forbidden time relation?"""
    r = col(relation)
    f = F.coalesce(F.nullif(clean_text(forbidden), F.lit("")), F.lit("overlap"))
    any_overlap = f.isin("overlap", "same_month")
    return (
        F.when((any_overlap & r.isin(*OVERLAP_RELATIONS)) | (~any_overlap & (r == f)), -1)
        .when(r.isin(*DISJOINT_RELATIONS), 1)
        .otherwise(0)
    )


#: A node of the dyadic tree over months is level * NODE + index; it covers 2 ** level months from index * 2 ** level.
NODE = 1 << 40


def dyadic_nodes(start: ColumnLike, end: ColumnLike) -> Column:
    """The canonical nodes of a closed interval, disjoint and at most two for each level: every month in it has exactly one of them above it."""
    first, stop = col(start).cast("bigint"), col(end).cast("bigint") + 1
    levels = F.sequence(F.lit(0), F.length(F.bin(stop - first)) - 1)

    def at(level: Column) -> Column:
        # What the levels below have left of the interval, in nodes of this level.
        power = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        low, high = F.floor((first + power - 1) / power), F.floor(stop / power)
        odd_low, odd_high = F.pmod(low, F.lit(2)) == 1, F.pmod(high, F.lit(2)) == 1
        left = F.when(odd_low & (low < high), level * NODE + low)
        right = F.when(odd_high & (high - 1 >= low + odd_low.cast("bigint")), level * NODE + high - 1)
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(levels, at)), lambda node: node.isNotNull())


def node_levels(nodes: ColumnLike) -> Column:
    """The levels of nodes, a bit for each."""
    return F.aggregate(col(nodes), F.lit(0).cast("bigint"), lambda held, node: held.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.floor(node / NODE).cast("int"))))


def dyadic_ancestors(month: ColumnLike, levels: ColumnLike) -> Column:
    """The nodes above a month, at the levels whose bits are set."""
    point, mask = col(month).cast("bigint"), col(levels)
    every = F.sequence(F.lit(0), F.length(F.bin(mask)) - 1)
    used = F.filter(every, lambda level: F.call_function("shiftright", mask, level).bitwiseAND(F.lit(1)) == 1)
    return F.transform(used, lambda level: level * NODE + F.floor(point / F.call_function("shiftleft", F.lit(1).cast("bigint"), level)))
