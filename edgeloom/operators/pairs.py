"""Interval pairs of two relations on the same subject and object.

Counting pairs needs no pairs. Within one (subject, object) the disjoint pairs
of two relations follow from running counts along the month axis, so the work
is linear in the intervals instead of quadratic. Only intervals that really
share a month are ever matched row by row, through a dyadic tree over the months.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.constants import DISJOINT_RELATIONS, OVERLAP_RELATIONS, RELATION_CODES
from edgeloom.functions.parse import month_text, ratio
from edgeloom.functions.temporal import dyadic_ancestors, dyadic_nodes, interval_relation, node_levels

PAIR = ("subject_org_id", "object_org_id")
RELATION_KINDS = ("before", "after", "meet", "overlap", "during", "contains", "equal")
COUNT_COLUMNS = tuple(f"{k}_count" for k in RELATION_KINDS)


def _distinct_intervals(intervals: DataFrame, relations: Sequence[str]) -> DataFrame:
    """Equal intervals collapse to one row with a multiplicity, before anything is compared."""
    return (
        intervals.where(F.col("relation_type").isin(*relations))
        .groupBy(*PAIR, "relation_type", "start_no", "end_no").agg(F.count(F.lit(1)).alias("n"))
    )


def pair_counts(intervals: DataFrame, relations: Sequence[str] = RELATION_CODES) -> DataFrame:
    """Per subject, object and ordered relation pair: how many interval pairs stand in each time relation.

    Columns: relation_a < relation_b, the seven counts as seen from a, and their
    sum comparable_count.
    """
    relations = tuple(relations)
    # Distinct intervals of one pair of organizations are bounded by calendar and codes, so they may share a
    # partition; placed that way once, the groupings and the window below need no further shuffle.
    distinct = _distinct_intervals(intervals, relations).repartition(*PAIR)
    steps = _disjoint_counts(distinct, relations)
    shared = _shared_counts(distinct)
    long = steps.unionByName(shared, allowMissingColumns=True).na.fill(0)
    sums = long.groupBy(*PAIR, "relation_a", "relation_b").agg(*[F.sum(c).alias(c) for c in COUNT_COLUMNS])
    with_total = sums.withColumn("comparable_count", sum((F.col(c) for c in COUNT_COLUMNS), F.lit(0).cast("bigint")))
    return with_total.where("comparable_count > 0")


def _disjoint_counts(distinct: DataFrame, relations: Sequence[str]) -> DataFrame:
    """Before, after and meet counts from running totals of interval ends.

    For an interval of relation r that starts in month m, every interval ended
    by m - 1 is disjoint and earlier; those ended in m - 1 exactly meet it. One
    window over (subject, object) by month carries the running ends of all
    relations at once.
    """
    marks = distinct.select(
        *PAIR, "relation_type",
        F.explode(F.array(
            F.struct(F.col("end_no").alias("month_no"), F.col("n").alias("ends"), F.lit(0).cast("bigint").alias("starts")),
            F.struct(F.col("start_no").alias("month_no"), F.lit(0).cast("bigint").alias("ends"), F.col("n").alias("starts")),
        )).alias("m"),
    ).select(*PAIR, "relation_type", "m.*")
    # One row per pair of organizations and month, one column per relation: the window then runs over months only.
    # (Given as SQL text: the expressions repeat per relation.)
    numbered = list(enumerate(relations))
    monthly = marks.groupBy(*PAIR, "month_no").agg(*[
        F.expr(f"sum(if(relation_type = '{r}', {c}, 0)) AS {c}_{i}") for c in ("ends", "starts") for i, r in numbered
    ])
    axis = Window.partitionBy(*PAIR).orderBy("month_no")
    zero = F.lit(0).cast("bigint")
    over = "PARTITION BY subject_org_id, object_org_id ORDER BY month_no"
    earlier = f"{over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    entries = F.expr("array(" + ", ".join(
        f"struct('{r}' AS other, coalesce(sum(ends_{i}) OVER ({earlier}), 0L) AS k, lag(ends_{i}, 1, 0L) OVER ({over}) AS last)"
        for i, r in numbered
    ) + ")")
    starting = F.expr("array(" + ", ".join(f"struct('{r}' AS relation_type, starts_{i} AS starts)" for i, r in numbered) + ")")
    probed = monthly.select(
        *PAIR, F.filter(starting, lambda x: x["starts"] > 0).alias("starting"),
        F.filter(entries, lambda x: x["k"] > 0).alias("entries"),
        (F.lag("month_no").over(axis) == F.col("month_no") - 1).alias("adjacent"),
    )
    spread = probed.select(*PAIR, "adjacent", "entries", F.inline("starting")).select(
        *PAIR, "adjacent", "relation_type", "starts", F.inline("entries")
    ).where("other <> relation_type").select(
        *PAIR, "relation_type", "other", (F.col("starts") * F.col("k")).alias("disjoint"),
        F.when(F.col("adjacent"), F.col("starts") * F.col("last")).otherwise(zero).alias("meeting"),
    )
    # The earlier interval belongs to "other": seen from the smaller code that is before, else after.
    other_first = F.col("other") < F.col("relation_type")
    apart = F.col("disjoint") - F.col("meeting")
    return spread.select(
        *PAIR,
        F.least("other", "relation_type").alias("relation_a"), F.greatest("other", "relation_type").alias("relation_b"),
        F.when(other_first, apart).otherwise(0).alias("before_count"),
        F.when(other_first, 0).otherwise(apart).alias("after_count"),
        F.col("meeting").alias("meet_count"),
    )


def shared_month_pairs(distinct: DataFrame) -> DataFrame:
    """Interval pairs that share a month, each once: the later one's start meets the earlier one in a dyadic tree.

    An interval goes to its few canonical nodes, a start to the nodes above it, and just one node
    is among both where the interval holds the start. So an interval costs the logarithm of its
    months, however damaged its dates. Starts go only to levels that their group's intervals use:
    where all last a month, both sides keep one row each.
    """
    noded = distinct.withColumn("nodes", dyadic_nodes("start_no", "end_no"))
    levels = F.bit_or(node_levels("nodes")).over(Window.partitionBy(*PAIR))
    noded = noded.withColumn("levels", levels)
    left = noded.select(
        *PAIR, F.col("relation_type").alias("r1"), F.col("start_no").alias("s1"), F.col("end_no").alias("e1"),
        F.col("n").alias("n1"), F.explode("nodes").alias("node"),
    )
    right = noded.select(
        *PAIR, F.col("relation_type").alias("r2"), F.col("start_no").alias("s2"), F.col("end_no").alias("e2"),
        F.col("n").alias("n2"), F.explode(dyadic_ancestors("start_no", "levels")).alias("node"),
    )
    # Equal starts would be found from both sides; the smaller code then leads.
    return left.join(right, [*PAIR, "node"]).where("r1 <> r2 and (s1 < s2 or r1 < r2)")


def _shared_counts(distinct: DataFrame) -> DataFrame:
    pairs = shared_month_pairs(distinct)
    lead = F.col("r1") < F.col("r2")

    def side(a: str, b: str) -> Column:
        return F.when(lead, F.col(a)).otherwise(F.col(b))

    kinds = pairs.select(
        *PAIR, side("r1", "r2").alias("relation_a"), side("r2", "r1").alias("relation_b"),
        interval_relation(side("s1", "s2"), side("e1", "e2"), side("s2", "s1"), side("e2", "e1")).alias("kind"),
        (F.col("n1") * F.col("n2")).alias("k"),
    )
    return kinds.groupBy(*PAIR, "relation_a", "relation_b").agg(*[
        F.sum(F.when(F.col("kind") == kind, F.col("k")).otherwise(0)).alias(f"{kind}_count") for kind in OVERLAP_RELATIONS
    ])


def overlap_sum(prefix: str = "") -> Column:
    return sum((F.col(f"{prefix}{k}_count") for k in OVERLAP_RELATIONS), F.lit(0).cast("bigint"))


def disjoint_sum(prefix: str = "") -> Column:
    return sum((F.col(f"{prefix}{k}_count") for k in DISJOINT_RELATIONS if k != "disjoint"), F.lit(0).cast("bigint"))


def pair_summary(intervals: DataFrame, counts: DataFrame | None = None, max_pairs: int = 0) -> DataFrame:
    """Per relation pair over all subjects and objects: counts, rates and the totals of both relations."""
    counts = pair_counts(intervals) if counts is None else counts
    totals = intervals.groupBy("relation_type").agg(F.count(F.lit(1)).alias("k"))
    summed = counts.groupBy("relation_a", "relation_b").agg(
        F.sum("comparable_count").alias("comparable_count"), *[F.sum(c).alias(c) for c in COUNT_COLUMNS]
    )

    def total_of(side: str) -> DataFrame:
        return totals.select(F.col("relation_type").alias(f"relation_{side}"), F.col("k").alias(f"relation_{side}_total_interval_count"))

    # At most 20 totals and 190 sums: the relation codes bound both sides.
    full = summed.join(F.broadcast(total_of("a")), "relation_a", "left").join(F.broadcast(total_of("b")), "relation_b", "left")
    rated = full.withColumns({
        "non_overlap_count": disjoint_sum(), "violation_like_overlap_count": overlap_sum(),
    }).withColumns({
        "overlap_rate": F.round(ratio("violation_like_overlap_count", "comparable_count"), 6),
        "non_overlap_rate": F.round(ratio("non_overlap_count", "comparable_count"), 6),
    }).select(
        "relation_a", "relation_b", "relation_a_total_interval_count", "relation_b_total_interval_count",
        "comparable_count", *COUNT_COLUMNS, "non_overlap_count", "violation_like_overlap_count",
        "overlap_rate", "non_overlap_rate",
    )
    if max_pairs > 0:
        rated = rated.orderBy(
            F.desc("comparable_count"), F.desc("non_overlap_rate"), F.desc("overlap_rate"), "relation_a", "relation_b"
        ).limit(max_pairs)
    return rated


def first_groups(counts: DataFrame, weight: str, keep: int, *by: str) -> DataFrame:
    """Per group of columns, the first (subject, object) pairs that together hold at least `keep` interval pairs.

    Each of them holds one or more, so `keep` of them always suffice; the
    row-number filter is applied before the shuffle as well.
    """
    order = Window.partitionBy(*by).orderBy(*PAIR)
    held = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.where(F.col(weight) > 0).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= keep)
    return ranked.withColumn("_held", F.coalesce(F.sum(weight).over(held), F.lit(0))).where(F.col("_held") < keep).drop("_rank", "_held")


def expand_pairs(groups: DataFrame, intervals: DataFrame) -> DataFrame:
    """Interval pairs of selected (subject, object, relation_a, relation_b) groups, with their time relation."""

    def side(s: str) -> DataFrame:
        extra = [F.col(c).alias(f"interval_{s}_id") for c in ("interval_id",) if c in intervals.columns]
        return intervals.select(
            *PAIR, F.col("relation_type").alias(f"relation_{s}"),
            F.col("start_no").alias(f"{s}_start"), F.col("end_no").alias(f"{s}_end"), *extra,
        )

    joined = groups.join(side("a"), [*PAIR, "relation_a"]).join(side("b"), [*PAIR, "relation_b"])
    return joined.withColumn("interval_relation", interval_relation("a_start", "a_end", "b_start", "b_end"))


PAIR_ORDER = (*PAIR, "a_start", "a_end", "b_start", "b_end")


def pair_examples(intervals: DataFrame, counts: DataFrame | None = None, examples: int = 3) -> DataFrame:
    """First example texts per relation pair, for overlapping and for disjoint intervals, as two delimited texts."""
    counts = pair_counts(intervals) if counts is None else counts
    kinds = F.array(
        F.struct(F.lit(True).alias("is_overlap"), overlap_sum().alias("k")),
        F.struct(F.lit(False).alias("is_overlap"), disjoint_sum().alias("k")),
    )
    classed = counts.select(*PAIR, "relation_a", "relation_b", F.inline(kinds))
    chosen = first_groups(classed, "k", examples, "relation_a", "relation_b", "is_overlap").drop("k")
    pairs = expand_pairs(chosen, intervals).where(F.col("interval_relation").isin(*OVERLAP_RELATIONS) == F.col("is_overlap"))
    rank = Window.partitionBy("relation_a", "relation_b", "is_overlap").orderBy(*PAIR_ORDER)
    text = F.format_string(
        "%s --%s--> %s [%s,%s] %s %s --%s--> %s [%s,%s]",
        "subject_org_id", "relation_a", "object_org_id", month_text("a_start"), month_text("a_end"), "interval_relation",
        "subject_org_id", "relation_b", "object_org_id", month_text("b_start"), month_text("b_end"),
    )
    first = pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= examples)

    def joined(flag: bool) -> Column:
        entries = F.array_sort(F.collect_list(F.when(F.col("is_overlap") == flag, F.struct("rank", text.alias("t")))))
        return F.array_join(F.transform(entries, lambda x: x["t"]), " | ")

    return first.groupBy("relation_a", "relation_b").agg(
        joined(True).alias("top_overlap_examples"), joined(False).alias("top_non_overlap_examples")
    )

