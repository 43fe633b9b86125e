"""Filters, top-N and neighbourhood views of the graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.constants import ACTION_LABELS, FEED_A, FEED_B, RELATION_LABELS
from edgeloom.functions.codes import relation_light
from edgeloom.functions.parse import clean_text, display_text, lookup, to_double, to_flag, to_long
from edgeloom.sources.columns import resolve

LINK_LISTS = (
    "triggered_constraint_ids", "triggered_constraint_keys", "triggered_mutex_relations", "update_reason",
)


def links(after: DataFrame) -> DataFrame:
    """Updated edges as display links: ids, names, labels, confidence and update columns."""
    code = relation_light("relation_type")
    action = display_text(resolve(after, ("update_action", "status"), F.lit("keep")), F.lit("keep"))
    s, o = display_text("subject_org_id"), display_text("object_org_id")
    status = display_text(resolve(after, ("after_check_status", "status"), F.lit("keep")), F.lit("keep"))
    confidence = to_double(F.coalesce(resolve(after, ("final_confidence",), F.lit(None)), resolve(after, ("confidence",), F.lit(None))))
    lists = [F.coalesce(resolve(after, (c,), F.lit("")), F.lit("")).alias(c) for c in LINK_LISTS]
    return after.select(
        F.col("event_month").alias("month"), "edge_id",
        s.alias("source"), o.alias("target"),
        display_text("subject_name", s).alias("source_name"), display_text("object_name", o).alias("target_name"),
        code.alias("relation"), lookup(code, RELATION_LABELS).alias("relation_label"),
        confidence.alias("confidence"), to_double(resolve(after, ("original_confidence", "confidence"), F.lit(0.0))).alias("original_confidence"),
        status.alias("status"), action.alias("update_action"), lookup(action, ACTION_LABELS).alias("update_action_label"),
        F.coalesce(resolve(after, ("sources", "source_datasets"), F.lit("")), F.lit("")).alias("sources"),
        *lists, to_flag(resolve(after, ("is_mutex_triggered",), F.lit("false"))).alias("is_mutex_triggered"),
    ).where("source <> '' and target <> '' and month <> ''")


def link_filter(
    relations: Sequence[str] = (), actions: Sequence[str] = (), min_confidence: float = 0.0,
    only_triggered: bool = False, only_cross_source: bool = False,
) -> Column:
    condition = F.col("confidence") >= min_confidence
    if relations:
        condition = condition & F.col("relation").isin(*relations)
    if actions:
        condition = condition & (F.col("update_action").isin(*actions) | F.col("update_action_label").isin(*actions))
    if only_triggered:
        condition = condition & F.col("is_mutex_triggered")
    if only_cross_source:
        sources = F.upper("sources")
        condition = condition & sources.contains(FEED_A) & sources.contains(FEED_B)
    return condition


def mentions(keyword: str, *columns: str) -> Column:
    """Keyword anywhere in the columns, case ignored; a blank keyword matches all."""
    word = keyword.strip().lower()
    return F.lower(F.concat_ws(" ", *columns)).contains(word) if word else F.lit(True)


def search_edges(rows: DataFrame, keyword: str = "", **criteria) -> DataFrame:
    """Links that meet all criteria and mention the keyword in a name, id, relation or action."""
    fields = ("source_name", "target_name", "source", "target", "relation", "relation_label", "update_action", "update_action_label")
    return rows.where(link_filter(**criteria) & mentions(keyword, *fields))


NODE_FIELDS = ("source", "target", "source_name", "target_name")


def ego_edges(rows: DataFrame, keyword: str, **criteria) -> DataFrame:
    """Links that touch a node whose id or name mentions the keyword; a blank keyword gives none."""
    if not keyword.strip():
        return rows.where(F.lit(False))
    return rows.where(link_filter(**criteria) & mentions(keyword, *NODE_FIELDS))


def ego_rows(rows: DataFrame, keyword: str, **criteria) -> DataFrame:
    return ego_edges(rows, keyword, **criteria).select(
        "month", "source_name", F.col("source").alias("source_org_id"), F.col("relation").alias("relation_code"), "relation_label",
        "target_name", F.col("target").alias("target_org_id"), "confidence", "original_confidence", "sources", "status",
        "update_action", "update_action_label", "is_mutex_triggered", "triggered_constraint_ids",
        "triggered_mutex_relations", "update_reason",
    )


def ego_metrics(rows: DataFrame) -> DataFrame:
    """Edges, months, nodes and relation types of ego rows, in one row."""
    ends = F.array("source_org_id", "target_org_id")
    nodes = rows.select(F.explode(ends).alias("node")).agg(F.count_distinct("node").alias("related_nodes"))
    counts = rows.agg(
        F.count(F.lit(1)).alias("edges"), F.count_distinct("month").alias("months"),
        F.count_distinct("relation_code").alias("relation_types"),
    )
    return counts.join(F.broadcast(nodes))  # one row each


def top_per_month(rows: DataFrame, n: int, confidence: str = "confidence", key: str = "edge_id") -> DataFrame:
    """The n most confident links of each month (0: all). The rank filter also runs before the shuffle."""
    if n <= 0:
        return rows
    rank = Window.partitionBy("month").orderBy(F.desc(confidence), F.asc(key))
    return rows.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= n).drop("_rank")


def ends(rows: DataFrame) -> DataFrame:
    """Both ends of every link as rows: month, node, name."""
    both = F.array(
        F.struct(F.col("source").alias("node"), F.col("source_name").alias("name")),
        F.struct(F.col("target").alias("node"), F.col("target_name").alias("name")),
    )
    return rows.select("month", "edge_id", F.inline(both))


def node_degree(rows: DataFrame) -> DataFrame:
    """Links per node over all months; a self-loop counts twice."""
    return ends(rows).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def month_nodes(rows: DataFrame) -> DataFrame:
    """Nodes per month with degree, last display name and a size that grows with the degree."""
    grouped = ends(rows).groupBy("month", "node").agg(
        F.count(F.lit(1)).alias("degree"), F.max_by("name", F.struct("edge_id", "name")).alias("name")
    )
    return grouped.select(
        "month", F.col("node").alias("id"), "name", "degree",
        F.greatest(F.lit(14), F.least(F.lit(46), F.col("degree") * 2 + 10)).alias("size"),
    )


def display_names(rows: DataFrame) -> DataFrame:
    """Last non-blank name of every node; object names outrank subject names."""
    both = F.array(
        F.struct(F.col("source").alias("node"), F.col("source_name").alias("name"), F.lit(0).alias("side")),
        F.struct(F.col("target").alias("node"), F.col("target_name").alias("name"), F.lit(1).alias("side")),
    )
    named = rows.select("edge_id", F.inline(both)).where("name <> '' and lower(name) <> 'nan'")
    return named.groupBy("node").agg(F.max_by("name", F.struct("side", "edge_id", "name")).alias("display_name"))


def enriched_links(rows: DataFrame) -> DataFrame:
    """Links with the common display name of both ends."""
    names = display_names(rows)

    def side(end: str) -> DataFrame:
        return names.select(F.col("node").alias(end), F.col("display_name").alias(f"{end}_display"))

    joined = rows.join(side("source"), "source", "left").join(side("target"), "target", "left")
    return joined.withColumns({
        "source_name": F.coalesce("source_display", "source"), "target_name": F.coalesce("target_display", "target"),
    }).drop("source_display", "target_display")


def timeline_rows(rows: DataFrame, max_edges_per_month: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of every month as rows, nodes with their degree over the links; all links by default."""
    kept = top_per_month(rows, max_edges_per_month) if max_edges_per_month > 0 else rows
    nodes = month_nodes(kept).select(
        "month", "id", "name", F.col("id").alias("org_id"), F.lit("组织机构").alias("category"),
        F.col("size").alias("symbolSize"), F.col("degree").alias("value"),
    )
    found = kept.select(
        "month", "edge_id", "source", "target", "source_name", "target_name",
        F.col("source").alias("source_org_id"), F.col("target").alias("target_org_id"), "relation",
        F.col("relation").alias("relation_code"), "relation_label", F.col("relation_label").alias("edge_label"),
        "confidence", "original_confidence", "status", F.col("status").alias("status_label"), "update_action", "update_action_label",
        "sources", *LINK_LISTS, "is_mutex_triggered",
    )
    return nodes, found


def timeline(rows: DataFrame, max_edges_per_month: int) -> DataFrame:
    """One row per month, its top links and their nodes as arrays: a document for display, which the number bounds.

    `timeline_rows` has all links of all months; one row could not hold them.
    """
    if max_edges_per_month <= 0:
        raise ValueError("a month's document needs a number of edges; timeline_rows() has all of them")
    nodes, found = timeline_rows(rows, max_edges_per_month)

    def gathered(df: DataFrame, by: str, name: str) -> DataFrame:
        fields = [c for c in df.columns if c != "month"]
        listed = df.groupBy("month").agg(F.array_sort(F.collect_list(F.struct((-F.col(by)).alias("order"), *fields))).alias(name))
        return listed.withColumn(name, F.transform(name, lambda x: x.dropFields("order")))

    return gathered(nodes, "value", "nodes").join(gathered(found, "confidence", "links"), "month").select("month", "nodes", "links")


def month_view(rows: DataFrame, n: int, keyword: str = "", **criteria) -> tuple[DataFrame, DataFrame]:
    """Filtered top links per month and the nodes they touch (with their degree in the whole month)."""
    top = top_per_month(search_edges(rows, keyword, **criteria), n)
    touched = ends(top).select("month", F.col("node").alias("id")).distinct()
    return month_nodes(rows).join(touched, ["month", "id"], "left_semi"), top


def ego_network(rows: DataFrame, keyword: str, n: int, **criteria) -> tuple[DataFrame, DataFrame]:
    """Per month the top links around the matching nodes, and the nodes with a center flag."""
    top = top_per_month(ego_edges(rows, keyword, **criteria), n)
    word = keyword.strip().lower()
    center = F.lower("name").contains(word) | F.lower("id").contains(word)
    nodes = month_nodes(top).withColumn("is_center", center).withColumn(
        "size", F.when(F.col("is_center"), 42).otherwise(24).cast("bigint")
    )
    return nodes, top


# ---- graph store views ------------------------------------------------------------

def importable(edges: DataFrame) -> DataFrame:
    """Edges whose id, ends and names are all filled."""
    fields = ("edge_id", "subject_org_id", "object_org_id", "subject_name", "object_name")
    condition = F.lit(True)
    for f in fields:
        condition = condition & (clean_text(f) != "")
    return edges.where(condition)


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Latest name per organization: later edges win, and the object end over the subject end of the same edge."""
    both = F.array(
        F.struct(F.col("subject_org_id").alias("org_id"), F.col("subject_name").alias("name"), F.lit(0).alias("side")),
        F.struct(F.col("object_org_id").alias("org_id"), F.col("object_name").alias("name"), F.lit(1).alias("side")),
    )
    rows = importable(edges).select("edge_id", F.inline(both))
    return rows.groupBy("org_id").agg(F.max_by("name", F.struct("edge_id", "side")).alias("name"))


def graph_edges(edges: DataFrame) -> DataFrame:
    """One row per edge id. Repeats of an id are whole repeats of the row."""
    return importable(edges).dropDuplicates(["edge_id"])


def graph_query(
    nodes: DataFrame, edges: DataFrame, keyword: str = "", relations: Sequence[str] = (), statuses: Sequence[str] = (),
    min_confidence: float = 0.0, limit: int = 300,
) -> DataFrame:
    """Edges between named nodes that meet the filter, most events first."""

    def end(s: str) -> DataFrame:
        return nodes.select(F.col("org_id").alias(f"{s}_org_id"), F.col("name").alias(f"{s}_node"))

    rows = edges
    if relations:
        rows = rows.where(F.col("relation_type").isin(*relations))
    if statuses:
        rows = rows.where(F.col("status").isin(*statuses))
    rows = rows.where(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    joined = rows.join(end("subject"), "subject_org_id").join(end("object"), "object_org_id")
    if keyword:
        word = keyword.upper()
        hit = F.lit(False)
        for c in ("subject_node", "object_node", "subject_org_id", "object_org_id"):
            hit = hit | F.upper(c).contains(word)
        joined = joined.where(hit)
    return joined.orderBy(
        to_long("event_count").desc(), to_double("confidence").desc(), "edge_id"
    ).limit(limit).select(
        "edge_id", F.col("subject_org_id").alias("source"), F.col("object_org_id").alias("target"),
        F.col("subject_node").alias("subject"), "relation_type", F.col("object_node").alias("object"),
        F.col("event_month").alias("month"), to_long("event_count").alias("event_count"), to_double("confidence").alias("confidence"), "status",
    )


def query_nodes(found: DataFrame) -> DataFrame:
    both = F.array(
        F.struct(F.col("source").alias("id"), F.col("subject").alias("name")),
        F.struct(F.col("target").alias("id"), F.col("object").alias("name")),
    )
    return found.select(F.inline(both)).distinct()


def edge_table(found: DataFrame) -> DataFrame:
    blank = F.lit("")
    return found.select(
        "edge_id", "subject", "relation_type", "object", "month", "event_count", "confidence", "status",
        blank.alias("start_date"), blank.alias("end_date"),
    )


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("org_count")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("relation_count"))))


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct values for a selection list."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().orderBy("value")


def overview(after: DataFrame, found: DataFrame, final: DataFrame, log: DataFrame) -> DataFrame:
    """Table sizes and the action, status and month histograms as (section, key, count)."""

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("count")).select(F.lit("size").alias("section"), F.lit(name).alias("key"), "count")

    def histogram(df: DataFrame, column: str, section: str) -> DataFrame:
        return df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("count")).select(F.lit(section).alias("section"), "key", "count")

    parts = [
        size(after, "edges"), size(final, "constraints"), size(found, "conflicts"), size(log, "decisions"),
        histogram(after, "update_action_label", "action"), histogram(final, "final_status", "final_status"),
        histogram(found, "month", "month"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _coded(c: str) -> Column:
    code = relation_light(c)
    return F.concat(code, F.lit(" - "), lookup(code, RELATION_LABELS))


def constraint_list(final: DataFrame, statuses: Sequence[str] = (), min_confidence: float = 0.0) -> DataFrame:
    rows = final.where(to_double("structural_confidence") >= min_confidence)
    if statuses:
        rows = rows.where(F.col("final_status").isin(*statuses))
    return rows.select(
        "constraint_id", "constraint_key", "constraint_name", _coded("relation_a").alias("relation_a_label"),
        _coded("relation_b").alias("relation_b_label"), "candidate_level", "auto_filter_status", "final_status",
        "structural_confidence", "source_weighted_confidence", "violation_rate", "proposed_action", "manual_score", "manual_comment",
    )


def conflict_list(found: DataFrame, months: Sequence[str] = (), actions: Sequence[str] = (), constraints: Sequence[str] = ()) -> DataFrame:
    rows = found
    for column, values in (("month", months), ("conflict_action", actions), ("constraint_id", constraints)):
        if values:
            rows = rows.where(F.col(column).isin(*values))
    return rows.select(
        "month", "subject_org_id", "object_org_id", _coded("relation_a").alias("relation_a_label"),
        _coded("relation_b").alias("relation_b_label"), "constraint_id", "constraint_key", "final_status", "conflict_action",
        "structural_confidence", "violation_rate", "reason", "edge_ids_a", "edge_ids_b",
    )
