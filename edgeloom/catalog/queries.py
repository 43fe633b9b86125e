"""The registered queries. Each takes a session and a table folder and returns a DataFrame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import codes, names, parse
from edgeloom.functions.sqlfuncs import register_sql_functions
from edgeloom.operators import (
    actors, align, baselines, candidates, constraints, dimension, edges, facts, fuzzy, ids, intervals, inventory, metrics,
    pairs, reduction, samples, update, views,
)
from edgeloom.plans.build import Check, Graph
from edgeloom.session import cut_lineage, stage_path
from edgeloom.sources import readers, tables, testfeed, writers
from edgeloom.sources.schemas import text_schema
from edgeloom.streaming import fuse

Query = Callable[[SparkSession, str], DataFrame]


# Stage tables are written once per session and folder and then read by every query that needs them.
_GRAPHS: dict[tuple, Graph] = {}
_CHECKS: dict[tuple, Check] = {}
_STREAMS: dict[tuple, tuple[str, DataFrame]] = {}


def graph(spark: SparkSession, folder: str, fold: bool = True, cut: bool = True) -> Graph:
    """Graph of the derived feeds. Folded to four months, relations collide often enough to exercise every status."""
    key = (spark.sparkContext.applicationId, folder, fold)
    if cut and key in _GRAPHS:
        return _GRAPHS[key]
    built = Graph(
        testfeed.feed_a(spark, folder, fold), testfeed.feed_b(spark, folder, fold),
        testfeed.organizations(spark, folder), testfeed.aliases(spark, folder), cut=cut,
    )
    if cut:
        _GRAPHS[key] = built
    return built


def check(spark: SparkSession, folder: str, manual: bool = False) -> Check:
    key = (spark.sparkContext.applicationId, folder, manual)
    if key not in _CHECKS:
        g = graph(spark, folder)
        found = found_candidates(g)
        _CHECKS[key] = Check(g, found, reviews(found) if manual else None)
    return _CHECKS[key]


def forget_stages() -> None:
    """Start over with fresh stage tables."""
    _GRAPHS.clear()
    _CHECKS.clear()
    _STREAMS.clear()


def found_candidates(g: Graph) -> DataFrame:
    """The pooled pairs as candidates; those against relation 17 ask for hiding, so that every action occurs."""
    action = F.when(F.col("relation_b") == "17", "hide").otherwise(F.col("expected_action"))
    return candidates.candidates_from_pool(g.pool).withColumn("expected_action", action)


def reviews(found: DataFrame) -> DataFrame:
    """A review table derived from the candidates: some by id, some by key, some blank."""
    return found.select(
        F.when(F.col("relation_a") == "06", F.col("constraint_id")).otherwise("").alias("constraint_id"),
        F.col("constraint_key"),
        F.when(F.col("relation_b").isin("16", "17"), "pass").when(F.col("relation_b") == "18", "drop")
        .when(F.col("relation_b") == "19", "manual_review").otherwise(" ").alias("decision"),
        F.concat(F.lit("checked "), "relation_a").alias("comment"),
    )


# ---- feeds to edges -------------------------------------------------------------

def event_facts(spark, folder):
    g = graph(spark, folder, fold=False, cut=False)
    return g.facts.drop("event_seq", "num_sources", "num_articles", "num_mentions")


def source_evidence(spark, folder):
    """Where each fact of feed A was reported."""
    return facts.evidence_table(graph(spark, folder, fold=False, cut=False).facts).drop("event_seq")


def name_dictionary(spark, folder):
    g = graph(spark, folder, cut=False)
    both = g.a_dictionary.select(F.lit("a").alias("feed"), "name_key", "org_id").unionByName(
        g.b_dictionary.select(F.lit("b").alias("feed"), "name_key", "org_id"))
    return both


def gate_reasons(spark, folder):
    return edges.gate_counts(graph(spark, folder, fold=False, cut=False).classified)


def seed_edges(spark, folder):
    return graph(spark, folder, fold=False, cut=False).seed


def fused_edges(spark, folder):
    return graph(spark, folder, fold=False, cut=False).edges


def scored_edges(spark, folder):
    return graph(spark, folder, fold=False, cut=False).scored


def daily_log(spark, folder):
    g = graph(spark, folder, fold=False, cut=False)
    return edges.daily_log(g.seed, g.classified)


def first_seen(spark, folder):
    return edges.first_seen(graph(spark, folder, fold=False, cut=False).classified)


def edge_ids(spark, folder):
    g = graph(spark, folder, fold=False, cut=False)
    order = ["event_month", "subject_org_id", "object_org_id", "relation_type"]
    return ids.dense_ids(g.edges.select(*order, "event_count"), order, "edge_id", "E_%09d")


def date_windows(spark, folder):
    """Events per month inside a closed date range, for both feeds' date spellings."""
    a = facts.date_range(testfeed.feed_a(spark, folder), "Event Date", "1996-01-01", "1997-12-31")
    b = facts.number_range(testfeed.feed_b(spark, folder), "SQLDATE", 19960101, 19971231)
    return (
        a.select(F.lit("a").alias("feed"), F.substring("Event Date", 1, 7).alias("month"))
        .unionByName(b.select(F.lit("b").alias("feed"), parse.sql_date_month("SQLDATE").alias("month")))
        .groupBy("feed", "month").agg(F.count(F.lit(1)).alias("events"))
    )


def event_reduction(spark, folder):
    rows = reduction.reduce_events(testfeed.feed_b(spark, folder, parties=True), "both_org")
    return rows.groupBy("SQLDATE", "EventRootCode").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("Actor1Name").alias("actors"))


def event_reduction_any(spark, folder):
    rows = reduction.reduce_events(testfeed.feed_b(spark, folder, parties=True), "any_org", both_names=False)
    return rows.groupBy("SQLDATE", "EventRootCode").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("Actor1Name").alias("actors"))


def position_sample(spark, folder):
    rows = reduction.sample_by_position(testfeed.feed_b(spark, folder), 20, "event_seq")
    return rows.select("SQLDATE", F.col("event_seq.l_orderkey").alias("l_orderkey"), F.col("event_seq.l_linenumber").alias("l_linenumber"))


# ---- actors and alignment -------------------------------------------------------

def found_actors(spark, folder):
    return actors.actors(
        actors.feed_a_hits(testfeed.feed_a(spark, folder)), actors.feed_b_hits(testfeed.feed_b(spark, folder, parties=True))
    )


def actor_candidates(spark, folder):
    return actors.actor_candidates(found_actors(spark, folder))


def organizations(spark, folder):
    return actors.organizations(found_actors(spark, folder))


def aligned_organizations(spark, folder):
    return align.align(actors.organizations(found_actors(spark, folder)))[0].drop("known_group_info", "all_raw_names")


def aliases(spark, folder):
    return align.align(actors.organizations(found_actors(spark, folder)))[1]


def organization_scale(spark, folder):
    orgs, found = align.align(actors.organizations(found_actors(spark, folder)))
    return metrics.organization_scale(orgs, found)


def alignment_sample(spark, folder):
    orgs, found = align.align(actors.organizations(found_actors(spark, folder)))
    return samples.alignment_sample(orgs, found).drop("all_raw_names", "known_group_info")


def fuzzy_merged(spark, folder):
    """Customers under spelled-out names, every third one again with a letter missing: who is merged into whom."""
    key = F.col("c_custkey")
    # Five digits to the base 26, so that 11.8 million customers have names of their own.
    letter = lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.floor(key / 26 ** (4 - i)) % 26 + 1).cast("int"), F.lit(1))
    name = F.concat_ws(" ", *[F.concat(F.lit("KLMNO"[i]), F.repeat(letter(i), 4)) for i in range(5)])
    base = testfeed.table(spark, folder, "customer").select(F.format_string("B%08d", key).alias("org_id"), name.alias("clean_name"), key.alias("k"))
    cut = (F.col("k") % 5 * 6 + 2).cast("int")
    again = base.where("k % 3 = 0").select(
        F.format_string("V%08d", "k").alias("org_id"), F.concat(F.substring("clean_name", F.lit(1), cut - 1), F.substring("clean_name", cut + 1, F.lit(40))).alias("clean_name"))
    merged = fuzzy.fuzzy_merge(base.drop("k").unionByName(again))
    return merged.select("old_org_id", "survivor_id", F.round("ratio", 4).alias("ratio"))


# ---- files ----------------------------------------------------------------------

def feed_scan(spark, folder):
    """Customers as damaged feed lines, half of them zipped, written below the stage folder and read back.

    Lines are plain, quoted, hold a null spelling, or have a field too many or too few; a
    folder beside them is excluded.
    """
    f = F.col("c_custkey") % 5
    name = F.when(f == 1, F.concat(F.lit('"'), "c_name", F.lit(' ""q"""'))).when(f == 2, "NA").otherwise(F.col("c_name"))
    note = F.concat(F.lit("n"), f.cast("string"))
    rest = F.when(f == 3, F.concat(F.lit("\t"), note, F.lit("\textra"))).when(f == 4, "").otherwise(F.concat(F.lit("\t"), note))
    rows = testfeed.table(spark, folder, "customer")
    lines = rows.select(F.concat(F.concat_ws("\t", F.col("c_custkey").cast("string"), name, "c_mktsegment"), rest).alias("value"), ((F.col("c_custkey") / 5).cast("bigint") % 2 == 0).alias("even"))
    path = stage_path(spark, "feed")
    even, odd = (lines.where(w).select("value") for w in ("even", "not even"))
    even.write.text(f"{path}/plain")
    writers.export_zipped_lines(odd, f"{path}/zipped")
    even.write.text(f"{path}/all_tabs/plain")
    writers.export_zipped_lines(odd, f"{path}/all_tabs/zipped")
    return readers.read_feed_files(spark, path, text_schema("id", "name", "segment", "note"), "*.txt", header=False, exclude_directory="all_tabs", file_column=None)


def appended_edges(spark, folder):
    """The edge table by months in two appends, one of them sent twice and one begun before and lost, read back."""
    rows = graph(spark, folder).edges
    path = stage_path(spark, "appended")
    first = rows.where("relation_type <= '10'")
    writers.write_table(first.limit(100), f"{path}/data/append=lost", ["event_month"])  # a writer that died before its commit
    for part, name in ((first, "first"), (rows.where("relation_type > '10'"), "second"), (first, "first")):
        tables.append_once(part, path, name)
    return tables.read_appended(spark, path, rows.schema)


def upserted_edges(spark, folder):
    """Edges as a table of latest rows after three upserts: all, one relation with new counts, and outdated rows that change nothing."""
    rows = graph(spark, folder).edges.select("edge_id", "subject_name", "object_name", "event_count", "confidence").withColumn("seq", F.lit(1))
    path = stage_path(spark, "upserted")
    table = tables.KeyedTable(spark, path, rows.schema, ["edge_id"], "seq", buckets=8)
    table.upsert(rows)
    newer = rows.where("edge_id like '%|03'").withColumns({"event_count": F.col("event_count") + 1000, "seq": F.lit(2)})
    table.upsert(newer)
    table.upsert(rows.where("edge_id like '%|0_'").withColumns({"event_count": F.lit(0).cast("bigint"), "seq": F.lit(0)}))
    return table.read()


def interval_files(spark, folder):
    """The interval table as headerless text files, read back."""
    path = stage_path(spark, "intervals")
    writers.export_intervals(graph(spark, folder).interval_table, path)
    return readers.read_intervals(spark, path)[0]


def timeline_files(spark, folder):
    """Links of the top of each month, from month documents written and read back."""
    path = stage_path(spark, "timeline")
    writers.export_timeline(views.timeline(_links(spark, folder), 100), path)
    return readers.timeline_links(readers.read_timeline(spark, path)).select("month", "edge_id", "source_name", "target_name", "relation_code", "confidence", "status")


# ---- scalar rules ---------------------------------------------------------------

def raw_names(spark, folder):
    """Distinct actor spellings of both feeds, with the brackets some sources use."""
    a, b = testfeed.feed_a(spark, folder), testfeed.feed_b(spark, folder, parties=True)
    spelled = (
        a.select(F.col("Source Name").alias("name")).unionByName(a.select(F.col("Target Name").alias("name")))
        .unionByName(b.select(F.col("Actor1Name").alias("name"))).unionByName(b.select(F.col("Actor2Name").alias("name")))
    )
    return spelled.distinct()


def name_clean(spark, folder):
    return raw_names(spark, folder).select(
        "name", names.light_name("name").alias("light"), names.aligned_name("name").alias("aligned"),
        names.lookup_name("name").alias("lookup"), names.alias_name("name").alias("alias"),
        F.array_join(names.qualifiers("name"), ",").alias("qualifiers"), names.base_name("name").alias("base"),
        names.token_sorted("name").alias("tokens"),
    )


def name_predicates(spark, folder):
    return raw_names(spark, folder).select(
        "name", names.is_bad_name("name").alias("bad"), names.has_org_name("name").alias("org_name"),
        names.is_org_sector("name").alias("org_sector"), names.is_generic_org("name").alias("generic"),
    )


def code_top2(spark, folder):
    a = testfeed.feed_a(spark, folder).select(F.col("CAMEO Code").alias("code"), F.lit("").alias("root"))
    b = testfeed.feed_b(spark, folder).select(F.col("EventCode").alias("code"), F.col("EventRootCode").alias("root"))
    rows = a.unionByName(b).groupBy("code", "root").agg(F.count(F.lit(1)).alias("events"))
    return rows.withColumns({
        "padded": codes.event_code_padded("code"), "from_padded": codes.relation_from_padded("code"),
        "from_compact": codes.relation_from_compact("code"), "from_root": codes.relation_from_root_or_code("root", "code"),
        "light": codes.relation_light("root"), "strict": codes.relation_strict("root"),
        "category": codes.relation_category("root"),
    })


def month_parse(spark, folder):
    """Every ship date in several spellings, parsed back."""
    day = F.to_date("l_shipdate")
    rows = testfeed.table(spark, folder, "lineitem").select(day.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("events"))
    spellings = F.array(*[F.date_format("d", p) for p in (
        "yyyy-MM-dd", "yyyy-M", "yyyyMMdd", "yyyyMM", "yyyy/MM/dd", "yyyy.MM.dd", "'x'yyyy", "yyyyMMdd'.0'", "yyyyMM'9'")])
    long = rows.select("d", "events", F.explode(spellings).alias("spelling"))
    first, last = parse.month_bounds(parse.month_text(parse.month_number("spelling")))
    return long.groupBy("spelling").agg(F.sum("events").alias("events")).select(
        "spelling", "events", parse.month_number("spelling").alias("month_number"),
        parse.month_prefix("spelling").alias("month_prefix"), parse.sql_date_month("spelling").alias("sql_month"),
        parse.sql_date_day("spelling").alias("sql_day"), first.alias("first_day"), last.alias("last_day"),
    )


def relation_labels(spark, folder):
    rows = graph(spark, folder, fold=False, cut=False).edges
    dim = dimension.relation_dimension(spark)
    counted = rows.groupBy("relation_type").agg(F.count(F.lit(1)).alias("edges"))
    return dimension.with_relation_label(counted, "relation_type", "relation_label", dim).join(
        F.broadcast(dim.select(F.col("code").alias("relation_type"), "eval_group", "is_cooperation", "is_broad")), "relation_type"
    )


def sql_functions(spark, folder):
    register_sql_functions(spark)
    rows = graph(spark, folder, cut=False).edges
    return rows.select(
        "edge_id", F.expr("light_name(subject_name)").alias("light"), F.expr("lookup_name(subject_name)").alias("lookup"),
        F.expr("aligned_text(subject_name)").alias("aligned"), F.expr("relation_padded(concat(relation_type, '0'))").alias("padded"),
        F.expr("relation_compact(relation_type)").alias("compact"), F.expr("relation_strict(relation_type)").alias("strict"),
        F.expr("edge_confidence(source_datasets, event_count, icews_event_count, gdelt_event_count, confidence)").alias("score"),
        F.expr("source_weight(source_datasets, icews_event_count, gdelt_event_count, confidence, null, null)").alias("weight"),
        F.expr("month_interval_relation(cast(substring(event_month, 6, 2) as int), cast(substring(event_month, 6, 2) as int), 2, 3)").alias("relation_to_spring"),
        F.expr("exclusion_truth(month_interval_relation(cast(substring(event_month, 6, 2) as int), cast(substring(event_month, 6, 2) as int), 2, 3), 'overlap')").alias("truth"),
    )


# ---- intervals ------------------------------------------------------------------

# From the stage tables of the graph: tests of texts and dates would else move below its groupings, to every event.

def month_intervals(spark, folder):
    return graph(spark, folder, fold=False).interval_table


def interval_ids(spark, folder):
    return intervals.with_interval_ids(graph(spark, folder, fold=False).interval_table).select("subject", "property", "object", "start_time", "interval_id")


def instance_ids(spark, folder):
    """Judged interval pairs by the ids of their intervals."""
    c = check(spark, folder)
    g = c.graph
    rows = intervals.numbered(intervals.with_interval_ids(g.interval_table))
    return constraints.trigger_instances(rows, c.candidates, g.weights, g.pair_counts).select("constraint_id", "interval_a_id", "interval_b_id", "truth")


def merged_intervals(spark, folder):
    return intervals.merge_intervals(graph(spark, folder, fold=False).intervals)


def quarantine_file(spark, folder):
    """Interval rows without a readable month, written to the quarantine file and read back."""
    g = graph(spark, folder, fold=False)
    damaged = g.interval_table.select("subject", "property", "object", F.when(F.col("property") == "03", "n/a").otherwise(F.col("start_time")).alias("start_time"), "end_time")
    path = stage_path(spark, "quarantine")
    writers.export_quarantine(readers.parse_intervals(damaged)[1], path)
    back = readers.read_delimited(spark, path, text_schema("subject_org_id", "relation_type", "object_org_id", "start_time", "end_time"), sep=",", nulls=())
    return back.groupBy("relation_type", "start_time", "end_time").agg(F.count(F.lit(1)).alias("rows"))


def interval_quarantine(spark, folder):
    """Interval text rows with damaged and reversed dates, read back: good rows by month pair, bad rows counted."""
    g = graph(spark, folder, fold=False)
    damaged = g.interval_table.select(
        "subject", "property", "object",
        F.when(F.col("property") == "03", "n/a").when(F.col("property") == "04", F.col("end_time")).otherwise(F.col("start_time")).alias("start_time"),
        F.when(F.col("property") == "04", F.lit("19900131")).otherwise(F.col("end_time")).alias("end_time"),
    )
    good, bad = readers.parse_intervals(damaged)
    one = F.count(F.lit(1)).alias("rows")
    kept = good.groupBy("start_time", "end_time").agg(one).select(F.lit("good").alias("kind"), "start_time", "end_time", "rows")
    lost = bad.groupBy("start_time", "end_time").agg(one).select(F.lit("bad").alias("kind"), "start_time", "end_time", "rows")
    return kept.unionByName(lost)


def interval_pairs(spark, folder):
    return graph(spark, folder, fold=False).pair_counts


def merged_interval_pairs(spark, folder):
    """Pair counts over merged runs of months, where every time relation occurs."""
    merged = intervals.merge_intervals(graph(spark, folder).intervals)
    return pairs.pair_counts(merged).groupBy("relation_a", "relation_b").agg(
        *[F.sum(c).alias(c) for c in ("comparable_count", *pairs.COUNT_COLUMNS)])


def pair_summary(spark, folder):
    return graph(spark, folder, fold=False).pair_summary


def pair_examples(spark, folder):
    g = graph(spark, folder)
    return pairs.pair_examples(g.intervals, g.pair_counts)


def relation_inventory(spark, folder):
    return graph(spark, folder).inventory


def relation_examples(spark, folder):
    return inventory.relation_examples(graph(spark, folder).scored)


# ---- constraints ----------------------------------------------------------------

def pair_rules(spark, folder):
    """All rules with the data behind their pair."""
    stats = graph(spark, folder).pair_summary.select("relation_a", "relation_b", "comparable_count")
    return dimension.pair_rules(spark).join(F.broadcast(stats), ["relation_a", "relation_b"], "left").na.fill(0)


def candidate_pool(spark, folder):
    return graph(spark, folder).pool.drop("top_overlap_examples", "top_non_overlap_examples")


def proposals(spark, folder):
    """Proposals derived from the pair summary: each observed pair, with the flaws that proposals have."""
    stats = graph(spark, folder).pair_summary
    n = F.col("comparable_count") % 7
    return stats.select(
        F.lit("r1").alias("response_id"), F.concat("relation_a", "relation_b").alias("position"),
        F.lit("").alias("constraint_name"),
        F.when(n == 1, F.col("relation_b")).otherwise(F.col("relation_a")).alias("relation_a"),
        F.when(n == 1, F.col("relation_a")).when(n == 2, F.lit("any")).otherwise(F.col("relation_b")).alias("relation_b"),
        F.when(n == 3, "same_subject").otherwise("same_subject_object").alias("scope"),
        F.when(n == 4, "before").otherwise("overlap").alias("forbidden_temporal_relation"),
        F.lit(None).cast("array<string>").alias("allowed_temporal_relations"),
        F.when(n == 5, "hard").otherwise("soft").alias("hard_or_soft"), F.lit("review").alias("expected_action"),
        F.lit("").alias("typical_positive_example"), F.lit("").alias("typical_negative_example"),
        F.lit("").alias("exception"), F.when(n == 6, "一个主体只能有一个客体").otherwise("").alias("reason"),
    )


def candidate_validation(spark, folder):
    g = graph(spark, folder)
    offered = proposals(spark, folder)
    repeated = offered.unionByName(offered.withColumn("response_id", F.lit("r2")))
    reviewed = candidates.review_proposals(repeated, g.inventory, g.pool)
    return reviewed.select(
        "response_id", "position", "relation_a", "relation_b", "expected_action",
        F.coalesce("rejected", F.lit("kept")).alias("verdict"),
    )


def response_extraction(spark, folder):
    """Response texts derived from the pair summary, in every form proposals come in, read back to rows."""
    item = F.struct("relation_a", "relation_b", F.lit("same_subject_object").alias("scope"))
    per_code = graph(spark, folder).pair_summary.groupBy("relation_a").agg(F.array_sort(F.collect_list(item)).alias("items"))
    body = F.to_json("items")
    form = F.col("relation_a").cast("int") % 9
    wrapper = F.concat(F.lit('{"rules": '), body, F.lit("}"))
    nested = F.transform("items", lambda x: F.regexp_replace(F.translate(F.to_json(x), '"', "'"), r"\}$", ", 'note': {'why': None}}"))
    text = (
        F.when(form == 0, body).when(form == 1, F.concat(F.lit("Proposals:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(form == 2, wrapper).when(form == 5, F.translate(wrapper, '"', "'"))
        .when(form == 6, F.concat(F.lit("As [1] and {x} say: "), wrapper, F.lit(", see [2] and {y}.")))
        .when(form == 7, F.array_join(nested, " or "))
        .when(form == 3, F.regexp_replace(body, r"\]$", ",]")).when(form == 4, F.translate(body, '"', "'"))
        .otherwise(F.array_join(F.transform("items", lambda x: F.to_json(x)), " and "))
    )
    responses = per_code.select(F.col("relation_a").alias("response_id"), text.alias("response_text"))
    return candidates.extract_proposals(responses).select("response_id", "position", "relation_a", "relation_b", "scope")


def accepted_candidates(spark, folder):
    g = graph(spark, folder)
    kept = candidates.accept_proposals(candidates.review_proposals(proposals(spark, folder), g.inventory, g.pool))
    return kept.select("constraint_id", "constraint_key", "constraint_name", "relation_a", "relation_b", "hard_or_soft", "expected_action", "candidate_level")


def source_weights(spark, folder):
    rows = graph(spark, folder).weights
    return rows.withColumn("source_weight", F.round("source_weight", 6))


SCORE_TEXTS = ("program_candidate_reason", "program_recommended_action", "proposed_hard_or_soft", "proposed_reason", "proposed_exception", "scope", "constraint_name")


def constraint_scores(spark, folder):
    return check(spark, folder).scored.drop(*SCORE_TEXTS)


def entity_scores(spark, folder):
    return check(spark, folder).scored.select(
        "constraint_id", "entity_support_count", "entity_negative_count", "entity_unknown_count",
        "entity_instantiation_count", "entity_level_confidence", "entity_violation_rate")


def _instances(spark, folder, violations, limit=500):
    c = check(spark, folder)
    g = c.graph
    return constraints.trigger_instances(g.intervals, c.candidates, g.weights, g.pair_counts, limit, violations).drop("constraint_name")


def trigger_instances(spark, folder):
    return _instances(spark, folder, False)


def violation_instances(spark, folder):
    return _instances(spark, folder, True)


def all_instances(spark, folder):
    """Every judged interval pair of every constraint."""
    return _instances(spark, folder, False, None)


def final_constraints(spark, folder):
    return check(spark, folder, manual=True).final.select(
        "constraint_id", "constraint_key", "auto_filter_status", "auto_final_status", "manual_final_status", "manual_comment",
        "final_status", "is_enabled", "use_for_update", "use_for_review")


# ---- update ---------------------------------------------------------------------

def edge_actions(spark, folder):
    return check(spark, folder, manual=True).sides.select(
        "edge_id", "constraint_id", "side", "cross_source", "low_evidence", "derived", "final_status", "update_action")


def conflicts(spark, folder):
    return check(spark, folder, manual=True).conflicts.drop("constraint_name", "reason")


def decisions(spark, folder):
    return check(spark, folder, manual=True).decisions.drop("reason")


def edge_updates(spark, folder):
    return check(spark, folder, manual=True).after.select(
        "edge_id", "is_mutex_triggered", "update_action", "after_check_status", "original_confidence", "final_confidence",
        "triggered_constraint_ids", "triggered_constraint_keys", "triggered_mutex_relations", "status", "check_action",
        "update_action_label", "relation_type_label")


# ---- baselines and metrics ------------------------------------------------------

def _base(spark, folder):
    g = graph(spark, folder)
    return baselines.evidence_base(g.edges), found_candidates(g)


RESULT = ("edge_id", "action", "triggered", "evidence_group")


def baseline_keep(spark, folder):
    return baselines.keep_all(_base(spark, folder)[0]).select(*RESULT)


def baseline_single_relation(spark, folder):
    return baselines.single_relation(_base(spark, folder)[0]).select(*RESULT)


def baseline_all_pairs(spark, folder):
    base, found = _base(spark, folder)
    return baselines.all_pairs(base, found).select(*RESULT)


def baseline_actual(spark, folder):
    c = check(spark, folder)
    return baselines.actual_update(baselines.evidence_base(c.graph.edges), c.after).select(*RESULT)


def relation_variety(spark, folder):
    return baselines.relation_variety(_base(spark, folder)[0])


def method_metrics(spark, folder):
    return metrics.method_metrics(check(spark, folder).methods)


def method_actions(spark, folder):
    return metrics.method_actions(check(spark, folder).methods)


def method_evidence(spark, folder):
    return metrics.method_evidence_actions(check(spark, folder).methods)


def effectiveness(spark, folder):
    c = check(spark, folder, manual=True)
    return metrics.effectiveness(c.after, c.conflicts)


def evidence_pivot(spark, folder):
    return metrics.evidence_pivot(check(spark, folder, manual=True).after)


def constraint_metrics(spark, folder):
    return metrics.constraint_metrics(check(spark, folder).final)


def status_shares(spark, folder):
    return metrics.value_shares(check(spark, folder).final, "auto_filter_status")


def constraint_summary(spark, folder):
    final = update.legacy_constraints(check(spark, folder, manual=True).final)
    return metrics.constraint_summary(final)


def constraint_distributions(spark, folder):
    final = update.legacy_constraints(check(spark, folder, manual=True).final)
    parts = [metrics.value_counts(final, c, "value").withColumn("field", F.lit(c)) for c in ("source", "hard_or_soft", "final_decision")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def constraint_quality(spark, folder):
    c = check(spark, folder, manual=True)
    return metrics.constraint_quality(c.final, c.conflicts, c.after)


def fusion_summary(spark, folder):
    c = check(spark, folder, manual=True)
    return metrics.long_form(metrics.fusion_summary(c.graph.edges, c.graph.scored, c.after))


def conflict_summary(spark, folder):
    return metrics.conflict_summary(update.legacy_conflicts(check(spark, folder, manual=True).conflicts))


# ---- samples and cases ----------------------------------------------------------

def review_sample(spark, folder):
    return samples.review_sample(graph(spark, folder, fold=False).scored, 100, "edge_id").select("edge_id", "confidence", "manual_is_reasonable", "manual_note")


def hidden_sample(spark, folder):
    return samples.hidden_sample(check(spark, folder, manual=True).after).select("edge_id", "status", "check_action", "manual_is_reasonable", "manual_note")


def case_cross_source(spark, folder):
    return samples.cross_source_cases(graph(spark, folder, fold=False, cut=False).scored).select("edge_id", "confidence", "event_count")


def case_single_source(spark, folder):
    return samples.single_source_cases(check(spark, folder, manual=True).after).select("edge_id", "status", "event_count")


def case_filtered_constraints(spark, folder):
    return samples.filtered_constraint_cases(update.legacy_constraints(check(spark, folder, manual=True).final)).select("constraint_id", "final_decision")


def case_complex(spark, folder):
    return samples.complex_cases(check(spark, folder, manual=True).after).select("edge_id", "check_action")


def case_conflicts(spark, folder):
    c = check(spark, folder, manual=True)
    key = ("subject_org_id", "object_org_id", "month", "constraint_id")
    parts = None
    for name, df in samples.update_cases(c.conflicts, c.decisions).items():
        part = df.select(F.lit(name).alias("case_name"), *key)
        parts = part if parts is None else parts.unionByName(part)
    return parts


# ---- views ----------------------------------------------------------------------

def _links(spark, folder):
    return views.links(check(spark, folder, manual=True).after)


LINK = ("month", "edge_id", "source", "target", "relation", "relation_label", "confidence", "update_action", "update_action_label")


def month_links(spark, folder):
    return _links(spark, folder).select(*LINK, "source_name", "target_name", "original_confidence", "status", "sources", "is_mutex_triggered")


def month_topn(spark, folder):
    return views.top_per_month(_links(spark, folder), 50).select(*LINK)


def node_degree(spark, folder):
    return views.node_degree(_links(spark, folder))


def month_nodes(spark, folder):
    return views.month_nodes(_links(spark, folder))


def display_names(spark, folder):
    return views.enriched_links(_links(spark, folder)).select("edge_id", "source_name", "target_name")


def edge_search(spark, folder):
    found = views.search_edges(
        _links(spark, folder), "nation_1", relations=["06", "07", "16", "17"], actions=["mark_mixed", "人工复核"], min_confidence=0.6,
        only_triggered=True, only_cross_source=True)
    return found.select(*LINK)


def ego_edges(spark, folder):
    return views.ego_rows(_links(spark, folder), "ORG_000003", min_confidence=0.5).select(
        "month", "source_name", "source_org_id", "relation_code", "relation_label", "target_name", "target_org_id", "confidence", "update_action")


def ego_metrics(spark, folder):
    return views.ego_metrics(views.ego_rows(_links(spark, folder), "ORG_000003"))


def ego_network(spark, folder):
    return views.ego_network(_links(spark, folder), "ORG_000003", 30)[0]


def month_view(spark, folder):
    return views.month_view(_links(spark, folder), 40, "人工复核")[0]


def timeline(spark, folder):
    rows = views.timeline(_links(spark, folder), 100)
    return rows.select("month", F.size("nodes").cast("bigint").alias("nodes"), F.size("links").cast("bigint").alias("links"),
                       F.col("nodes")[0]["id"].alias("top_node"), F.col("links")[0]["edge_id"].alias("top_link"))


def timeline_nodes(spark, folder):
    return views.timeline_rows(_links(spark, folder))[0]


def timeline_links(spark, folder):
    """All links of all months."""
    return views.timeline_rows(_links(spark, folder))[1].drop("update_reason")


def graph_nodes(spark, folder):
    return views.graph_nodes(graph(spark, folder, cut=False).scored)


def graph_edges(spark, folder):
    return views.graph_edges(graph(spark, folder, cut=False).scored).select("edge_id", "event_count", "confidence")


def graph_query(spark, folder):
    rows = graph(spark, folder).scored
    return views.graph_query(views.graph_nodes(rows), rows, "nation_2", ["03", "06", "12"], ["active"], 0.6, 300)


def graph_query_nodes(spark, folder):
    rows = graph(spark, folder).scored
    return views.query_nodes(views.graph_query(views.graph_nodes(rows), rows, "nation_2", min_confidence=0.6))


def edge_table(spark, folder):
    rows = graph(spark, folder).scored
    return views.edge_table(views.graph_query(views.graph_nodes(rows), rows, limit=200))


def graph_totals(spark, folder):
    rows = graph(spark, folder).scored
    return views.graph_totals(views.graph_nodes(rows), rows)


def option_lists(spark, folder):
    rows = graph(spark, folder).scored
    return views.options(rows, "relation_type").withColumn("list", F.lit("relation")).unionByName(
        views.options(rows, "confidence_level").withColumn("list", F.lit("level")))


def overview(spark, folder):
    c = check(spark, folder, manual=True)
    return views.overview(c.after, c.conflicts, c.final, c.decisions)


def constraint_list(spark, folder):
    return views.constraint_list(check(spark, folder, manual=True).final, ["enabled_for_update", "review_only"], 0.7).select(
        "constraint_id", "relation_a_label", "relation_b_label", "final_status", "structural_confidence")


def conflict_list(spark, folder):
    return views.conflict_list(check(spark, folder, manual=True).conflicts, ["1996-01", "1996-02"], ["review"]).select(
        "month", "subject_org_id", "object_org_id", "relation_a_label", "relation_b_label", "constraint_id")


# ---- stream ---------------------------------------------------------------------

def _stream_of(spark, folder, batches):
    """Line items as a stream of so many files, each with rows of all months, a file a batch; the graph's dictionary and seed.

    Each batch joins the orders with their customers, a stage table, so customers are joined once.
    """
    source = testfeed.table(spark, folder, "lineitem").drop("l_extendedprice", "l_discount", "l_tax")  # feeds have no use for them
    files = stage_path(spark, "feed")
    source.repartition(batches, "l_orderkey").write.parquet(files)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(files)
    orders = cut_lineage(testfeed.orders_of_buyers(spark, folder).select("o_orderkey", "c_nationkey", "o_orderpriority", "c_name", "c_mktsegment"))
    return testfeed.feed_b(spark, folder, lineitem=stream, orders=orders), graph(spark, folder, fold=False, cut=False)


def _streamed(spark, folder):
    """The path of the table of partial counts after ten batches, and the seed."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STREAMS:
        events, g = _stream_of(spark, folder, 10)
        path = stage_path(spark, "stream")
        fuse.fuse_stream(events, g.b_dictionary, path, path + "-state").awaitTermination()
        _STREAMS[key] = path, g.seed
    return _STREAMS[key]


def stream_fuse(spark, folder):
    path, seed = _streamed(spark, folder)
    return fuse.stream_edges(spark, path, seed)


def stream_log(spark, folder):
    path, seed = _streamed(spark, folder)
    return fuse.stream_log(spark, path, seed)


def stream_new_keys(spark, folder):
    """Edges that the stream opened, from keyed state in the engine over ten batches with late rows in each."""
    events, g = _stream_of(spark, folder, 10)
    path = stage_path(spark, "keys")
    fuse.first_keys_stream(events, g.b_dictionary, path, path + "-state").awaitTermination()
    return fuse.new_keys(spark, path, g.seed).drop("first_batch")


_NOT_QUERIES = {"graph", "check", "forget_stages", "found_candidates", "reviews", "found_actors", "raw_names", "proposals"}


def all_queries() -> dict[str, Query]:
    return {
        name: f for name, f in globals().items()
        if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")
        and name not in _NOT_QUERIES and name != "all_queries"
    }
