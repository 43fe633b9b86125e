"""Candidate constraints: the pool of plausible relation pairs, and proposals read from response texts."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.constants import (
    ALLOWED_ACTIONS,
    ALLOWED_FORBIDDEN,
    CONSTRAINT_ID_FORMAT,
    MEANINGLESS_REASONS,
    POOL_MIN_COMPARABLE,
    POOL_MIN_INTERVALS,
    RELATION_LABELS,
    RESPONSE_WRAPPER_KEYS,
)
from edgeloom.functions.codes import ordered_pair, relation_light
from edgeloom.functions.names import any_of
from edgeloom.functions.parse import clean_text, lookup
from edgeloom.operators.dimension import usable_pair_rules
from edgeloom.operators.pairs import COUNT_COLUMNS
from edgeloom.sources.schemas import RESPONSE_ITEM

SUMMARY_COUNTS = ("comparable_count", *COUNT_COLUMNS, "non_overlap_count", "violation_like_overlap_count")
SUMMARY_RATES = ("overlap_rate", "non_overlap_rate")
SUMMARY_TEXTS = ("top_overlap_examples", "top_non_overlap_examples")


def candidate_pool(
    inventory: DataFrame, summary: DataFrame, examples: DataFrame | None = None,
    min_comparable: int = POOL_MIN_COMPARABLE, min_intervals: int = POOL_MIN_INTERVALS, max_pairs: int = 0,
) -> DataFrame:
    """Usable relation pairs of the inventory with enough data, strong ones first.

    The 51 usable rules drive the joins, so nothing here grows with the data.
    """
    present = inventory.select("relation_type", "interval_count")

    def side(s: str) -> DataFrame:
        return F.broadcast(present.select(
            F.col("relation_type").alias(f"relation_{s}"), F.col("interval_count").alias(f"relation_{s}_total_interval_count")
        ))

    rules = usable_pair_rules(inventory.sparkSession).join(side("a"), "relation_a").join(side("b"), "relation_b")
    stats = summary.select("relation_a", "relation_b", *SUMMARY_COUNTS, *SUMMARY_RATES)
    if examples is not None:
        stats = stats.join(examples, ["relation_a", "relation_b"], "left")
    stats = stats.drop("relation_a_total_interval_count", "relation_b_total_interval_count")
    joined = rules.join(F.broadcast(stats), ["relation_a", "relation_b"], "left").na.fill(0, list(SUMMARY_COUNTS)).na.fill(0.0, list(SUMMARY_RATES))
    texts = [F.coalesce(c, F.lit("")).alias(c) if examples is not None else F.lit("").alias(c) for c in SUMMARY_TEXTS]
    strong = F.col("candidate_level") == "strong_candidate"
    both_held = F.least("relation_a_total_interval_count", "relation_b_total_interval_count") >= min_intervals
    kept = joined.where(
        (F.col("comparable_count") >= min_comparable)
        | (strong & both_held)
        | (~strong & (F.col("comparable_count") > 0))
    )
    pool = kept.select(
        F.concat_ws("_", "relation_a", "relation_b", F.lit("overlap")).alias("pair_id"),
        "relation_a", "relation_b",
        lookup("relation_a", RELATION_LABELS).alias("relation_a_name_zh"),
        lookup("relation_b", RELATION_LABELS).alias("relation_b_name_zh"),
        "candidate_level", "candidate_reason", "recommended_action",
        F.lit("overlap").alias("forbidden_temporal_relation"), F.lit("same_subject_object").alias("scope"),
        "relation_a_total_interval_count", "relation_b_total_interval_count",
        *SUMMARY_COUNTS, *SUMMARY_RATES, *texts,
    )
    ranked = pool.orderBy(
        (F.col("candidate_level") == "strong_candidate").desc(),
        F.desc("comparable_count"), F.desc("overlap_rate"), F.desc("non_overlap_rate"), "relation_a", "relation_b",
    )
    return ranked.limit(max_pairs) if max_pairs > 0 else ranked


# ---- response texts -----------------------------------------------------------

def _tidy(text: Column) -> Column:
    """Fence marks, comments, trailing commas and typographic quotes removed, as far as patterns can tell."""
    text = F.regexp_replace(text, r"(?i)^\s*json\s*", "")
    text = F.regexp_replace(text, r"//[^\n]*", "")
    text = F.regexp_replace(text, r",\s*([\]}])", "$1")
    return F.translate(text, "“”‘’", "\"\"''")


def _is_json(body: Column, first: str) -> Column:
    """Whole text parses as JSON and starts as asked; Spark's reader alone would accept a valid head."""
    return F.try_parse_json(body).isNotNull() & F.trim(body).startswith(first)


def tidy_text(text: str) -> str:
    """As `_tidy`, for the texts that Spark's reader can't take."""
    text = re.sub(r"^\s*json\s*", "", text.strip(), flags=re.IGNORECASE)
    text = re.sub(r",\s*([\]}])", r"\1", re.sub(r"//[^\n]*", "", text))
    return text.translate(str.maketrans("“”‘’", "\"\"''"))


def _items(value: object) -> list[dict]:
    """The objects of an array, or of the first wrapper key that holds one."""
    if isinstance(value, dict):
        value = next((value[k] for k in RESPONSE_WRAPPER_KEYS if isinstance(value.get(k), list)), [])
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _literal(text: str) -> object:
    """Value of a JSON or a Python literal text, None if it is neither."""
    for parse in (json.loads, ast.literal_eval):
        try:
            return parse(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    return None


def _between(text: str, opening: str, closing: str) -> str:
    start, end = text.find(opening), text.rfind(closing)
    return text[start : end + 1] if 0 <= start < end else ""


def _embedded(text: str) -> list[dict]:
    """Items of the first JSON value that starts at any opening bracket and has some."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", text):
        try:
            found = _items(decoder.raw_decode(text, m.start())[0])
        except (ValueError, RecursionError):
            continue
        if found:
            return found
    return []


def _loose(text: str) -> list[dict]:
    """Readable objects that name a relation, each the outermost of its nest."""
    opened, spans = [], []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            spans.append((opened.pop(), m.end()))
    found, reached = [], 0
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        value = _literal(text[start:end]) if start >= reached else None
        if isinstance(value, dict) and ("relation_a" in value or "relation_b" in value):
            found.append(value)
            reached = end
    return found


def read_response(text: str) -> list[dict]:
    """Proposals of a response: its likely parts as wholes first, then values and objects within it."""
    fence = re.search(r"```(?:json)?(.*?)```", text, flags=re.IGNORECASE | re.DOTALL)
    for body in (fence[1] if fence else "", text, _between(text, "[", "]"), _between(text, "{", "}")):
        body = tidy_text(body)
        found = _items(_literal(body)) if body else []
        if found:
            return found
    text = tidy_text(text)
    return _embedded(text) or _loose(text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tolerant_items(texts: pd.Series) -> pd.Series:
    """One JSON text for each proposal of responses that are no plain JSON; null stays empty."""
    return texts.map(lambda t: [json.dumps(x, ensure_ascii=False, default=str) for x in read_response(t)] if t is not None else [])


def extract_proposals(responses: DataFrame) -> DataFrame:
    """One row per proposed constraint in each response text, in order of appearance.

    A response, or the fenced part of it, that is a JSON array or wrapper is read by Spark's
    own reader, once; only other texts go through the tolerant reader.
    """
    items = T.ArrayType(RESPONSE_ITEM)
    wrapper = T.StructType([T.StructField(k, items) for k in RESPONSE_WRAPPER_KEYS])
    fence = F.regexp_extract("response_text", r"(?is)```(?:json)?(.*?)```", 1)
    body = _tidy(F.trim(F.when(F.trim(fence) != "", fence).otherwise(F.col("response_text"))))
    parsed = responses.select("response_id", "response_text", body.alias("_body"))
    wrapped = F.when(_is_json(F.col("_body"), "{"), F.from_json("_body", wrapper))
    array = F.when(_is_json(F.col("_body"), "["), F.from_json("_body", items))
    parsed = parsed.withColumns({"_array": array, "_wrapped": wrapped})
    first = F.coalesce("_array", *[F.col("_wrapped")[k] for k in RESPONSE_WRAPPER_KEYS])
    plain = F.filter(first, lambda x: x.isNotNull())
    read = parsed.select("response_id", "response_text", F.when(F.size(plain) > 0, plain).alias("items"))
    tolerant = F.transform(_tolerant_items(F.when(F.col("items").isNull(), F.col("response_text"))), lambda x: F.from_json(x, RESPONSE_ITEM))
    return read.select("response_id", F.posexplode(F.coalesce("items", tolerant)).alias("position", "p")).select(
        "response_id", "position", "p.*"
    )


# ---- validation ---------------------------------------------------------------

def review_proposals(proposals: DataFrame, inventory: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Proposals with canonical pair order, program level and action, and the first gate each one fails (null when kept).

    Of proposals for the same pair and forbidden relation the first is kept.
    An empty or absent pool switches the pool gate off.
    """
    a, b = relation_light("relation_a"), relation_light("relation_b")
    low, high = ordered_pair(a, b)
    rows = proposals.select(
        "response_id", "position",
        F.coalesce("constraint_name", F.lit("")).alias("constraint_name"),
        low.alias("relation_a"), high.alias("relation_b"),
        clean_text("scope").alias("scope"),
        F.coalesce(F.trim("forbidden_temporal_relation"), F.lit("overlap")).alias("forbidden_temporal_relation"),
        "allowed_temporal_relations",
        F.coalesce(F.trim("hard_or_soft"), F.lit("soft")).alias("hard_or_soft"),
        F.coalesce(F.trim("expected_action"), F.lit("review")).alias("proposed_action"),
        F.coalesce("typical_positive_example", F.lit("")).alias("typical_positive_example"),
        F.coalesce("typical_negative_example", F.lit("")).alias("typical_negative_example"),
        clean_text("exception").alias("exception"), clean_text("reason").alias("reason"),
    )
    codes = F.broadcast(inventory.select(F.col("relation_type").alias("_code")).distinct())
    for side in ("a", "b"):
        known = codes.select(F.col("_code").alias(f"_code_{side}"))
        rows = rows.join(known, F.col(f"relation_{side}") == F.col(f"_code_{side}"), "left")
    rules = F.broadcast(usable_pair_rules(proposals.sparkSession))
    rows = rows.join(rules, ["relation_a", "relation_b"], "left")
    if pool is None:
        rows = rows.withColumns({"_pooled": F.lit(True), "_pool_open": F.lit(True)})
    else:
        pairs = pool.select("relation_a", "relation_b").distinct()
        size = pairs.agg((F.count(F.lit(1)) == 0).alias("_pool_open"))
        rows = rows.join(F.broadcast(pairs.withColumn("_pooled", F.lit(True))), ["relation_a", "relation_b"], "left")
        rows = rows.join(F.broadcast(size))  # one row
    reason = F.col("reason")
    hard = F.col("hard_or_soft") == "hard"
    action = F.coalesce("recommended_action", F.when(F.col("proposed_action").isin(*ALLOWED_ACTIONS), F.col("proposed_action")).otherwise("review"))
    rows = rows.withColumn("expected_action", action)
    says_low = F.col("exception").contains("证据") | reason.contains("低证据") | reason.contains("低置信")
    rejected = (
        F.when((F.col("relation_a") == "") | (F.col("relation_b") == ""), "blank_relation")
        .when(F.col("relation_a") == F.col("relation_b"), "same_relation")
        .when((F.lower("relation_a") == "any") | (F.lower("relation_b") == "any"), "wildcard")
        .when(F.col("_code_a").isNull() | F.col("_code_b").isNull(), "unknown_relation")
        .when(~F.col("_pool_open") & F.col("_pooled").isNull(), "outside_pool")
        .when(F.col("candidate_level").isNull(), "implausible_pair")
        .when(F.col("scope") != "same_subject_object", "scope")
        .when(~F.col("forbidden_temporal_relation").isin(*ALLOWED_FORBIDDEN), "forbidden_relation")
        .when(reason.rlike(any_of(MEANINGLESS_REASONS)), "meaningless_reason")
        .when(hard & (F.col("exception") == ""), "hard_without_exception")
        .when(hard & (F.col("expected_action") == "hide") & ~says_low, "hard_hide_without_evidence")
    )
    gated = rows.withColumn("rejected", rejected)
    # First kept proposal per pair and forbidden relation; a grouping, so a popular pair cannot pile up in one task.
    order = F.struct("response_id", "position")
    firsts = gated.where("rejected is null").groupBy("relation_a", "relation_b", "forbidden_temporal_relation").agg(
        F.min(order).alias("_first")
    )
    key = ["relation_a", "relation_b", "forbidden_temporal_relation"]
    marked = gated.join(F.broadcast(firsts), key, "left")  # at most 190 pairs times two relations
    return marked.withColumn(
        "rejected", F.when(F.col("rejected").isNull() & (F.col("_first") != order), "duplicate").otherwise(F.col("rejected"))
    ).drop("_first", "_pooled", "_pool_open", "_code_a", "_code_b")


def accept_proposals(reviewed: DataFrame) -> DataFrame:
    """Kept proposals as candidate constraints with ids in order of appearance (at most 102, so one task numbers them)."""
    number = F.row_number().over(Window.orderBy("response_id", "position"))
    label = lambda c: lookup(c, RELATION_LABELS)
    default_name = F.concat(label("relation_a"), F.lit("与"), label("relation_b"), F.lit("互斥候选"))
    return reviewed.where("rejected is null").select(
        F.format_string(CONSTRAINT_ID_FORMAT, number).alias("constraint_id"),
        F.concat_ws("_", "relation_a", "relation_b", "forbidden_temporal_relation").alias("constraint_key"),
        F.coalesce(F.nullif("constraint_name", F.lit("")), default_name).alias("constraint_name"),
        "relation_a", "relation_b", "scope", "forbidden_temporal_relation", "allowed_temporal_relations",
        F.when(F.col("hard_or_soft").isin("soft", "hard"), F.col("hard_or_soft")).otherwise("soft").alias("hard_or_soft"),
        "expected_action", "candidate_level",
        F.col("candidate_reason").alias("program_candidate_reason"),
        F.col("recommended_action").alias("program_recommended_action"),
        "typical_positive_example", "typical_negative_example", "exception", "reason",
        F.lit("kept").alias("auto_filter_status"),
    )


def candidates_from_pool(pool: DataFrame) -> DataFrame:
    """Every pooled pair as a candidate, for runs without proposals. The pool is bounded by its rules."""
    proposals = pool.select(
        F.lit("pool").alias("response_id"), F.col("pair_id").alias("position"),
        F.col("pair_id").alias("constraint_name"), "relation_a", "relation_b", "scope", "forbidden_temporal_relation",
        F.lit(None).cast("array<string>").alias("allowed_temporal_relations"),
        F.lit("soft").alias("hard_or_soft"), F.col("recommended_action").alias("expected_action"),
        F.lit("").alias("typical_positive_example"), F.lit("").alias("typical_negative_example"),
        F.lit("").alias("exception"), F.col("candidate_reason").alias("reason"),
        "candidate_level", "candidate_reason", "recommended_action", F.lit(None).cast("string").alias("rejected"),
    )
    return accept_proposals(proposals)
