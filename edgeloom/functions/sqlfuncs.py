"""The scalar rules as SQL functions, so that SQL users need no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from edgeloom.constants import FEED_A, FEED_B, LOW_EVIDENCE, SCORE_BASE, SCORE_COUNT_CAP, SCORE_CROSS_BONUS, SCORE_PENALTY, SOURCE_WEIGHTS

_IN_A, _IN_B = (f"contains(sources, '{feed}')" for feed in (FEED_A, FEED_B))
_UPPER_A, _UPPER_B = (f"contains(upper(sources), '{feed}')" for feed in (FEED_A, FEED_B))

# `aligned_text` cleans a name as `aligned_name` does before it replaces whole-name abbreviations.
_FUNCTIONS = {
    "light_name(name STRING)": (
        "STRING", r"trim(regexp_replace(upper(coalesce(name, '')), '\\s+', ' '))"),
    "lookup_name(name STRING)": (
        "STRING",
        r"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(upper(coalesce(name, '')),"
        r" '\\(.*?\\)|\\[.*?\\]', ' '), '[^A-Z0-9\\s]', ' '), '\\s+', ' ')), '^THE\\s+', '')"),
    "aligned_text(name STRING)": (
        "STRING",
        r"trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace("
        r"regexp_replace(translate(upper(coalesce(name, '')), '[]{}', '()()'), '[^A-Z0-9\\s()]', ' '), '\\s+', ' ')),"
        r" '\\s+\\)', ')'), '\\(\\s+', '('), '\\(\\s*\\)', ' '), '\\s+', ' ')), '^THE ', ''))"),
    "code_digits(code STRING)": (
        "STRING", r"regexp_replace(substring_index(trim(coalesce(code, '')), '.', 1), '\\D', '')"),
    "two_digits(n INT)": (
        "STRING", "CASE WHEN n BETWEEN 1 AND 20 THEN lpad(cast(n AS STRING), 2, '0') ELSE '' END"),
    "padded_code(code STRING)": (
        "STRING", "CASE WHEN length(code_digits(code)) IN (1, 2) THEN lpad(code_digits(code), 3, '0') ELSE code_digits(code) END"),
    "relation_padded(code STRING)": (
        "STRING", "two_digits(try_cast(substring(padded_code(code), 1, 2) AS INT))"),
    "relation_compact(code STRING)": (
        "STRING",
        "CASE WHEN length(code_digits(code)) > 2 THEN two_digits(try_cast(substring(code_digits(code), 1, 2) AS INT))"
        " WHEN try_cast(code_digits(code) AS INT) BETWEEN 1 AND 20 THEN two_digits(try_cast(code_digits(code) AS INT))"
        " WHEN try_cast(substring(code_digits(code), 1, 1) AS INT) BETWEEN 1 AND 9"
        " THEN two_digits(try_cast(substring(code_digits(code), 1, 1) AS INT)) ELSE '' END"),
    "relation_strict(code STRING)": (
        "STRING",
        "CASE WHEN length(code_digits(code)) <= 2 THEN two_digits(try_cast(code_digits(code) AS INT)) ELSE '' END"),
    "month_interval_relation(a1 INT, a2 INT, b1 INT, b2 INT)": (
        "STRING",
        "CASE WHEN a2 + 1 = b1 OR b2 + 1 = a1 THEN 'meet' WHEN a2 < b1 THEN 'before' WHEN b2 < a1 THEN 'after'"
        " WHEN a1 = b1 AND a2 = b2 THEN 'equal' WHEN a1 <= b1 AND a2 >= b2 THEN 'contains'"
        " WHEN a1 >= b1 AND a2 <= b2 THEN 'during' ELSE 'overlap' END"),
    "exclusion_truth(relation STRING, forbidden STRING)": (
        "INT",
        "CASE WHEN (coalesce(nullif(trim(forbidden), ''), 'overlap') IN ('overlap', 'same_month')"
        " AND relation IN ('overlap', 'during', 'contains', 'equal'))"
        " OR (trim(forbidden) NOT IN ('', 'overlap', 'same_month') AND relation = trim(forbidden)) THEN -1"
        " WHEN relation IN ('before', 'after', 'meet', 'disjoint') THEN 1 ELSE 0 END"),
    "edge_confidence(sources STRING, events BIGINT, a_events BIGINT, b_events BIGINT, old DOUBLE)": (
        "DOUBLE",
        "round(greatest(0.0D, least(1.0D,"
        f" CASE WHEN {_IN_A} AND {_IN_B} THEN {SCORE_BASE['cross']}D WHEN {_IN_A} THEN {SCORE_BASE['a']}D WHEN {_IN_B} THEN {SCORE_BASE['b']}D ELSE old END"
        f" + CASE WHEN a_events > 0 AND b_events > 0 THEN {SCORE_CROSS_BONUS}D ELSE 0D END"
        f" + CASE WHEN events > 0 THEN least(log1p(events) / 10.0D, {SCORE_COUNT_CAP}D) ELSE 0D END"
        f" - CASE WHEN events <= 1 THEN {SCORE_PENALTY}D ELSE 0D END"
        f" - CASE WHEN {_IN_B} AND NOT {_IN_A} AND b_events <= 2 THEN {SCORE_PENALTY}D ELSE 0D END)), 4)"),
    "source_weight(sources STRING, a_events BIGINT, b_events BIGINT, confidence DOUBLE, mentions DOUBLE, articles DOUBLE)": (
        "DOUBLE",
        f"CASE WHEN (a_events > 0 OR {_UPPER_A}) AND (b_events > 0 OR {_UPPER_B}) THEN {SOURCE_WEIGHTS['cross']}D"
        f" WHEN a_events > 0 OR {_UPPER_A} THEN {SOURCE_WEIGHTS['a']}D"
        f" WHEN b_events > 0 OR {_UPPER_B} THEN"
        f" CASE WHEN confidence < {LOW_EVIDENCE}D OR (coalesce(mentions, 0) <= 1 AND coalesce(articles, 0) <= 1) THEN {SOURCE_WEIGHTS['b_low']}D ELSE {SOURCE_WEIGHTS['b']}D END"
        f" ELSE {SOURCE_WEIGHTS['none']}D END"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the session's temporary SQL functions; returns their names."""
    names = []
    for signature, (returns, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")
        names.append(signature.split("(", 1)[0])
    return names
