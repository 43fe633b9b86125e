"""The registered queries once more as plain SQL, for an independent check on the same tables.

Written as named common table expressions; each query pulls in the ones it
needs. Nothing here shares code with the Spark side except fixed word lists
and labels. Pairs are counted the naive way, by joining them.
"""

from __future__ import annotations

import re

from edgeloom import constants as C


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def alternation(values) -> str:
    return text("|".join(values))


def choose(column: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {text(k)} THEN {text(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {default or column} END"


# ---- scalar expressions -----------------------------------------------------------

def clean(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def light(x: str) -> str:
    return squeeze(f"upper(coalesce({x}, ''))")


def lookup(x: str) -> str:
    bare = rf"regexp_replace(upper(coalesce({x}, '')), '\(.*?\)|\[.*?\]', ' ', 'g')"
    plain = squeeze(rf"regexp_replace({bare}, '[^A-Z0-9\s]', ' ', 'g')")
    return rf"regexp_replace({plain}, '^THE\s+', '')"


def aligned_text(x: str) -> str:
    bracket = f"translate(upper(coalesce({x}, '')), '[]{{}}', '()()')"
    plain = squeeze(rf"regexp_replace({bracket}, '[^A-Z0-9\s()]', ' ', 'g')")
    tight = rf"regexp_replace(regexp_replace({plain}, '\s+\)', ')', 'g'), '\(\s+', '(', 'g')"
    return rf"trim(regexp_replace({squeeze(rf'''regexp_replace({tight}, '\(\s*\)', ' ', 'g')''')}, '^THE ', ''))"


def aligned(x: str) -> str:
    return choose(aligned_text(x), C.ABBREVIATION_MAP)


def digits(x: str) -> str:
    return rf"regexp_replace(split_part(coalesce({x}, ''), '.', 1), '\D', '', 'g')"


def two(n: str) -> str:
    return f"CASE WHEN {n} BETWEEN 1 AND 20 THEN lpad(CAST({n} AS VARCHAR), 2, '0') ELSE '' END"


def number(x: str) -> str:
    return f"TRY_CAST({x} AS INTEGER)"


def padded(x: str) -> str:
    d = digits(x)
    return f"CASE WHEN length({d}) IN (1, 2) THEN lpad({d}, 3, '0') ELSE {d} END"


def from_padded(x: str) -> str:
    return two(number(f"substr({padded(x)}, 1, 2)"))


def from_compact(x: str) -> str:
    d = digits(x)
    return (
        f"CASE WHEN length({d}) > 2 THEN {two(number(f'substr({d}, 1, 2)'))} WHEN {number(d)} BETWEEN 1 AND 20 THEN {two(number(d))} "
        f"WHEN {number(f'substr({d}, 1, 1)')} BETWEEN 1 AND 9 THEN '0' || substr({d}, 1, 1) ELSE '' END"
    )


def strict(x: str) -> str:
    d = digits(x)
    return f"CASE WHEN length({d}) <= 2 THEN {two(number(d))} ELSE '' END"


def group_of(code: str) -> str:
    whens = " ".join(f"WHEN {code} BETWEEN {text(a)} AND {text(b)} THEN {text(n)}" for n, (a, b) in C.EVALUATION_GROUPS.items())
    return f"CASE {whens} ELSE '' END"


def month_label(n: str) -> str:
    return f"lpad(CAST({n} // 12 AS VARCHAR), 4, '0') || '-' || lpad(CAST({n} % 12 + 1 AS VARCHAR), 2, '0')"


def time_relation(a1: str, a2: str, b1: str, b2: str) -> str:
    return (
        f"CASE WHEN {a2} < {b1} THEN CASE WHEN {a2} + 1 = {b1} THEN 'meet' ELSE 'before' END "
        f"WHEN {b2} < {a1} THEN CASE WHEN {b2} + 1 = {a1} THEN 'meet' ELSE 'after' END "
        f"WHEN {a1} = {b1} AND {a2} = {b2} THEN 'equal' WHEN {a1} <= {b1} AND {a2} >= {b2} THEN 'contains' "
        f"WHEN {a1} >= {b1} AND {a2} <= {b2} THEN 'during' ELSE 'overlap' END"
    )


def share(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


def percent(a: str, b: str) -> str:
    return f"printf('%.2f%%', round({share(a, b)} * 100, 2))"


def whole(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def count_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


KINDS = ("before", "after", "meet", "overlap", "during", "contains", "equal")
KIND_COUNTS = ", ".join(f"{whole(count_if(f'kind = {text(k)}'))} AS {k}_count" for k in KINDS)
SUM_COUNTS = ", ".join(f"{whole(f'sum({k}_count)')} AS {k}_count" for k in KINDS)
LIST_COUNTS = ", ".join(f"{k}_count" for k in KINDS)
BAD = f"{words((*C.BAD_NAMES, *C.GENERIC_CODE_NAMES, *C.GENERIC_EXACT_NAMES))}"


def bad_name(n: str) -> str:
    return (
        rf"({n} IN {BAD} OR length({n}) <= 1 OR regexp_full_match({n}, '\d+') OR starts_with({n}, 'CITIZEN (') "
        rf"OR len(string_split({n}, ' ')) > 12)"
    )


def org_name(n: str) -> str:
    return (
        f"(NOT {bad_name(n)} AND {n} NOT IN {words(C.ORG_NAME_KEYWORDS)} AND len(string_split({n}, ' ')) >= 2 "
        f"AND regexp_matches({n}, {alternation(C.ORG_NAME_KEYWORDS)}))"
    )


def reduction_signal(p: str) -> str:
    name = f"upper({clean(f'{p}Name')})"
    typed = " OR ".join(f"upper({p}Type{i}Code) IN {words(C.REDUCTION_TYPE_CODES)}" for i in (1, 2, 3))
    return (
        f"(({clean(f'{p}KnownGroupCode')} <> '' OR {typed} OR regexp_matches({name}, {alternation(C.REDUCTION_NAME_HINTS)})) "
        f"AND {name} NOT IN {words(C.REDUCTION_BAD_NAMES)})"
    )


def packed(p: str) -> str:
    def code(x):
        return f"coalesce(nullif({clean(x)}, ''), 'nan')"

    k, a, b, c = (f"{p}KnownGroupCode", f"{p}Type1Code", f"{p}Type2Code", f"{p}Type3Code")
    return (
        f"upper(CASE WHEN {clean(k)} <> '' THEN concat_ws(' ', {code(k)}, {code(a)}, {code(b)}, 'nan') "
        f"ELSE concat_ws(' ', {code(a)}, {code(b)}, {code(c)}, 'nan') END)"
    )


def rule_rows() -> str:
    """The rule table written from the groups, first match first."""
    p = C
    listed_chain = words(a + b for a, b in p.PROCESS_CHAIN_PAIRS)
    listed_inner = words(a + b for a, b in p.INTERNAL_CONFLICT_PAIRS)

    def cross(left, right):
        return f"((a IN {words(left)} AND b IN {words(right)}) OR (b IN {words(left)} AND a IN {words(right)}))"

    cases = [
        (f"a IN {words(p.BROAD_RELATIONS)} OR b IN {words(p.BROAD_RELATIONS)}", "blocked", "broad", "review"),
        (f"a || b IN {listed_chain}", "blocked", "process_chain", "review"),
        (f"a || b IN {listed_inner}", "blocked", "internal_conflict", "review"),
        (cross(p.RULE_VERBAL_CONFLICT, p.RULE_VERBAL_CONFLICT), "blocked", "inside_verbal", "review"),
        (cross(p.SEVERE_CONFLICT, p.SEVERE_CONFLICT), "blocked", "inside_severe", "review"),
        (cross(p.MATERIAL_COOPERATION, p.SEVERE_CONFLICT), "strong_candidate", "material_vs_severe", "mark_mixed_or_downgrade"),
        (cross(p.VERBAL_DIPLOMACY, p.MILITARY_OR_COERCIVE), "weak_candidate", "diplomacy_vs_force", "mark_mixed"),
        (cross(p.NEGOTIATION, p.SANCTION_OR_BREAK), "weak_candidate", "negotiation_vs_sanction", "mark_mixed"),
        (cross(p.COOPERATION_ALL, p.THREAT_REJECT_CRITICIZE), "weak_candidate", "cooperation_vs_threat", "review"),
        (cross(p.AID_OR_CONCESSION, p.PROTEST_OR_UNCONVENTIONAL), "weak_candidate", "aid_vs_protest", "review"),
    ]

    def column(i, default):
        whens = " ".join(f"WHEN {c[0]} THEN {text(p.PAIR_RULE_TEXTS[c[2]] if i == 2 else c[i])}" for c in cases)
        return f"CASE {whens} ELSE {text(default)} END"

    return (
        f"SELECT a AS relation_a, b AS relation_b, {column(1, 'blocked')} AS candidate_level, "
        f"{column(2, p.PAIR_RULE_TEXTS['other'])} AS candidate_reason, {column(3, 'review')} AS recommended_action "
        "FROM (SELECT lpad(CAST(x.i AS VARCHAR), 2, '0') AS a, lpad(CAST(y.i AS VARCHAR), 2, '0') AS b "
        "FROM range(1, 21) x(i) JOIN range(1, 21) y(i) ON x.i < y.i)"
    )


EDGE_KEY = "subject_org_id, object_org_id, event_month, relation_type"
EDGE_ID = "event_month || '|' || subject_org_id || '|' || object_org_id || '|' || relation_type"


def graph_ctes(fold: bool) -> dict[str, str]:
    day = "make_date(1996, quarter(l_shipdate), CAST(day(l_shipdate) % 28 + 1 AS INTEGER))" if fold else "CAST(l_shipdate AS DATE)"
    in_a, in_b = "contains(source_datasets, 'ICEWS')", "contains(source_datasets, 'GDELT')"
    events, a, b = "event_count", "icews_event_count", "gdelt_event_count"
    weak_b = f"({in_b} AND NOT {in_a} AND {b} <= 2)"
    score = (
        f"round(greatest(0.0, least(1.0, CASE WHEN {in_a} AND {in_b} THEN 0.70 WHEN {in_a} THEN 0.55 WHEN {in_b} THEN 0.40 ELSE confidence END::DOUBLE"
        f" + CASE WHEN {a} > 0 AND {b} > 0 THEN 0.20 ELSE 0.0 END::DOUBLE + least(ln(1 + {events}) / 10, 0.20::DOUBLE)"
        f" - CASE WHEN {events} <= 1 THEN 0.15 ELSE 0.0 END::DOUBLE - CASE WHEN {weak_b} THEN 0.15 ELSE 0.0 END::DOUBLE)), 4)"
    )
    return {
        "ev": f"""SELECT {day} AS event_day, CAST(l_partkey % 20 + 1 AS INTEGER) AS code_number, l.*, o.o_orderpriority, c.c_name, c.c_mktsegment,
            s.s_name, n1.n_name AS buyer_nation, r1.r_name AS buyer_region, n2.n_name AS seller_nation, r2.r_name AS seller_region
            FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey
            JOIN supplier s ON l_suppkey = s_suppkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region r1 ON n1.n_regionkey = r1.r_regionkey
            JOIN nation n2 ON s_nationkey = n2.n_nationkey JOIN region r2 ON n2.n_regionkey = r2.r_regionkey""",
        "fa": """SELECT strftime(event_day, '%Y-%m-%d') AS event_date, strftime(event_day, '%Y-%m') AS event_month,
            'The ' || buyer_nation || ' ' || c_mktsegment || ' (' || buyer_region || ')' AS source_name,
            c_mktsegment || CASE WHEN starts_with(o_orderpriority, '1') THEN ', Government' ELSE '' END AS source_sectors,
            seller_nation || ' [' || seller_region || ']' AS target_name,
            CASE WHEN l_returnflag = 'R' THEN 'Business' ELSE '' END AS target_sectors,
            lpad(CAST(code_number * 10 AS VARCHAR), 3, '0') AS code, CASE WHEN l_linestatus = 'O' THEN seller_nation ELSE '' END AS city,
            seller_region AS country, 'Publisher ' || l_returnflag AS publisher, CAST(l_orderkey AS VARCHAR) AS story_id,
            CAST(l_linenumber AS VARCHAR) AS sentence_number, CAST(l_quantity AS VARCHAR) AS intensity,
            l_orderkey, l_linenumber, l_partkey, l_suppkey, event_day
            FROM ev WHERE l_linenumber <= 2""",
        "fb": _feed_b("lower(buyer_nation)", "lower(seller_nation)"),
        "fbp": _feed_b("lower(c_name)", "lower(s_name) || ' bank'"),
        "org": """SELECT 'ORG_' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 6, '0') AS org_id, n_name AS name, replace(n_name, '_', ' ') AS clean_name FROM nation""",
        "ali": """SELECT DISTINCT 'ORG_' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 6, '0') AS org_id, n_name || ' ' || c_mktsegment AS name
            FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'HOUSEHOLD'""",
        "da": f"""SELECT name_key, arg_max(org_id, rank) AS org_id FROM (
            SELECT {lookup('name')} AS name_key, org_id, '0' || org_id AS rank FROM org UNION ALL
            SELECT {lookup('name')}, org_id, '1' || org_id FROM ali) WHERE name_key <> '' GROUP BY 1""",
        "db": f"""SELECT name_key, max(org_id) AS org_id, max(name) AS canonical FROM (
            SELECT {light('name')} AS name_key, org_id, name FROM org UNION ALL SELECT {light('clean_name')}, org_id, name FROM org) GROUP BY 1""",
        "fam": f"""SELECT x.*, s.org_id AS subject_org_id, o.org_id AS object_org_id FROM (
            SELECT *, {from_padded('code')} AS relation_type, {lookup('source_name')} AS sk, {lookup('target_name')} AS ok FROM fa) x
            JOIN da s ON s.name_key = sk JOIN da o ON o.name_key = ok WHERE relation_type <> ''""",
        "seed": f"""SELECT {EDGE_KEY}, min_by(source_name, event_date || '~' || source_name || '~' || target_name) AS subject_name,
            min_by(target_name, event_date || '~' || source_name || '~' || target_name) AS object_name, count(*) AS event_count FROM fam GROUP BY ALL""",
        "fbm": f"""SELECT x.*, s.org_id AS subject_org_id, s.canonical AS subject_name, o.org_id AS object_org_id, o.canonical AS object_name,
            CASE WHEN sk = '' OR ok = '' THEN 'blank_name' WHEN s.org_id IS NULL OR o.org_id IS NULL THEN 'unmapped'
            WHEN s.org_id = o.org_id THEN 'self_loop' WHEN relation_type = '' THEN 'bad_relation' ELSE 'mapped' END AS reason FROM (
            SELECT substr(SQLDATE, 1, 4) || '-' || substr(SQLDATE, 5, 2) || '-' || substr(SQLDATE, 7, 2) AS day,
            substr(SQLDATE, 1, 4) || '-' || substr(SQLDATE, 5, 2) AS event_month, {light('Actor1Name')} AS sk, {light('Actor2Name')} AS ok,
            coalesce(nullif({from_compact('EventRootCode')}, ''), {from_compact('EventCode')}) AS relation_type FROM fb) x
            LEFT JOIN db s ON s.name_key = sk LEFT JOIN db o ON o.name_key = ok""",
        "eb": f"SELECT {EDGE_KEY}, min(subject_name) AS subject_name, min(object_name) AS object_name, count(*) AS n FROM fbm WHERE reason = 'mapped' GROUP BY ALL",
        "edges": f"""SELECT * FROM (SELECT {EDGE_ID} AS edge_id, {EDGE_KEY}, coalesce(s.subject_name, e.subject_name) AS subject_name,
            coalesce(s.object_name, e.object_name) AS object_name, coalesce(s.event_count, 0) + coalesce(n, 0) AS event_count,
            CASE WHEN s.event_count IS NULL THEN 'GDELT' WHEN n IS NULL THEN 'ICEWS' ELSE 'GDELT;ICEWS' END AS source_datasets,
            coalesce(s.event_count, 0) AS icews_event_count, coalesce(n, 0) AS gdelt_event_count,
            CASE WHEN s.event_count IS NULL THEN 0.3 WHEN n IS NULL THEN 0.6 ELSE 0.7 END::DOUBLE AS confidence, 'active' AS status
            FROM seed s FULL JOIN eb e USING ({EDGE_KEY})) WHERE icews_event_count > 0 OR gdelt_event_count >= 3""",
        "scored": f"""SELECT * REPLACE ({score} AS confidence) FROM edges""",
        "leveled": f"""SELECT *, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_level,
            concat_ws('；', CASE WHEN {in_a} THEN 'ICEWS支持' END, CASE WHEN {in_b} THEN 'GDELT支持' END, CASE WHEN {a} > 0 AND {b} > 0 THEN '跨源共同支持' END,
            CASE WHEN {events} <= 1 THEN '事件数量较少' END, CASE WHEN {weak_b} THEN 'GDELT单源低证据' END,
            '最终置信度=' || CAST(confidence AS VARCHAR)) AS confidence_reason, true AS is_derived_relation FROM scored""",
        "iv": """SELECT DISTINCT subject_org_id AS s, relation_type AS r, object_org_id AS o,
            CAST(substr(event_month, 1, 4) AS INTEGER) * 12 + CAST(substr(event_month, 6, 2) AS INTEGER) - 1 AS m1,
            CAST(substr(event_month, 1, 4) AS INTEGER) * 12 + CAST(substr(event_month, 6, 2) AS INTEGER) - 1 AS m2
            FROM scored WHERE subject_org_id <> object_org_id""",
        "isl": """SELECT s, r, o, min(m1) AS m1, max(m1) AS m2, count(*) AS months FROM (
            SELECT *, m1 - row_number() OVER (PARTITION BY s, r, o ORDER BY m1) AS island FROM iv) GROUP BY s, r, o, island""",
        "pairs": f"SELECT x.s, x.o, x.r AS relation_a, y.r AS relation_b, x.m1 AS a1, x.m2 AS a2, y.m1 AS b1, y.m2 AS b2, {time_relation('x.m1', 'x.m2', 'y.m1', 'y.m2')} AS kind FROM iv x JOIN iv y ON x.s = y.s AND x.o = y.o AND x.r < y.r",
        "pc": f"SELECT s AS subject_org_id, o AS object_org_id, relation_a, relation_b, {KIND_COUNTS}, count(*) AS comparable_count FROM pairs GROUP BY ALL",
        "tot": "SELECT r, count(*) AS k FROM iv GROUP BY r",
        "ps": f"""SELECT x.*, ta.k AS relation_a_total_interval_count, tb.k AS relation_b_total_interval_count,
            round({share('violation_like_overlap_count', 'comparable_count')}, 6) AS overlap_rate, round({share('non_overlap_count', 'comparable_count')}, 6) AS non_overlap_rate
            FROM (SELECT relation_a, relation_b, {whole('sum(comparable_count)')} AS comparable_count, {SUM_COUNTS},
            {whole('sum(before_count + after_count + meet_count)')} AS non_overlap_count,
            {whole('sum(overlap_count + during_count + contains_count + equal_count)')} AS violation_like_overlap_count FROM pc GROUP BY ALL) x
            JOIN tot ta ON ta.r = relation_a JOIN tot tb ON tb.r = relation_b""",
        "rules": rule_rows(),
        "inv": "SELECT relation_type, count(*) AS edge_count, any_value(k) AS interval_count FROM scored LEFT JOIN tot ON r = relation_type GROUP BY relation_type",
        "pool": f"""SELECT r.relation_a || '_' || r.relation_b || '_overlap' AS pair_id, r.*, 'overlap' AS forbidden_temporal_relation, 'same_subject_object' AS scope,
            {choose('r.relation_a', C.RELATION_LABELS)} AS relation_a_name_zh, {choose('r.relation_b', C.RELATION_LABELS)} AS relation_b_name_zh,
            ia.interval_count AS relation_a_total_interval_count, ib.interval_count AS relation_b_total_interval_count,
            {', '.join(f'coalesce(p.{c}, 0) AS {c}' for c in ('comparable_count', *(k + '_count' for k in KINDS), 'non_overlap_count', 'violation_like_overlap_count'))},
            coalesce(p.overlap_rate, 0.0::DOUBLE) AS overlap_rate, coalesce(p.non_overlap_rate, 0.0::DOUBLE) AS non_overlap_rate
            FROM rules r JOIN inv ia ON ia.relation_type = r.relation_a JOIN inv ib ON ib.relation_type = r.relation_b
            LEFT JOIN ps p ON p.relation_a = r.relation_a AND p.relation_b = r.relation_b
            WHERE candidate_level <> 'blocked' AND (coalesce(p.comparable_count, 0) >= 5
            OR (candidate_level = 'strong_candidate' AND least(ia.interval_count, ib.interval_count) >= 10) OR (candidate_level = 'weak_candidate' AND p.comparable_count > 0))""",
        "cand": "SELECT *, CASE WHEN relation_b = '17' THEN 'hide' ELSE recommended_action END AS proposed_action, 'LLM_MUTEX_' || lpad(CAST(row_number() OVER (ORDER BY pair_id) AS VARCHAR), 4, '0') AS constraint_id FROM pool",
        "ew": f"""SELECT *, CASE WHEN {a} > 0 AND {b} > 0 THEN 1.2 WHEN {a} > 0 THEN 1.0 WHEN {b} > 0 THEN 0.6 ELSE 0.75 END::DOUBLE AS w FROM scored""",
        "wt": "SELECT subject_org_id AS s, relation_type AS r, object_org_id AS o, avg(w) AS w FROM ew GROUP BY ALL",
        "judged": """SELECT c.constraint_id, p.*, CASE WHEN kind IN ('before', 'after', 'meet') THEN 1 ELSE -1 END AS truth,
            (coalesce(wa.w, 1) + coalesce(wb.w, 1)) / 2 AS pw FROM pairs p JOIN cand c ON c.relation_a = p.relation_a AND c.relation_b = p.relation_b
            LEFT JOIN wt wa ON wa.s = p.s AND wa.o = p.o AND wa.r = p.relation_a LEFT JOIN wt wb ON wb.s = p.s AND wb.o = p.o AND wb.r = p.relation_b""",
        "ent": "SELECT constraint_id, count(*) FILTER (WHERE bad) AS entity_negative_count, count(*) FILTER (WHERE NOT bad) AS entity_support_count FROM (SELECT constraint_id, s, o, bool_or(truth = -1) AS bad FROM judged GROUP BY ALL) GROUP BY ALL",
        "sc0": f"""SELECT constraint_id, count(*) AS comparable_count, {count_if('truth = 1')} AS support_count, {count_if('truth = -1')} AS negative_count,
            {share("count(*) FILTER (WHERE truth = 1)", 'count(*)')} AS conf, {share("count(*) FILTER (WHERE truth = -1)", 'count(*)')} AS viol,
            sum(pw) FILTER (WHERE truth = 1) / sum(pw) AS wconf, {KIND_COUNTS} FROM judged GROUP BY constraint_id""",
        "sc": f"""SELECT c.constraint_id, c.pair_id AS constraint_key, c.relation_a, c.relation_b, c.candidate_level, c.proposed_action,
            c.candidate_reason AS proposed_reason, c.forbidden_temporal_relation, s.* EXCLUDE (constraint_id), e.* EXCLUDE (constraint_id),
            CASE WHEN comparable >= 30 AND conf >= 0.85 AND wconf >= 0.85 AND viol <= 0.15 THEN 'pass'
            WHEN candidate_level = 'strong_candidate' AND comparable >= 500 AND conf >= 0.74 AND wconf >= 0.735 AND viol <= 0.26 THEN 'strong_soft'
            WHEN c.proposed_action = 'mark_mixed' AND comparable >= 500 AND conf >= 0.72 AND viol <= 0.29 THEN 'mixed_candidate'
            WHEN comparable >= 30 AND conf >= 0.70 THEN 'review' WHEN comparable >= 10 AND conf >= 0.60 THEN 'weak_review' ELSE 'weak' END AS auto_filter_status
            FROM cand c LEFT JOIN (SELECT *, comparable_count AS comparable FROM sc0) s USING (constraint_id) LEFT JOIN ent e USING (constraint_id)""",
        "auto": """SELECT *, CASE WHEN auto_filter_status = 'pass' THEN 'enabled_for_update' WHEN auto_filter_status IN ('strong_soft', 'mixed_candidate') THEN 'enabled_for_mark_mixed'
            WHEN auto_filter_status IN ('review', 'weak_review') THEN 'review_only' ELSE 'disabled' END AS auto_final_status FROM sc""",
        "fin0": "SELECT *, '' AS manual_final_status, '' AS manual_comment, auto_final_status AS final_status FROM auto",
        "fin": """SELECT *, coalesce(nullif(manual_final_status, ''), auto_final_status) AS final_status FROM (SELECT *,
            CASE WHEN relation_b IN ('16', '17') THEN 'enabled_for_update' WHEN relation_b = '18' THEN 'disabled' WHEN relation_b = '19' THEN 'review_only' ELSE '' END AS manual_final_status,
            'checked ' || relation_a AS manual_comment FROM auto)""",
        **update_ctes("fin", ""), **update_ctes("fin0", "0"),
        "base": """SELECT edge_id, subject_org_id, object_org_id, event_month, relation_type, event_count, confidence,
            icews_event_count > 0 AND gdelt_event_count > 0 AS cross_source FROM edges""",
        "ebase": """SELECT *, CASE WHEN cross_source OR confidence >= 0.7 THEN 'high' WHEN confidence < 0.5 THEN 'low' ELSE 'middle' END AS evidence_group FROM base""",
        "b_keep": "SELECT edge_id, 'keep' AS action, false AS triggered, evidence_group FROM ebase",
        "b_single": """SELECT edge_id, CASE WHEN several AND k > 1 THEN 'filtered' ELSE 'keep' END AS action, several AS triggered, evidence_group FROM (
            SELECT *, count(*) OVER g > 1 AS several, row_number() OVER (PARTITION BY subject_org_id, object_org_id, event_month ORDER BY confidence DESC, event_count DESC, edge_id) AS k
            FROM ebase WINDOW g AS (PARTITION BY subject_org_id, object_org_id, event_month))""",
        "met": """SELECT x.edge_id AS ia, y.edge_id AS ib, x.confidence AS ca, y.confidence AS cb FROM ebase x JOIN ebase y USING (subject_org_id, object_org_id, event_month)
            JOIN cand c ON c.relation_a = x.relation_type AND c.relation_b = y.relation_type""",
        "lost": "SELECT CASE WHEN ca > cb THEN ib WHEN cb > ca THEN ia ELSE greatest(ia, ib) END AS edge_id FROM met",
        "b_pairs": """SELECT edge_id, CASE WHEN edge_id IN (SELECT edge_id FROM lost) THEN 'filtered' ELSE 'keep' END AS action,
            edge_id IN (SELECT ia FROM met UNION SELECT ib FROM met) AS triggered, evidence_group FROM ebase""",
        "b_actual": "SELECT edge_id, update_action AS action, is_mutex_triggered AS triggered, evidence_group FROM ebase JOIN after0 USING (edge_id)",
        "methods": """SELECT 'keep_all' AS method, * FROM b_keep UNION ALL SELECT 'single_relation', * FROM b_single
            UNION ALL SELECT 'all_pairs', * FROM b_pairs UNION ALL SELECT 'constraint_update', * FROM b_actual""",
        "aft": f"""SELECT *, CASE WHEN (icews_event_count > 0 AND gdelt_event_count > 0) OR final_confidence >= 0.7 THEN 'high'
            WHEN final_confidence < 0.5 THEN 'low' ELSE 'middle' END AS evidence_group FROM after""",
        "links": f"""SELECT event_month AS month, edge_id, subject_org_id AS source, object_org_id AS target, subject_name AS source_name, object_name AS target_name,
            relation_type AS relation, {choose('relation_type', C.RELATION_LABELS)} AS relation_label, final_confidence AS confidence, original_confidence,
            after_check_status AS status, update_action, {choose('update_action', C.ACTION_LABELS)} AS update_action_label, source_datasets AS sources, is_mutex_triggered, triggered_constraint_ids, triggered_constraint_keys, triggered_mutex_relations FROM after""",
        "ends": "SELECT month, edge_id, source AS node, source_name AS name, 0 AS side FROM links UNION ALL SELECT month, edge_id, target, target_name, 1 FROM links",
        "gnode": """SELECT org_id, arg_max(name, edge_id || side) AS name FROM (SELECT edge_id, subject_org_id AS org_id, subject_name AS name, '0' AS side FROM scored
            UNION ALL SELECT edge_id, object_org_id, object_name, '1' FROM scored) GROUP BY org_id""",
        # ---- actors
        "hits": f"""SELECT name, NULL AS type_info, nullif(trim(upper(sector)), '') AS sector_info, 'ICEWS' AS source, seq FROM (
            SELECT source_name AS name, unnest(string_split(source_sectors, ',')) AS sector, '0' || strftime(event_day, '%Y%m%d') AS seq FROM fa UNION ALL
            SELECT target_name, unnest(string_split(target_sectors, ',')), '0' || strftime(event_day, '%Y%m%d') FROM fa) UNION ALL
            SELECT Actor1Name, {packed('Actor1')}, NULL, 'GDELT', '1' || SQLDATE FROM fbp UNION ALL SELECT Actor2Name, {packed('Actor2')}, NULL, 'GDELT', '1' || SQLDATE FROM fbp""",
        "act": f"""SELECT normalized_name, arg_min(trim(name), seq || name) AS raw_name, count(*) AS frequency, count(DISTINCT source) AS source_count,
            array_to_string(list_sort(list(DISTINCT source)), ';') AS sources,
            coalesce(array_to_string(list_sort(list(DISTINCT type_info) FILTER (WHERE type_info IS NOT NULL)), ';'), '') AS type_info,
            coalesce(array_to_string(list_sort(list(DISTINCT sector_info) FILTER (WHERE sector_info IS NOT NULL)), ';'), '') AS sector_info, count(*) AS org_signal,
            coalesce(bool_or(regexp_matches(type_info, '\\b({'|'.join(C.ORG_TYPE_CODES)})\\b')), false) AS typed,
            coalesce(bool_or(regexp_matches(sector_info, {alternation(C.ORG_SECTOR_KEYWORDS)})), false) AS sectored
            FROM (SELECT *, {light('name')} AS normalized_name FROM hits) WHERE normalized_name <> '' GROUP BY normalized_name""",
        "gate": f"SELECT *, NOT {bad_name('normalized_name')} AND frequency >= 2 AS candidate, {org_name('normalized_name')} AS named FROM act",
        "orgs": f"""SELECT 'ORG_' || lpad(CAST(row_number() OVER (ORDER BY frequency DESC, source_count DESC, normalized_name) AS VARCHAR), 6, '0') AS org_id, *,
            {choose('normalized_name', C.SMALL_ALIAS_MAP)} AS small_name FROM (
            SELECT *, candidate AND (named OR typed OR sectored) AS passed, row_number() OVER (PARTITION BY candidate AND (named OR typed OR sectored) ORDER BY frequency DESC, source_count DESC, normalized_name) AS k,
            count(*) FILTER (WHERE candidate AND (named OR typed OR sectored)) OVER () AS held FROM gate)
            WHERE passed OR (held > 0 AND frequency >= 2 AND k <= 1000 - held)""",
        "named": f"""SELECT *, {aligned('normalized_name')} AS clean_name FROM orgs WHERE {aligned('normalized_name')} <> '' AND {aligned('normalized_name')} NOT IN {words(C.GENERIC_ORG_NAMES)}
            AND {aligned('raw_name')} NOT IN {words(C.GENERIC_ORG_NAMES)}""",
        "kept": """SELECT *, 'ORG_' || lpad(CAST(row_number() OVER (ORDER BY old_org_id) AS VARCHAR), 6, '0') AS new_id FROM (
            SELECT clean_name, min(org_id) AS old_org_id FROM named GROUP BY clean_name)""",
        "alias_rows": f"""SELECT DISTINCT new_id AS org_id, old_org_id, alias, {aligned('alias')} AS alias_clean, 'exact_clean' AS match_type FROM (
            SELECT clean_name, normalized_name AS alias FROM named UNION SELECT clean_name, raw_name FROM named) JOIN kept USING (clean_name)
            WHERE alias <> '' AND {aligned('alias')} NOT IN {words(C.GENERIC_ORG_NAMES)}""",
        "raw_names": "SELECT source_name AS name FROM fa UNION SELECT target_name FROM fa UNION SELECT Actor1Name FROM fbp UNION SELECT Actor2Name FROM fbp",
    }


def _feed_b(buyer: str, seller: str) -> str:
    return f"""SELECT strftime(event_day, '%Y%m%d') AS SQLDATE, '  ' || {buyer} || ' ' AS Actor1Name,
        CASE WHEN l_returnflag = 'A' THEN 'IGO' ELSE '' END AS Actor1KnownGroupCode,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'GOV' WHEN '2-HIGH' THEN 'CVL' ELSE '' END AS Actor1Type1Code,
        CASE WHEN l_linestatus = 'O' THEN 'MIL' ELSE '' END AS Actor1Type2Code, '' AS Actor1Type3Code,
        CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE '  ' || {seller} END AS Actor2Name, '' AS Actor2KnownGroupCode,
        CASE WHEN l_returnflag = 'R' THEN 'BUS' ELSE '' END AS Actor2Type1Code, '' AS Actor2Type2Code, '' AS Actor2Type3Code,
        CASE WHEN l_linenumber = 7 THEN '210' ELSE CAST(code_number * 10 AS VARCHAR) END AS EventCode,
        CASE l_linenumber WHEN 6 THEN '' WHEN 7 THEN 'x' ELSE CAST(code_number AS VARCHAR) END AS EventRootCode,
        l_orderkey, l_linenumber, l_partkey, l_suppkey FROM ev WHERE l_linenumber > 2"""


def update_ctes(final: str, tag: str) -> dict[str, str]:
    """Conflict detection by pairing edges, and the outcome per edge, under one set of final constraints."""
    severity = choose("update_action", C.ACTION_SEVERITY, "0")
    action = """CASE WHEN final_status = 'enabled_for_mark_mixed' THEN 'mark_mixed' WHEN final_status = 'review_only' THEN 'review'
        WHEN cross_source THEN 'mark_mixed' WHEN proposed_action = 'hide' AND low_evidence THEN 'hide_low_evidence' WHEN proposed_action = 'downgrade' OR (proposed_action = 'mark_mixed_or_downgrade' AND low_evidence) THEN 'downgrade' ELSE 'mark_mixed' END"""
    side = "SELECT c.constraint_id, c.pair_id, {s} AS side, {e}.edge_id FROM scored x JOIN scored y USING (subject_org_id, object_org_id, event_month) JOIN cand c ON c.relation_a = x.relation_type AND c.relation_b = y.relation_type"
    return {
        f"sides{tag}": f"""SELECT *, {action} AS update_action FROM (SELECT e.*, e.icews_event_count > 0 AND e.gdelt_event_count > 0 AS cross_source,
            e.icews_event_count = 0 AS low_evidence, true AS derived, z.side, f.constraint_id, f.constraint_key, f.relation_a, f.relation_b, f.final_status, f.proposed_action,
            f.proposed_reason, f.auto_filter_status, f.candidate_level, round(f.conf, 6) AS structural_confidence, round(f.wconf, 6) AS source_weighted_confidence, round(f.viol, 6) AS violation_rate
            FROM ({side.format(s="'a'", e='x')} UNION {side.format(s="'b'", e='y')}) z JOIN {final} f USING (constraint_id) JOIN scored e ON e.edge_id = z.edge_id
            WHERE f.final_status IN ('enabled_for_update', 'enabled_for_mark_mixed', 'review_only'))""",
        f"conf{tag}": f"""SELECT constraint_id, constraint_key, subject_org_id, object_org_id, event_month AS month, relation_a, relation_b,
            string_agg(edge_id, ';' ORDER BY edge_id) FILTER (WHERE side = 'a') AS edge_ids_a, string_agg(edge_id, ';' ORDER BY edge_id) FILTER (WHERE side = 'b') AS edge_ids_b,
            final_status, arg_max(update_action, {severity}) AS conflict_action, proposed_action AS expected_action, structural_confidence, source_weighted_confidence, violation_rate,
            auto_filter_status, candidate_level FROM sides{tag} GROUP BY ALL""",
        # An action applies unless a more severe one came before, so applied downgrades all precede applied hides.
        f"ranked{tag}": f"""SELECT *, {severity} AS sev, row_number() OVER w AS step, max({severity}) OVER w AS worst
            FROM sides{tag} WINDOW w AS (PARTITION BY edge_id ORDER BY constraint_id)""",
        f"steps{tag}": f"""SELECT *, {count_if("update_action = 'downgrade' AND sev = worst")} OVER w AS downs, {count_if("update_action = 'hide_low_evidence'")} OVER w AS hides
            FROM ranked{tag} WINDOW w AS (PARTITION BY edge_id ORDER BY step)""",
        f"down{tag}": f"SELECT *, {_repeated('confidence', 'downs', 0.8)} AS lowered FROM steps{tag}",
        f"dec{tag}": f"SELECT *, {_repeated('lowered', 'hides', 0.5)} AS final_confidence FROM down{tag}",
        f"hist{tag}": f"""SELECT edge_id, arg_max(final_confidence, step) AS final_confidence, max(worst) AS worst, string_agg(constraint_id, ';' ORDER BY constraint_id) AS ids,
            string_agg(constraint_key, ';' ORDER BY constraint_id) AS keys, string_agg(relation_a || '-' || relation_b, ';' ORDER BY constraint_id) AS rels FROM dec{tag} GROUP BY edge_id""",
        f"after{tag}": f"""SELECT e.* EXCLUDE (status), h.edge_id IS NOT NULL AS is_mutex_triggered, CASE worst WHEN 1 THEN 'review' WHEN 2 THEN 'mark_mixed' WHEN 3 THEN 'downgrade' WHEN 4 THEN 'hide_low_evidence' ELSE 'keep' END AS update_action,
            CASE worst WHEN 1 THEN 'review' WHEN 2 THEN 'mark_mixed' WHEN 3 THEN 'downgraded' WHEN 4 THEN 'hidden' ELSE 'keep' END AS after_check_status, e.confidence AS original_confidence,
            coalesce(h.final_confidence, e.confidence) AS final_confidence, coalesce(ids, '') AS triggered_constraint_ids, coalesce(keys, '') AS triggered_constraint_keys,
            coalesce(rels, '') AS triggered_mutex_relations, CASE WHEN worst = 4 THEN 'hidden' ELSE 'active' END AS status, CASE worst WHEN 1 THEN 'review' WHEN 2 THEN 'mark_complex' WHEN 3 THEN 'downgrade' WHEN 4 THEN 'hide' ELSE 'keep' END AS check_action
            FROM scored e LEFT JOIN hist{tag} h ON h.edge_id = e.edge_id""",
    }


def _repeated(value: str, times: str, factor: float) -> str:
    """A value multiplied some times, rounded after each."""
    whens, product = f"WHEN 0 THEN {value}", value
    for n in range(1, 21):
        product = f"round({product} * {factor}::DOUBLE, 6)"
        whens += f" WHEN {n} THEN {product}"
    return f"CASE {times} {whens} END"


def with_ctes(body: str, fold: bool = True) -> str:
    """The body with all expressions it needs, in order, each computed once."""
    ctes = graph_ctes(fold)
    names = set(ctes)

    def used(sql: str) -> set[str]:
        return {w for w in re.findall(r"\b(?:FROM|JOIN)\s+\(*(\w+)", sql) if w in names} | {
            w for w in re.findall(r"\b(\w+)\b", sql) if w in names and re.search(rf"(FROM|JOIN)\s+{w}\b", sql)}

    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in sorted(used(sql)):
            if name not in needed:
                visit(ctes[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    head = ",\n".join(f"{n} AS MATERIALIZED ({ctes[n]})" for n in needed)
    return f"WITH {head}\n{body}" if needed else body


def label_of(column: str) -> str:
    return choose(column, C.RELATION_LABELS)


TEXT_ARROW = "subject_name || ' --' || relation_type || '--> ' || object_name || ' ' || event_month"


def _examples(order: str, expr: str) -> str:
    return f"(SELECT relation_type, string_agg({expr}, ' | ' ORDER BY k) AS t FROM (SELECT *, row_number() OVER (PARTITION BY relation_type ORDER BY {order}, subject_org_id, object_org_id, event_month) AS k FROM scored) WHERE k <= 5 GROUP BY relation_type)"


def _pair_examples(flag: str) -> str:
    t = f"s || ' --' || relation_a || '--> ' || o || ' [' || {month_label('a1')} || ',' || {month_label('a2')} || '] ' || kind || ' ' || s || ' --' || relation_b || '--> ' || o || ' [' || {month_label('b1')} || ',' || {month_label('b2')} || ']'"
    return f"(SELECT relation_a, relation_b, string_agg({t}, ' | ' ORDER BY k) AS t FROM (SELECT *, row_number() OVER (PARTITION BY relation_a, relation_b ORDER BY s, o, a1, a2, b1, b2) AS k FROM pairs WHERE kind {flag} ('overlap', 'during', 'contains', 'equal')) WHERE k <= 3 GROUP BY ALL)"


NUMBERED = "(SELECT s, r, o, m1, 'I_' || lpad(CAST(row_number() OVER (ORDER BY s, r, o, m1) AS VARCHAR), 9, '0') AS id FROM iv)"


def _instances(where: str) -> str:
    return f"""SELECT constraint_id, pair_id AS constraint_key, CAST(k AS INTEGER) AS instance, s AS subject_org_id, o AS object_org_id, j.relation_a, j.relation_b,
        {month_label('a1')} AS a_start_time, {month_label('a2')} AS a_end_time, {month_label('b1')} AS b_start_time, {month_label('b2')} AS b_end_time,
        kind AS interval_relation, truth, truth = -1 AS is_violation, round(pw, 6) AS pair_weight FROM (
        SELECT *, row_number() OVER (PARTITION BY constraint_id ORDER BY s, o, a1, a2, b1, b2) AS k FROM judged WHERE {where}) j JOIN cand USING (constraint_id) WHERE k <= 500"""


def _rates(rows) -> str:
    return " UNION ALL ".join(
        f"SELECT {text(n)} AS metric, {percent(a, b)} AS value, {whole(a)} AS numerator, {whole(b)} AS denominator FROM m" for n, a, b in rows)


def _proposals() -> str:
    n = "comparable_count % 7"
    return f"""SELECT relation_a || relation_b AS position, CASE WHEN {n} = 2 THEN least(relation_a, 'any') ELSE relation_a END AS relation_a,
        CASE WHEN {n} = 2 THEN 'any' ELSE relation_b END AS relation_b, {n} AS n FROM ps"""


def _verdict() -> str:
    return """CASE WHEN relation_b = 'any' THEN 'wildcard' WHEN pool.pair_id IS NULL THEN 'outside_pool' WHEN n = 3 THEN 'scope' WHEN n = 4 THEN 'forbidden_relation'
        WHEN n = 6 THEN 'meaningless_reason' WHEN n = 5 THEN 'hard_without_exception' ELSE 'kept' END"""


DEC_COLUMNS = "constraint_id, constraint_key, subject_org_id, object_org_id, event_month AS month, edge_id, relation_type, final_status, update_action, confidence AS original_confidence, final_confidence, structural_confidence, source_weighted_confidence, violation_rate, auto_filter_status, candidate_level"
LINK = "month, edge_id, source, target, relation, relation_label, confidence, update_action, update_action_label"
EGO = "(contains(lower(source), 'org_000003') OR contains(lower(target), 'org_000003'))"
TOUCHED = "SELECT month, node AS id, count(*) AS degree, arg_max(name, edge_id || '~' || name) AS name FROM {src} GROUP BY month, node"
SIZE = "CAST(greatest(14, least(46, 10 + 2 * degree)) AS BIGINT) AS size"


def _spellings() -> str:
    forms = ("'%Y-%m-%d'", "'%Y-%-m'", "'%Y%m%d'", "'%Y%m'", "'%Y/%m/%d'", "'%Y.%m.%d'", "'x%Y'", "'%Y%m%d.0'", "'%Y%m9'")
    return "SELECT spelling, y, m, f, count(*) AS events FROM (" + " UNION ALL ".join(
        f"SELECT strftime(l_shipdate, {form}) AS spelling, year(l_shipdate) AS y, month(l_shipdate) AS m, {i} AS f FROM lineitem" for i, form in enumerate(forms)
    ) + ") GROUP BY ALL"


def oracle_queries() -> dict[str, str]:
    full, folded = (lambda b: with_ctes(b, False)), with_ctes
    seed_columns = f"{EDGE_ID} AS edge_id, {EDGE_KEY}, subject_name, object_name, event_count, 'ICEWS' AS source_datasets, event_count AS icews_event_count, 0::BIGINT AS gdelt_event_count, 0.6::DOUBLE AS confidence, 'active' AS status"
    log = f"""SELECT d.day AS date, substr(d.day, 1, 7) AS event_month, processed AS processed_events, mapped AS mapped_events, processed - mapped AS skipped_unmapped,
        coalesce(fresh, 0) AS new_edges, mapped - coalesce(fresh, 0) AS updated_edges FROM (SELECT day, count(*) AS processed, {count_if("reason = 'mapped'")} AS mapped FROM fbm GROUP BY day) d
        LEFT JOIN (SELECT day, count(*) AS fresh FROM (SELECT {EDGE_KEY}, min(day) AS day FROM fbm WHERE reason = 'mapped' GROUP BY ALL) k
        WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE s.subject_org_id = k.subject_org_id AND s.object_org_id = k.object_org_id AND s.event_month = k.event_month AND s.relation_type = k.relation_type) GROUP BY day) n ON n.day = d.day"""
    facts = """SELECT 'ICEWS' AS source_dataset, subject_org_id, source_name AS subject_name, object_org_id, target_name AS object_name, code AS event_code, event_date, event_month,
        concat_ws(', ', nullif(city, ''), country) AS location, relation_type, intensity, publisher, story_id, sentence_number FROM fam"""
    reduced = "SELECT SQLDATE, EventRootCode, count(*) AS events, count(DISTINCT trim(Actor1Name)) AS actors FROM fbp WHERE {w} GROUP BY ALL"
    candidate = "raw_name, normalized_name, frequency, source_count, sources, type_info, sector_info, org_signal"
    org_columns = "frequency, source_count, sources, type_info, sector_info, org_signal"
    metric = f"""WITH_M SELECT count(*) AS total, {count_if("update_action = 'keep'")} AS kept, {count_if('is_mutex_triggered')} AS triggered, {count_if("update_action <> 'keep'")} AS changed,
        {count_if("evidence_group = 'high'")} AS high, {count_if("evidence_group = 'high' AND update_action NOT IN ('downgrade', 'hide_low_evidence')")} AS high_protected,
        {count_if("evidence_group = 'low' AND is_mutex_triggered")} AS low_triggered, {count_if("evidence_group = 'low' AND is_mutex_triggered AND update_action <> 'keep'")} AS low_processed FROM aft"""[7:]
    filtered = "action IN ('filtered', 'downgrade', 'hide_low_evidence')"
    method = f"""SELECT method, count(*) AS total_edges, {count_if('triggered')} AS triggered_edges, {count_if("action <> 'keep'")} AS changed_edges, {count_if("action = 'keep'")} AS kept_edges,
        {count_if(filtered)} AS filtered_edges, {count_if("action = 'review'")} AS review_edges, {count_if("action = 'mark_mixed'")} AS mark_mixed_edges, {count_if("evidence_group = 'high'")} AS high_evidence_edges,
        {count_if(f"evidence_group = 'high' AND {filtered}")} AS high_evidence_filtered, {count_if("evidence_group = 'low' AND triggered")} AS low_evidence_triggered,
        {count_if("evidence_group = 'low' AND triggered AND action <> 'keep'")} AS low_evidence_processed FROM methods GROUP BY method"""
    actions = ("keep", "review", "mark_mixed", "downgrade", "hide_low_evidence", "hide")
    fusion = f"""SELECT (SELECT count(*) FROM edges) AS edges_before_check, (SELECT count(*) FROM edges WHERE source_datasets = 'GDELT') AS gdelt_only_edges,
        (SELECT count(*) FROM edges WHERE source_datasets = 'ICEWS') AS icews_only_edges, (SELECT count(*) FROM edges WHERE source_datasets = 'GDELT;ICEWS') AS cross_source_edges,
        (SELECT count(*) FROM scored) AS edges_scored, count(*) AS edges_after_check, {count_if("status = 'hidden'")} AS hidden_edges, {count_if("status = 'active'")} AS active_edges,
        {count_if("check_action = 'mark_complex'")} AS mixed_relation_edges FROM after"""
    graph_query = """SELECT edge_id, e.subject_org_id AS source, e.object_org_id AS target, a.name AS subject, relation_type, b.name AS object, event_month AS month, event_count, confidence, status
        FROM scored e JOIN gnode a ON a.org_id = e.subject_org_id JOIN gnode b ON b.org_id = e.object_org_id WHERE {w} ORDER BY event_count DESC, confidence DESC, edge_id LIMIT {n}"""
    named_2 = "(contains(upper(a.name), 'NATION_2') OR contains(upper(b.name), 'NATION_2')) AND confidence >= 0.6"
    coded_a, coded_b = (f"relation_{s} || ' - ' || {label_of(f'relation_{s}')}" for s in "ab")
    flags = "final_status IN ('enabled_for_update', 'enabled_for_mark_mixed', 'review_only')"
    case = "SELECT * FROM (SELECT {name} AS case_name, subject_org_id, object_org_id, {month} AS month, constraint_id FROM {src} WHERE {w} ORDER BY subject_org_id, object_org_id, month, constraint_id{extra} LIMIT 100)"
    paren = r"\((.*?)\)"
    base_name = squeeze(r"regexp_replace(name, '\(.*?\)', ' ', 'g')")
    q = {
        "event_facts": full(facts),
        "source_evidence": full(f"SELECT source_dataset, publisher, story_id, sentence_number, '' AS source_url FROM ({facts})"),
        "name_dictionary": folded("SELECT 'a' AS feed, name_key, org_id FROM da UNION ALL SELECT 'b', name_key, org_id FROM db"),
        "gate_reasons": full("SELECT reason, count(*) AS events FROM fbm GROUP BY reason"),
        "seed_edges": full(f"SELECT {seed_columns} FROM seed"),
        "fused_edges": full("SELECT * FROM edges"),
        "scored_edges": full("SELECT * FROM leveled"),
        "daily_log": full(log),
        "first_seen": full(f"SELECT {EDGE_KEY}, min(day) AS first_day FROM fbm WHERE reason = 'mapped' GROUP BY ALL"),
        "edge_ids": full(f"SELECT {EDGE_KEY}, event_count, 'E_' || lpad(CAST(row_number() OVER (ORDER BY event_month, subject_org_id, object_org_id, relation_type) AS VARCHAR), 9, '0') AS edge_id FROM edges"),
        "date_windows": full("""SELECT 'a' AS feed, event_month AS month, count(*) AS events FROM fa WHERE event_date BETWEEN '1996-01-01' AND '1997-12-31' GROUP BY ALL UNION ALL
            SELECT 'b', substr(SQLDATE, 1, 4) || '-' || substr(SQLDATE, 5, 2), count(*) FROM fb WHERE CAST(SQLDATE AS INTEGER) BETWEEN 19960101 AND 19971231 GROUP BY ALL"""),
        "event_reduction": full(reduced.format(w=f"trim(Actor1Name) <> '' AND trim(Actor2Name) <> '' AND {reduction_signal('Actor1')} AND {reduction_signal('Actor2')}")),
        "event_reduction_any": full(reduced.format(w=f"(trim(Actor1Name) <> '' OR trim(Actor2Name) <> '') AND ({reduction_signal('Actor1')} OR {reduction_signal('Actor2')})")),
        "position_sample": full("SELECT SQLDATE, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY SQLDATE, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM fb) WHERE k % 20 = 1"),
        "actor_candidates": full(f"SELECT {candidate} FROM gate WHERE candidate"),
        "organizations": full(f"SELECT org_id, normalized_name AS canonical_name, raw_name, normalized_name, small_name AS clean_name, {org_columns}, org_id AS old_org_id FROM orgs"),
        "aligned_organizations": full(f"""SELECT new_id AS org_id, normalized_name AS canonical_name, raw_name, normalized_name, k.clean_name, {org_columns}, k.old_org_id FROM kept k JOIN named n ON n.org_id = k.old_org_id"""),
        "aliases": full("SELECT * FROM alias_rows"),
        "alignment_sample": full(f"""SELECT o.*, a.sample_aliases, '' AS manual_is_correct_alignment, '' AS manual_note FROM (
            SELECT new_id AS org_id, normalized_name AS canonical_name, raw_name, normalized_name, k.clean_name, {org_columns}, k.old_org_id FROM kept k JOIN named n ON n.org_id = k.old_org_id
            ORDER BY md5('42|' || new_id), new_id LIMIT 100) o LEFT JOIN (SELECT org_id, string_agg(alias, '; ' ORDER BY alias) AS sample_aliases FROM (
            SELECT org_id, alias, row_number() OVER (PARTITION BY org_id ORDER BY alias) AS k FROM (SELECT DISTINCT org_id, alias FROM alias_rows)) WHERE k <= 5 GROUP BY org_id) a USING (org_id)"""),
        "organization_scale": full("SELECT (SELECT count(*) FROM kept) AS organization_count, count(*) AS alias_count, count(DISTINCT org_id) AS organizations_with_alias_count FROM alias_rows"),
        "name_clean": full(rf"""SELECT name, {light('name')} AS light, {aligned('name')} AS aligned, {lookup('name')} AS lookup, {choose(light('name'), C.SMALL_ALIAS_MAP)} AS alias,
            array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(name, '{paren}', 1), lambda x: upper(trim(x))), lambda x: x <> ''))), ',') AS qualifiers,
            {base_name} AS base, array_to_string(list_sort(string_split({squeeze('name')}, ' ')), ' ') AS tokens FROM raw_names"""),
        "name_predicates": full(f"""SELECT name, {bad_name('n')} AS bad, {org_name('n')} AS org_name, regexp_matches(upper(name), {alternation(C.ORG_SECTOR_KEYWORDS)}) AS org_sector,
            {aligned('name')} IN {words(C.GENERIC_ORG_NAMES)} AS generic FROM (SELECT name, {light('name')} AS n FROM raw_names)"""),
        "fuzzy_merged": "SELECT printf('V%08d', c_custkey) AS old_org_id, printf('B%08d', c_custkey) AS survivor_id, round(200.0 * 28 / 57, 4)::DOUBLE AS ratio FROM customer WHERE c_custkey % 3 = 0",
        "feed_scan": """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 5 WHEN 1 THEN c_name || ' "q"' WHEN 2 THEN NULL ELSE c_name END AS name, c_mktsegment AS segment,
            CASE c_custkey % 5 WHEN 4 THEN NULL ELSE 'n' || CAST(c_custkey % 5 AS VARCHAR) END AS note FROM customer""",
        "code_top2": full(f"""SELECT code, root, count(*) AS events, {padded('code')} AS padded, {from_padded('code')} AS from_padded, {from_compact('code')} AS from_compact,
            coalesce(nullif({from_compact('root')}, ''), {from_compact('code')}) AS from_root, CASE WHEN length(root) = 1 AND root BETWEEN '0' AND '9' THEN '0' || root ELSE root END AS light,
            {strict('root')} AS strict, {group_of(strict('root'))} AS category FROM (SELECT code, '' AS root FROM fa UNION ALL SELECT EventCode, EventRootCode FROM fb) GROUP BY code, root"""),
        "month_parse": f"""WITH sp AS ({_spellings()}) SELECT spelling, CAST(sum(events) AS BIGINT) AS events, CASE WHEN any_value(f) = 6 THEN NULL ELSE CAST(any_value(y * 12 + m - 1) AS INTEGER) END AS month_number,
            CASE WHEN any_value(f) = 6 THEN spelling WHEN any_value(f) = 1 AND any_value(m) < 10 THEN spelling ELSE printf('%04d-%02d', any_value(y), any_value(m)) END AS month_prefix,
            CASE WHEN length(spelling) >= 6 THEN substr(spelling, 1, 4) || '-' || substr(spelling, 5, 2) ELSE '' END AS sql_month,
            CASE WHEN length(spelling) >= 8 THEN substr(spelling, 1, 4) || '-' || substr(spelling, 5, 2) || '-' || substr(spelling, 7, 2) ELSE '' END AS sql_day,
            CASE WHEN any_value(f) = 6 THEN NULL ELSE printf('%04d%02d01', any_value(y), any_value(m)) END AS first_day,
            CASE WHEN any_value(f) = 6 THEN NULL ELSE strftime(last_day(make_date(CAST(any_value(y) AS INTEGER), CAST(any_value(m) AS INTEGER), 1)), '%Y%m%d') END AS last_day FROM sp GROUP BY spelling""",
        "relation_labels": full(f"""SELECT relation_type, count(*) AS edges, {label_of('relation_type')} AS relation_label, {group_of('relation_type')} AS eval_group,
            relation_type <= '08' AS is_cooperation, relation_type = '01' AS is_broad FROM edges GROUP BY relation_type"""),
        "sql_functions": folded(f"""SELECT e.edge_id, {light('e.subject_name')} AS light, {lookup('e.subject_name')} AS lookup, {aligned_text('e.subject_name')} AS aligned, relation_type AS padded, relation_type AS compact,
            relation_type AS strict, e.confidence AS score, CASE WHEN icews_event_count > 0 AND gdelt_event_count > 0 THEN 1.2 WHEN icews_event_count > 0 THEN 1.0 ELSE 0.6 END::DOUBLE AS weight,
            kind AS relation_to_spring, CASE WHEN kind IN ('before', 'after', 'meet') THEN 1 ELSE -1 END AS truth
            FROM (SELECT *, CAST(substr(event_month, 6, 2) AS INTEGER) AS m, {time_relation('m', 'm', '2', '3')} AS kind FROM scored) e"""),
        "month_intervals": full("""SELECT s AS subject, r AS property, o AS object, strftime(make_date(m1 // 12, m1 % 12 + 1, 1), '%Y%m%d') AS start_time,
            strftime(last_day(make_date(m1 // 12, m1 % 12 + 1, 1)), '%Y%m%d') AS end_time, m1 AS start_no, m1 AS end_no FROM iv"""),
        "interval_ids": full("""SELECT s AS subject, r AS property, o AS object, strftime(make_date(m1 // 12, m1 % 12 + 1, 1), '%Y%m%d') AS start_time,
            'I_' || lpad(CAST(row_number() OVER (ORDER BY s, r, o, m1) AS VARCHAR), 9, '0') AS interval_id FROM iv"""),
        "instance_ids": folded(f"""SELECT constraint_id, x.id AS interval_a_id, y.id AS interval_b_id, truth FROM judged j
            JOIN {NUMBERED} x ON x.s = j.s AND x.o = j.o AND x.r = j.relation_a AND x.m1 = j.a1 JOIN {NUMBERED} y ON y.s = j.s AND y.o = j.o AND y.r = j.relation_b AND y.m1 = j.b1"""),
        "merged_intervals": full(f"SELECT s AS subject_org_id, r AS relation_type, o AS object_org_id, m1 AS start_no, m2 AS end_no, months, {month_label('m1')} AS start_month, {month_label('m2')} AS end_month FROM isl"),
        "quarantine_file": full("SELECT r AS relation_type, 'n/a' AS start_time, strftime(last_day(make_date(m1 // 12, m1 % 12 + 1, 1)), '%Y%m%d') AS end_time, count(*) AS rows FROM iv WHERE r = '03' GROUP BY ALL"),
        "interval_quarantine": full(f"""SELECT 'good' AS kind, CASE WHEN r = '04' THEN '1990-01' ELSE {month_label('m1')} END AS start_time, {month_label('m1')} AS end_time, count(*) AS rows FROM iv WHERE r <> '03' GROUP BY ALL
            UNION ALL SELECT 'bad', 'n/a', strftime(last_day(make_date(m1 // 12, m1 % 12 + 1, 1)), '%Y%m%d'), count(*) FROM iv WHERE r = '03' GROUP BY ALL"""),
        "interval_pairs": full("SELECT * FROM pc"),
        "merged_interval_pairs": folded(f"""SELECT relation_a, relation_b, count(*) AS comparable_count, {KIND_COUNTS} FROM (
            SELECT x.r AS relation_a, y.r AS relation_b, {time_relation('x.m1', 'x.m2', 'y.m1', 'y.m2')} AS kind FROM isl x JOIN isl y ON x.s = y.s AND x.o = y.o AND x.r < y.r) GROUP BY ALL"""),
        "pair_summary": full("SELECT * FROM ps"),
        "pair_examples": folded(f"""SELECT p.relation_a, p.relation_b, coalesce(x.t, '') AS top_overlap_examples, coalesce(y.t, '') AS top_non_overlap_examples FROM ps p
            LEFT JOIN {_pair_examples('IN')} x USING (relation_a, relation_b) LEFT JOIN {_pair_examples('NOT IN')} y USING (relation_a, relation_b)"""),
        "relation_inventory": folded(f"""SELECT relation_type, relation_type AS relation_code, {label_of('relation_type')} AS relation_name_zh, {choose('relation_type', C.RELATION_DESCRIPTIONS)} AS relation_description,
            edge_count, edge_count AS event_count, interval_count, x.t AS top_subject_object_examples, y.t AS high_confidence_examples FROM inv
            JOIN {_examples('event_count DESC, confidence DESC', TEXT_ARROW)} x USING (relation_type)
            JOIN {_examples('confidence DESC', TEXT_ARROW + " || ' confidence=' || CAST(confidence AS VARCHAR)")} y USING (relation_type)"""),
        "relation_examples": folded(f"""SELECT relation_type, CAST(k AS INTEGER) AS rank, subject_org_id, object_org_id, subject_name, object_name, event_month AS month, confidence, event_count, source_datasets AS sources,
            {TEXT_ARROW} AS example_text FROM (SELECT *, row_number() OVER (PARTITION BY relation_type ORDER BY confidence DESC, event_count DESC, subject_org_id, object_org_id, event_month) AS k FROM scored) WHERE k <= 5"""),
        "pair_rules": folded("SELECT r.*, coalesce(p.comparable_count, 0) AS comparable_count FROM rules r LEFT JOIN (SELECT relation_a, relation_b, comparable_count FROM ps) p USING (relation_a, relation_b)"),
        "candidate_pool": folded("SELECT * FROM pool"),
        "candidate_validation": folded(f"""SELECT v.response_id, position, x.relation_a, x.relation_b, CASE WHEN rules.relation_a IS NULL THEN 'review' ELSE recommended_action END AS expected_action,
            CASE WHEN v.response_id = 'r2' AND {_verdict()} = 'kept' THEN 'duplicate' ELSE {_verdict()} END AS verdict
            FROM ({_proposals()}) x CROSS JOIN (SELECT unnest(['r1', 'r2']) AS response_id) v
            LEFT JOIN (SELECT pair_id, relation_a, relation_b FROM pool) pool USING (relation_a, relation_b)
            LEFT JOIN (SELECT relation_a, relation_b, recommended_action FROM rules WHERE candidate_level <> 'blocked') rules USING (relation_a, relation_b)"""),
        "response_extraction": folded("""SELECT relation_a AS response_id, CAST(row_number() OVER (PARTITION BY relation_a ORDER BY relation_b) - 1 AS INTEGER) AS position,
            relation_a, relation_b, 'same_subject_object' AS scope FROM ps"""),
        "constraint_distributions": folded("""SELECT 'llm+patecon' AS value, count(*) AS count, 'source' AS field FROM fin UNION ALL SELECT 'soft', count(*), 'hard_or_soft' FROM fin
            UNION ALL SELECT CASE final_status WHEN 'enabled_for_update' THEN 'enabled' WHEN 'enabled_for_mark_mixed' THEN 'enabled_mark_complex' WHEN 'review_only' THEN 'review' ELSE final_status END,
            count(*), 'final_decision' FROM fin GROUP BY ALL"""),
        "accepted_candidates": folded(f"""SELECT 'LLM_MUTEX_' || lpad(CAST(row_number() OVER (ORDER BY position) AS VARCHAR), 4, '0') AS constraint_id, pool.pair_id AS constraint_key,
            {label_of('x.relation_a')} || '与' || {label_of('x.relation_b')} || '互斥候选' AS constraint_name, x.relation_a, x.relation_b, 'soft' AS hard_or_soft, recommended_action AS expected_action, candidate_level
            FROM ({_proposals()}) x JOIN pool ON pool.relation_a = x.relation_a AND pool.relation_b = x.relation_b WHERE n IN (0, 1)"""),
        "source_weights": folded("SELECT s AS subject_org_id, r AS relation_type, o AS object_org_id, round(w, 6) AS source_weight FROM wt"),
        "constraint_scores": folded(f"""SELECT constraint_id, constraint_key, relation_a, relation_b, forbidden_temporal_relation, comparable_count, support_count AS non_overlap_count, negative_count AS violation_count,
            support_count, negative_count, 0::BIGINT AS unknown_count, comparable_count AS instantiation_count, round(conf, 6) AS structural_confidence, round(wconf, 6) AS source_weighted_confidence,
            round(viol, 6) AS violation_rate, entity_support_count, entity_negative_count, 0::BIGINT AS entity_unknown_count, entity_support_count + entity_negative_count AS entity_instantiation_count,
            round({share('entity_support_count', '(entity_support_count + entity_negative_count)')}, 6) AS entity_level_confidence,
            round({share('entity_negative_count', '(entity_support_count + entity_negative_count)')}, 6) AS entity_violation_rate, {LIST_COUNTS}, candidate_level, proposed_action, auto_filter_status FROM sc"""),
        "entity_scores": folded(f"""SELECT constraint_id, entity_support_count, entity_negative_count, 0::BIGINT AS entity_unknown_count, entity_support_count + entity_negative_count AS entity_instantiation_count,
            round({share('entity_support_count', '(entity_support_count + entity_negative_count)')}, 6) AS entity_level_confidence,
            round({share('entity_negative_count', '(entity_support_count + entity_negative_count)')}, 6) AS entity_violation_rate FROM ent"""),
        "trigger_instances": folded(_instances("true")),
        "violation_instances": folded(_instances("truth = -1")),
        "all_instances": folded(f"""SELECT constraint_id, pair_id AS constraint_key, s AS subject_org_id, o AS object_org_id, j.relation_a, j.relation_b,
            {month_label('a1')} AS a_start_time, {month_label('a2')} AS a_end_time, {month_label('b1')} AS b_start_time, {month_label('b2')} AS b_end_time,
            kind AS interval_relation, truth, truth = -1 AS is_violation, round(pw, 6) AS pair_weight FROM judged j JOIN cand USING (constraint_id)"""),
        "final_constraints": folded(f"""SELECT constraint_id, constraint_key, auto_filter_status, auto_final_status, manual_final_status, manual_comment, final_status, {flags} AS is_enabled,
            final_status IN ('enabled_for_update', 'enabled_for_mark_mixed') AS use_for_update, {flags} AS use_for_review FROM fin"""),
        "edge_actions": folded("SELECT edge_id, constraint_id, side, cross_source, low_evidence, derived, final_status, update_action FROM sides"),
        "conflicts": folded("SELECT * FROM conf"),
        "decisions": folded(f"SELECT {DEC_COLUMNS} FROM dec"),
        "edge_updates": folded(f"""SELECT edge_id, is_mutex_triggered, update_action, after_check_status, original_confidence, final_confidence, triggered_constraint_ids, triggered_constraint_keys,
            triggered_mutex_relations, status, check_action, {choose('update_action', C.ACTION_LABELS)} AS update_action_label, {label_of('relation_type')} AS relation_type_label FROM after"""),
        **{f"baseline_{n}": folded(f"SELECT * FROM b_{b}") for n, b in (("keep", "keep"), ("single_relation", "single"), ("all_pairs", "pairs"), ("actual", "actual"))},
        "relation_variety": folded("SELECT subject_org_id, object_org_id, event_month, count(DISTINCT relation_type) AS relations FROM edges GROUP BY ALL"),
        "method_metrics": folded(f"""SELECT *, {percent('triggered_edges', 'total_edges')} AS triggered_coverage, {percent('changed_edges', 'total_edges')} AS changed_share,
            {percent('kept_edges', 'total_edges')} AS impact_control_rate, {percent('(high_evidence_edges - high_evidence_filtered)', 'high_evidence_edges')} AS high_evidence_protection_rate,
            {percent('low_evidence_processed', 'low_evidence_triggered')} AS low_evidence_handling_rate, '100.00%' AS source_evidence_retention FROM ({method})"""),
        "method_actions": folded(f"SELECT method, action, k AS count, {percent('k', 'sum(k) OVER (PARTITION BY method)')} AS share FROM (SELECT method, action, count(*) AS k FROM methods GROUP BY ALL)"),
        "method_evidence": folded(f"SELECT method, evidence_group, action, k AS count, {percent('k', 'sum(k) OVER (PARTITION BY method, evidence_group)')} AS share FROM (SELECT method, evidence_group, action, count(*) AS k FROM methods GROUP BY ALL)"),
        "effectiveness": folded(f"""SELECT r.* FROM (SELECT * FROM ({metric})) m, LATERAL (SELECT 1) z(one), LATERAL (SELECT unnest([
            {', '.join(f"{{'metric': {text(n)}, 'value': {percent('m.' + a, 'm.' + b)}, 'numerator': {whole('m.' + a)}, 'denominator': {whole('m.' + b)}}}" for n, a, b in (
                ('high_evidence_protection_rate', 'high_protected', 'high'), ('low_evidence_handling_rate', 'low_processed', 'low_triggered'), ('update_impact_control_rate', 'kept', 'total'),
                ('triggered_conflict_coverage', 'triggered', 'total'), ('changed_edge_share', 'changed', 'total'), ('source_evidence_retention', 'total', 'total')))}]) AS row) u, LATERAL (SELECT u.row.metric AS metric, u.row.value AS value, u.row.numerator AS numerator, u.row.denominator AS denominator) r
            UNION ALL SELECT 'triggered_conflict_records', CAST(count(*) AS VARCHAR), count(*), NULL FROM conf"""),
        "evidence_pivot": folded(f"""SELECT *, {', '.join(f"{percent(a, 'total')} AS {a}_share" for a in actions)} FROM (
            SELECT evidence_group, {', '.join(f"{count_if(f'update_action = {text(a)}')} AS {a}" for a in actions)}, count(*) AS total FROM aft GROUP BY evidence_group)"""),
        "constraint_metrics": folded(f"""SELECT 'weak_constraint_share' AS metric, {percent("count(*) FILTER (WHERE auto_filter_status IN ('weak', 'weak_review', 'review'))", 'count(*)')} AS value,
            {count_if("auto_filter_status IN ('weak', 'weak_review', 'review')")} AS numerator, count(*) AS denominator FROM fin0 UNION ALL
            SELECT 'selected_constraint_share', {percent("count(*) FILTER (WHERE final_status IN ('enabled_for_update', 'enabled_for_mark_mixed'))", 'count(*)')}, {count_if("final_status IN ('enabled_for_update', 'enabled_for_mark_mixed')")}, count(*) FROM fin0
            UNION ALL SELECT 'mean_weighted_confidence', printf('%.4f', round(avg(round(wconf, 6)), 4)), NULL, NULL FROM fin0 UNION ALL SELECT 'mean_structural_confidence', printf('%.4f', round(avg(round(conf, 6)), 4)), NULL, NULL FROM fin0
            UNION ALL SELECT 'mean_violation_rate', printf('%.4f', round(avg(round(viol, 6)), 4)), NULL, NULL FROM fin0"""),
        "status_shares": folded(f"SELECT auto_filter_status, k AS count, round({share('k', 'sum(k) OVER ()')}, 6) AS share FROM (SELECT auto_filter_status, count(*) AS k FROM fin0 GROUP BY ALL)"),
        "constraint_summary": folded(f"SELECT count(*) AS final_constraints, {count_if(flags)} AS enabled_constraints FROM fin"),
        "constraint_quality": folded(f"""SELECT f.constraint_id, f.constraint_key, f.relation_a || '_' || f.relation_b AS relation_pair, {label_of('f.relation_a')} || ' - ' || {label_of('f.relation_b')} AS relation_meaning,
            f.comparable_count, support_count, negative_count AS violation_count, round(round(conf, 6), 4) AS structural_confidence, round(round(viol, 6), 4) AS violation_rate,
            round(round(wconf, 6), 4) AS source_weighted_confidence, f.auto_filter_status, f.final_status, f.final_status IN ('enabled_for_update', 'enabled_for_mark_mixed') AS use_for_update,
            coalesce(c.k, p.k, 0) AS conflict_count, coalesce(t, 0) AS triggered_edges, coalesce(rv, 0) AS review_edges, coalesce(mx, 0) AS mark_mixed_edges FROM fin f
            LEFT JOIN (SELECT constraint_id, count(*) AS k FROM conf GROUP BY ALL) c USING (constraint_id) LEFT JOIN (SELECT relation_a, relation_b, count(*) AS k FROM conf GROUP BY ALL) p USING (relation_a, relation_b)
            LEFT JOIN (SELECT constraint_id, count(*) AS t, {count_if("a.update_action = 'review'")} AS rv, {count_if("a.update_action = 'mark_mixed'")} AS mx FROM sides s JOIN after a USING (edge_id) GROUP BY ALL) e USING (constraint_id)"""),
        "fusion_summary": folded(f"UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM ({fusion})) ON COLUMNS(*) INTO NAME metric VALUE value"),
        "review_sample": full("SELECT edge_id, confidence, '' AS manual_is_reasonable, '' AS manual_note FROM leveled ORDER BY md5('42|' || edge_id), edge_id LIMIT 100"),
        "hidden_sample": folded("""SELECT edge_id, status, check_action, '' AS manual_is_reasonable, '' AS manual_note FROM (
            SELECT *, bool_or(status IN ('hidden', 'removed')) OVER () AS named FROM after) WHERE CASE WHEN named THEN status IN ('hidden', 'removed') ELSE check_action IN ('hide', 'remove') END
            ORDER BY md5('42|' || edge_id), edge_id LIMIT 100"""),
        "conflict_summary": folded(f"""SELECT count(*) AS detected_conflicts, {count_if("conflict_action = 'hide_low_evidence'")} AS hidden_conflicts, {count_if("conflict_action = 'downgrade'")} AS downgrade_conflicts,
            {count_if("conflict_action = 'mark_mixed'")} AS mark_mixed_conflicts, {count_if("conflict_action = 'review'")} AS review_conflicts FROM conf"""),
        "case_cross_source": full("SELECT edge_id, confidence, event_count FROM scored WHERE source_datasets = 'GDELT;ICEWS' ORDER BY confidence DESC, edge_id LIMIT 30"),
        "case_single_source": folded("SELECT edge_id, status, event_count FROM after WHERE source_datasets = 'GDELT' AND status = 'hidden' ORDER BY event_count, edge_id LIMIT 30"),
        "case_filtered_constraints": folded("SELECT constraint_id, final_status AS final_decision FROM fin WHERE final_status = 'disabled' ORDER BY constraint_id LIMIT 30"),
        "case_complex": folded("SELECT edge_id, check_action FROM after WHERE check_action = 'mark_complex' ORDER BY edge_id LIMIT 30"),
        "case_conflicts": folded(" UNION ALL ".join((
            case.format(name="'case_mutex_mark_mixed'", month="month", src="conf", w="conflict_action = 'mark_mixed'", extra=""),
            case.format(name="'case_mutex_hide_low_evidence'", month="month", src="conf", w="conflict_action = 'hide_low_evidence'", extra=""),
            case.format(name="'case_mutex_review'", month="month", src="conf", w="conflict_action = 'review'", extra=""),
            case.format(name="'case_mutex_downgrade'", month="event_month", src="dec", w="update_action = 'downgrade'", extra=", edge_id"),
            case.format(name="'case_mutex_keep_cross_source'", month="event_month", src="dec", w="update_action = 'mark_mixed'", extra=", edge_id")))),
        "month_links": folded(f"SELECT {LINK}, source_name, target_name, original_confidence, status, sources, is_mutex_triggered FROM links"),
        "month_topn": folded(f"SELECT {LINK} FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY confidence DESC, edge_id) AS k FROM links) WHERE k <= 50"),
        "node_degree": folded("SELECT node, count(*) AS degree FROM ends GROUP BY node"),
        "month_nodes": folded(f"SELECT *, {SIZE} FROM ({TOUCHED.format(src='ends')})"),
        "display_names": folded("""SELECT edge_id, a.name AS source_name, b.name AS target_name FROM links JOIN (SELECT node, arg_max(name, side || edge_id) AS name FROM ends GROUP BY node) a ON a.node = source
            JOIN (SELECT node, arg_max(name, side || edge_id) AS name FROM ends GROUP BY node) b ON b.node = target"""),
        "edge_search": folded(f"""SELECT {LINK} FROM links WHERE relation IN ('06', '07', '16', '17') AND update_action IN ('mark_mixed', 'review') AND confidence >= 0.6 AND is_mutex_triggered AND sources = 'GDELT;ICEWS'
            AND contains(lower(concat_ws(' ', source_name, target_name, source, target)), 'nation_1')"""),
        "ego_edges": folded(f"SELECT month, source_name, source AS source_org_id, relation AS relation_code, relation_label, target_name, target AS target_org_id, confidence, update_action FROM links WHERE {EGO} AND confidence >= 0.5"),
        "ego_metrics": folded(f"""SELECT count(*) AS edges, count(DISTINCT month) AS months, count(DISTINCT relation) AS relation_types,
            (SELECT count(DISTINCT node) FROM (SELECT source AS node FROM links WHERE {EGO} UNION SELECT target FROM links WHERE {EGO})) AS related_nodes FROM links WHERE {EGO}"""),
        "ego_network": folded(f"""SELECT *, contains(lower(name), 'org_000003') OR contains(lower(id), 'org_000003') AS is_center, CASE WHEN contains(lower(name), 'org_000003') OR contains(lower(id), 'org_000003') THEN 42 ELSE 24 END::BIGINT AS size
            FROM (SELECT month, node AS id, count(*) AS degree, arg_max(name, edge_id || '~' || name) AS name FROM ends JOIN (
            SELECT edge_id AS top_id FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY confidence DESC, edge_id) AS k FROM links WHERE {EGO}) WHERE k <= 30) ON top_id = edge_id GROUP BY month, node)"""),
        "month_view": folded(f"""SELECT n.*, {SIZE} FROM ({TOUCHED.format(src='ends')}) n JOIN (SELECT DISTINCT month, node FROM ends JOIN (
            SELECT edge_id AS top_id FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY confidence DESC, edge_id) AS k FROM links WHERE update_action = 'review') WHERE k <= 40) ON top_id = edge_id) t ON t.month = n.month AND t.node = n.id"""),
        "timeline": folded("""WITH_T SELECT t.month, count(DISTINCT e.node) AS nodes, any_value(t.k) AS links, any_value(n.node) AS top_node, any_value(t.top) AS top_link FROM (
            SELECT month, count(*) AS k, arg_min(edge_id, k0) AS top FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY confidence DESC, edge_id) AS k0 FROM links) WHERE k0 <= 100 GROUP BY month) t
            JOIN (SELECT * FROM ends JOIN (SELECT edge_id AS top_id FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY confidence DESC, edge_id) AS k0 FROM links) WHERE k0 <= 100) ON top_id = edge_id) e ON e.month = t.month
            JOIN (SELECT month, node FROM (SELECT month, node, row_number() OVER (PARTITION BY month ORDER BY count(*) DESC, node) AS p FROM (SELECT * FROM ends JOIN (
            SELECT edge_id AS top_id FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY confidence DESC, edge_id) AS k0 FROM links) WHERE k0 <= 100) ON top_id = edge_id) GROUP BY month, node) WHERE p = 1) n ON n.month = t.month GROUP BY t.month"""[7:]),
        "appended_edges": folded("SELECT * FROM edges"),
        "upserted_edges": folded("""SELECT edge_id, subject_name, object_name, CASE WHEN edge_id LIKE '%|03' THEN event_count + 1000 ELSE event_count END AS event_count, confidence,
            CASE WHEN edge_id LIKE '%|03' THEN 2 ELSE 1 END AS seq FROM edges"""),
        "interval_files": folded(f"""SELECT s AS subject_org_id, r AS relation_type, o AS object_org_id, m1 AS start_no, m1 AS end_no, {month_label('m1')} AS start_time, {month_label('m1')} AS end_time FROM iv"""),
        "timeline_files": folded("""SELECT month, edge_id, source_name, target_name, relation AS relation_code, confidence, status FROM (
            SELECT *, row_number() OVER (PARTITION BY month ORDER BY confidence DESC, edge_id) AS k FROM links) WHERE k <= 100"""),
        "timeline_nodes": folded(f"SELECT month, id, name, id AS org_id, '组织机构' AS category, size AS symbolSize, degree AS value FROM (SELECT *, {SIZE} FROM ({TOUCHED.format(src='ends')}))"),
        "timeline_links": folded("""SELECT *, source AS source_org_id, target AS target_org_id, relation AS relation_code, relation_label AS edge_label, status AS status_label FROM links"""),
        "graph_nodes": folded("SELECT * FROM gnode"),
        "graph_edges": folded("SELECT edge_id, event_count, confidence FROM scored"),
        "graph_query": folded(graph_query.format(w=f"{named_2} AND relation_type IN ('03', '06', '12') AND status = 'active'", n=300)),
        "graph_query_nodes": folded(f"SELECT DISTINCT id, name FROM (SELECT source AS id, subject AS name FROM ({graph_query.format(w=named_2, n=300)}) UNION ALL SELECT target, object FROM ({graph_query.format(w=named_2, n=300)}))"),
        "edge_table": folded(f"SELECT edge_id, subject, relation_type, object, month, event_count, confidence, status, '' AS start_date, '' AS end_date FROM ({graph_query.format(w='true', n=200)})"),
        "graph_totals": folded("SELECT (SELECT count(*) FROM gnode) AS org_count, (SELECT count(*) FROM scored) AS relation_count"),
        "option_lists": folded("SELECT DISTINCT relation_type AS value, 'relation' AS list FROM scored UNION ALL SELECT DISTINCT confidence_level, 'level' FROM leveled"),
        "overview": folded(f"""SELECT 'size' AS section, 'edges' AS key, count(*) AS count FROM after UNION ALL SELECT 'size', 'constraints', count(*) FROM fin UNION ALL SELECT 'size', 'conflicts', count(*) FROM conf
            UNION ALL SELECT 'size', 'decisions', count(*) FROM dec UNION ALL SELECT 'action', {choose('update_action', C.ACTION_LABELS)}, count(*) FROM after GROUP BY ALL
            UNION ALL SELECT 'final_status', final_status, count(*) FROM fin GROUP BY ALL UNION ALL SELECT 'month', month, count(*) FROM conf GROUP BY ALL"""),
        "constraint_list": folded(f"SELECT constraint_id, {coded_a} AS relation_a_label, {coded_b} AS relation_b_label, final_status, round(conf, 6) AS structural_confidence FROM fin WHERE final_status IN ('enabled_for_update', 'review_only') AND conf >= 0.7"),
        "conflict_list": folded(f"SELECT month, subject_org_id, object_org_id, {coded_a} AS relation_a_label, {coded_b} AS relation_b_label, constraint_id FROM conf WHERE month IN ('1996-01', '1996-02') AND conflict_action = 'review'"),
        "stream_fuse": full("SELECT * FROM edges"),
        "stream_log": full(log),
        "stream_new_keys": full(f"SELECT k.* FROM (SELECT {EDGE_KEY}, min(day) AS first_day, count(*) AS events FROM fbm WHERE reason = 'mapped' GROUP BY ALL) k ANTI JOIN seed USING ({EDGE_KEY})"),
    }
    return q
