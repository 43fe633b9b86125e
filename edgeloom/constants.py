"""Names, codes, labels and thresholds that results depend on.

Everything here is data, not logic. The word lists, label tables and numeric
thresholds below are fixed values: results only agree when they are kept as
they are.
"""

from __future__ import annotations

# ---- fixed values: feeds --------------------------------------------------
FEED_A = "ICEWS"
FEED_B = "GDELT"

# ---- fixed values: text read as null --------------------------------------
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

TRUE_TOKENS = ("1", "true", "yes", "y", "是", "触发")
FALSE_TOKENS = ("false", "0", "no", "n", "raw", "original")

# ---- fixed values: actor extraction word lists ----------------------------
ORG_TYPE_CODES = (
    "GOV", "MIL", "COP", "SPY", "JUD", "LEG",
    "PTY", "NGO", "IGO", "BUS", "MNC",
    "MED", "EDU", "REL", "LAB", "CRM",
)

ORG_SECTOR_KEYWORDS = (
    "GOVERNMENT", "MINISTRY", "CABINET", "EXECUTIVE", "LEGISLATIVE",
    "PARLIAMENTARY", "PARTIES", "PARTY",
    "INTERNATIONAL GOVERNMENT ORGANIZATION", "GLOBAL DIPLOMATIC IGOS",
    "JUDICIAL", "JUSTICE", "BUSINESS", "MEDIA", "EDUCATION", "UNIVERSITY",
    "MILITARY", "DEFENSE", "SECURITY", "POLICE",
)

ORG_NAME_KEYWORDS = (
    "UNITED NATIONS", "NATO", "EU", "WORLD BANK", "IMF", "WHO", "MINISTRY",
    "DEPARTMENT", "GOVERNMENT", "PARLIAMENT", "COURT", "COMMISSION",
    "COMMITTEE", "COUNCIL", "PARTY", "ARMY", "POLICE", "FORCE", "FORCES",
    "BANK", "COMPANY", "CORPORATION", "GROUP", "UNIVERSITY", "AGENCY",
    "ORGANIZATION", "ORGANISATION", "ASSOCIATION", "INSTITUTE",
)

BAD_NAMES = (
    "", "NAN", "NONE", "NULL", "UNKNOWN", "PEOPLE", "CITIZENS", "CIVILIANS",
    "RESIDENTS", "MEN", "WOMEN", "CHILDREN", "STUDENTS", "WORKERS", "FARMERS",
    "PROTESTERS", "DEMONSTRATORS", "REFUGEES", "MIGRANTS",
)

GENERIC_EXACT_NAMES = (
    # government and politics
    "GOVERNMENT", "GOVERNMENTS", "STATE", "STATES", "AUTHORITIES",
    "AUTHORITY", "OFFICIAL", "OFFICIALS", "MINISTER", "MINISTERS",
    "PRESIDENT", "PRIME MINISTER", "LEADER", "LEADERS", "KING", "QUEEN",
    "ROYAL",
    # military and security
    "MILITARY", "ARMY", "NAVY", "AIR FORCE", "FORCES", "TROOPS", "POLICE",
    "SECURITY", "INTELLIGENCE", "SOLDIERS",
    # media
    "MEDIA", "PRESS", "JOURNALIST", "JOURNALISTS", "NEWSPAPER", "REPORTER",
    "REPORTERS",
    # business
    "BUSINESS", "BUSINESSES", "COMPANY", "COMPANIES", "CORPORATION",
    "CORPORATIONS", "BANK", "BANKS", "MARKET", "MARKETS",
    # political and social groups
    "OPPOSITION", "PARTY", "PARTIES", "REBEL", "REBELS", "SEPARATIST",
    "SEPARATISTS", "ACTIVIST", "ACTIVISTS", "MILITANT", "MILITANTS",
    # law, education, religion
    "COURT", "COURTS", "JUDGE", "JUDGES", "LAWYER", "LAWYERS", "LEGAL",
    "SCHOOL", "SCHOOLS", "UNIVERSITY", "UNIVERSITIES", "RELIGIOUS", "CHURCH",
    "CHURCHES",
)

GENERIC_CODE_NAMES = (
    "GOV", "MIL", "COP", "SPY", "JUD", "LEG",
    "PTY", "NGO", "IGO", "BUS", "MNC",
    "MED", "EDU", "REL", "LAB", "CRM",
    "OPP", "CVL", "ELI", "HLH", "AGR",
    "DEV", "REF", "INS",
)

SMALL_ALIAS_MAP = {
    "UNITED STATES": "US",
    "UNITED STATES OF AMERICA": "US",
    "UNITED KINGDOM": "UNITED KINGDOM",
    "UNITED NATIONS": "UNITED NATIONS",
}

MIN_ACTOR_FREQUENCY = 2
TARGET_ORGANIZATIONS = 1000
MAX_NAME_WORDS = 12

# ---- fixed values: alignment word lists -----------------------------------
ABBREVIATION_MAP = {
    "UNITED NATIONS": "UN",
    "U N": "UN",
    "U NATIONS": "UN",
    "EUROPEAN UNION": "EU",
    "NORTH ATLANTIC TREATY ORGANIZATION": "NATO",
    "WORLD HEALTH ORGANIZATION": "WHO",
    "WORLD TRADE ORGANIZATION": "WTO",
    "INTERNATIONAL MONETARY FUND": "IMF",
    "UNITED STATES": "US",
    "UNITED STATES OF AMERICA": "US",
    "U S": "US",
    "USA": "US",
    "PEOPLES REPUBLIC OF CHINA": "CHINA",
    "PEOPLE S REPUBLIC OF CHINA": "CHINA",
    "PRC": "CHINA",
    "RUSSIAN FEDERATION": "RUSSIA",
    "UKRAINE GOVERNMENT": "UKRAINE",
}

GENERIC_ORG_NAMES = (
    "COLLEGE", "UNIVERSITY", "SCHOOL", "ACADEMY", "FACULTY", "CAMPUS",
    "CORPORATION", "COMPANY", "INDUSTRY", "BUSINESS", "BANK", "FIRM",
    "ENTERPRISE", "MEDIA", "JOURNALISTS", "JOURNALIST", "CITIZENS", "CITIZEN",
    "CIVILIANS", "CIVILIAN", "PEOPLE", "PUBLIC", "STUDENTS", "STUDENT",
    "GOVERNMENT", "MILITARY", "POLICE", "ARMY", "NAVY", "AIR FORCE",
    "PARLIAMENT", "CONGRESS", "SENATE", "COURT", "JUDICIARY", "MINISTRY",
    "CABINET", "OPPOSITION", "REBELS", "REBEL", "PROTESTERS", "PROTESTER",
    "PARTY", "NGO",
)

FUZZY_MIN_RATIO = 97
FUZZY_MIN_LENGTH = 8

ORGANIZATION_COLUMNS = (
    "org_id", "canonical_name", "raw_name", "normalized_name", "clean_name",
    "frequency", "source_count", "sources", "type_info", "sector_info",
    "known_group_info", "org_signal", "all_raw_names", "old_org_id",
)

# ---- fixed values: event reduction ----------------------------------------
REDUCTION_TYPE_CODES = (
    "GOV", "MIL", "COP", "BUS", "MNC", "NGO", "IGO", "IMG", "INT", "MED",
    "EDU", "ELI", "PTY", "OPP", "REB", "SEP", "SPY", "JUD", "LEG", "CRM",
)

REDUCTION_NAME_HINTS = (
    "GOVERNMENT", "MINISTRY", "DEPARTMENT", "AGENCY", "ADMINISTRATION",
    "COMMISSION", "COMMITTEE", "COUNCIL", "PARLIAMENT", "SENATE", "CONGRESS",
    "COURT", "POLICE", "MILITARY", "ARMY", "NAVY", "AIR FORCE", "EMBASSY",
    "CONSULATE", "UNIVERSITY", "COLLEGE", "INSTITUTE", "BANK", "COMPANY",
    "CORPORATION", "GROUP", "ASSOCIATION", "ORGANIZATION", "PARTY", "NATO",
    "UNITED NATIONS", "EUROPEAN UNION", "WORLD BANK", "IMF", "WHO", "WTO",
)

REDUCTION_BAD_NAMES = (
    "", "NAN", "NONE", "NULL", "UNKNOWN", "PEOPLE", "CITIZENS", "RESIDENTS",
    "PROTESTERS", "STUDENTS", "WORKERS", "WOMEN", "MEN", "CHILDREN",
    "CIVILIANS", "REFUGEES", "MIGRANTS",
)

REDUCTION_COLUMNS = (
    "GLOBALEVENTID", "SQLDATE",
    "Actor1Name", "Actor1CountryCode", "Actor1KnownGroupCode",
    "Actor1Type1Code", "Actor1Type2Code", "Actor1Type3Code",
    "Actor2Name", "Actor2CountryCode", "Actor2KnownGroupCode",
    "Actor2Type1Code", "Actor2Type2Code", "Actor2Type3Code",
    "EventCode", "EventBaseCode", "EventRootCode", "QuadClass",
    "GoldsteinScale", "NumMentions", "NumSources", "NumArticles", "AvgTone",
    "ActionGeo_FullName", "ActionGeo_CountryCode", "DATEADDED", "SOURCEURL",
)

# ---- fixed values: the 20 relation types ----------------------------------
RELATION_CODES = tuple(f"{n:02d}" for n in range(1, 21))

RELATION_LABELS = {
    "01": "公开声明",
    "02": "呼吁请求",
    "03": "表达合作意愿",
    "04": "协商磋商",
    "05": "外交合作",
    "06": "实质合作",
    "07": "提供援助",
    "08": "让步妥协",
    "09": "调查询问",
    "10": "要求施压",
    "11": "反对批评",
    "12": "拒绝合作",
    "13": "威胁警告",
    "14": "抗议冲突",
    "15": "非常规暴力",
    "16": "制裁断交",
    "17": "强制行动",
    "18": "军事攻击",
    "19": "军事冲突",
    "20": "战争暴力",
}

RELATION_DESCRIPTIONS = {
    "01": "公开声明或一般性表态。",
    "02": "呼吁、请求或要求。",
    "03": "表达合作意愿。",
    "04": "协商、磋商或外交接触。",
    "05": "开展外交合作。",
    "06": "开展实质合作。",
    "07": "提供援助或支持。",
    "08": "让步、妥协或同意。",
    "09": "调查或寻求信息。",
    "10": "要求、命令或施压。",
    "11": "反对、批评或拒绝。",
    "12": "拒绝合作或拒绝请求。",
    "13": "威胁、警告或强硬表态。",
    "14": "抗议、示威或政治冲突。",
    "15": "使用非常规暴力或恐怖行为。",
    "16": "减少关系、制裁或断绝合作。",
    "17": "胁迫、拘捕或强制行动。",
    "18": "攻击、军事打击或武装行动。",
    "19": "战斗或军事冲突。",
    "20": "大规模暴力、战争或严重冲突。",
}

# Grouping used by the evaluation tables: inclusive code ranges.
EVALUATION_GROUPS = {
    "verbal_cooperation": ("01", "05"),
    "material_cooperation": ("06", "08"),
    "verbal_conflict": ("09", "14"),
    "material_conflict": ("15", "20"),
}

# Grouping used by the pair rules.
BROAD_RELATIONS = ("01",)
PROCESS_CHAIN_PAIRS = (
    ("01", "02"), ("01", "03"), ("01", "04"), ("01", "05"), ("02", "03"),
    ("02", "04"), ("02", "05"), ("03", "04"), ("03", "05"), ("04", "05"),
    ("06", "07"), ("06", "08"), ("07", "08"),
)
INTERNAL_CONFLICT_PAIRS = (
    ("10", "11"), ("10", "12"), ("11", "12"), ("11", "13"), ("12", "13"),
    ("13", "14"), ("16", "17"), ("17", "18"), ("18", "19"), ("19", "20"),
)
VERBAL_DIPLOMACY = ("03", "04", "05")
MATERIAL_COOPERATION = ("06", "07", "08")
COOPERATION_ALL = ("03", "04", "05", "06", "07", "08")
RULE_VERBAL_CONFLICT = ("10", "11", "12", "13", "14")
SEVERE_CONFLICT = ("16", "17", "18", "19", "20")
MILITARY_OR_COERCIVE = ("17", "18", "19", "20")
SANCTION_OR_BREAK = ("16",)
THREAT_REJECT_CRITICIZE = ("11", "12", "13")
NEGOTIATION = ("04", "05")
AID_OR_CONCESSION = ("07", "08")
PROTEST_OR_UNCONVENTIONAL = ("14", "15")

PAIR_RULE_TEXTS = {
    "broad": "01 公开声明过于宽泛，不作为互斥约束的一端。",
    "process_chain": "该关系对通常是外交、合作或互动过程链条，不应作为互斥约束。",
    "internal_conflict": "该关系对通常是同一冲突过程中的升级或并发，不直接作为互斥约束。",
    "inside_verbal": "言语冲突内部关系通常可共存，不直接互斥。",
    "inside_severe": "实质冲突内部关系通常表示升级或并发，不直接互斥。",
    "material_vs_severe": "实质合作、援助或让步与制裁、强制、攻击、战斗等强冲突关系同月重叠时，可能表示复杂或矛盾关系。",
    "diplomacy_vs_force": "外交表态、协商或外交合作与强制行动、攻击、战斗同月重叠时，通常更适合标记 mixed 或 review，而不是直接隐藏。",
    "negotiation_vs_sanction": "协商或外交合作与制裁断交同月重叠时，可能表示关系复杂化，适合复核或标记 mixed。",
    "cooperation_vs_threat": "合作类关系与反对、拒绝、威胁类关系同月重叠时，可能表示复杂关系，但不宜直接判为硬冲突。",
    "aid_vs_protest": "援助、让步与抗议或非常规暴力同月重叠时可能表示关系复杂，需要复核。",
    "other": "该关系对不属于当前方法优先考虑的互斥候选范围。",
}

MEANINGLESS_REASONS = (
    "同一主体不能同时与多个客体", "同一主体不能同时和多个客体",
    "不能同时与多个客体", "多个主体不能同时对同一客体",
    "多个主体不能同时批评", "同一组织不能同时与多个组织",
    "同一个主体不能同时对多个对象", "一个主体只能有一个客体",
)

ALLOWED_ACTIONS = ("review", "downgrade", "hide", "mark_mixed", "mark_mixed_or_downgrade")
ALLOWED_FORBIDDEN = ("overlap", "same_month")
RESPONSE_WRAPPER_KEYS = ("constraints", "rules", "candidates", "data", "result")
CONSTRAINT_ID_FORMAT = "LLM_MUTEX_%04d"

# ---- fixed values: edge building and scoring ------------------------------
SEED_CONFIDENCE = 0.6
NEW_EDGE_CONFIDENCE = 0.3
CROSS_SOURCE_CONFIDENCE = 0.7
MIN_B_ONLY_EVENTS = 3

SCORE_BASE = {"cross": 0.70, "a": 0.55, "b": 0.40}
SCORE_CROSS_BONUS = 0.20
SCORE_COUNT_CAP = 0.20
SCORE_PENALTY = 0.15
LEVEL_HIGH = 0.75
LEVEL_MEDIUM = 0.50

REASON_TEXTS = {
    "a": "ICEWS支持",
    "b": "GDELT支持",
    "cross": "跨源共同支持",
    "few": "事件数量较少",
    "b_low": "GDELT单源低证据",
    "score": "最终置信度=",
}
REASON_SEPARATOR = "；"

SOURCE_WEIGHTS = {"cross": 1.20, "a": 1.00, "b": 0.85, "b_low": 0.60, "none": 0.75}

INTERVAL_STATUSES = ("active", "review", "downgraded")
OVERLAP_RELATIONS = ("overlap", "during", "contains", "equal")
DISJOINT_RELATIONS = ("before", "after", "meet", "disjoint")

# ---- fixed values: constraint thresholds ----------------------------------
STATUS_THRESHOLDS = {
    "pass": {"comparable": 30, "confidence": 0.85, "weighted": 0.85, "violation": 0.15},
    "strong_soft": {"comparable": 500, "confidence": 0.74, "weighted": 0.735, "violation": 0.26},
    "mixed_candidate": {"comparable": 500, "confidence": 0.72, "violation": 0.29},
    "review": {"comparable": 30, "confidence": 0.70},
    "weak_review": {"comparable": 10, "confidence": 0.60},
}
POOL_MIN_COMPARABLE = 5
POOL_MIN_INTERVALS = 10

MANUAL_STATUS_MAP = {
    "pass": "enabled_for_update",
    "enable": "enabled_for_update",
    "enabled": "enabled_for_update",
    "enabled_for_update": "enabled_for_update",
    "strong_soft": "enabled_for_mark_mixed",
    "mixed_candidate": "enabled_for_mark_mixed",
    "mark_mixed": "enabled_for_mark_mixed",
    "enabled_for_mark_mixed": "enabled_for_mark_mixed",
    "review": "review_only",
    "review_only": "review_only",
    "manual_review": "review_only",
    "weak": "disabled",
    "disable": "disabled",
    "disabled": "disabled",
    "drop": "disabled",
    "delete": "disabled",
}

# ---- fixed values: update actions -----------------------------------------
ACTION_SEVERITY = {
    "keep": 0, "review": 1, "mark_mixed": 2, "downgrade": 3,
    "hide_low_evidence": 4, "hide": 5,
}
ACTION_STATUS = {
    "keep": "keep", "review": "review", "mark_mixed": "mark_mixed",
    "downgrade": "downgraded", "hide_low_evidence": "hidden", "hide": "hidden",
}
ACTION_LABELS = {
    "keep": "保留", "review": "人工复核", "mark_mixed": "标记复杂关系",
    "downgrade": "置信度降权", "hide_low_evidence": "隐藏低证据边", "hide": "隐藏",
}
LEGACY_ACTION = {
    "keep": "keep", "review": "review", "mark_mixed": "mark_complex",
    "downgrade": "downgrade", "hide_low_evidence": "hide", "hide": "hide",
}
LEGACY_DECISION = {
    "enabled_for_update": "enabled", "enabled_for_mark_mixed": "enabled_mark_complex",
    "review_only": "review", "disabled": "disabled",
}
LEGACY_FINAL_SOURCE = "llm+patecon"
LEGACY_CANDIDATE_SOURCE = "llm"
DOWNGRADE_FACTOR = 0.8
HIDE_FACTOR = 0.5

# ---- fixed values: evidence groups and reporting --------------------------
HIGH_EVIDENCE = 0.70
LOW_EVIDENCE = 0.50
FORCED_ACTIONS = ("downgrade", "hide", "hide_low_evidence", "hidden", "downgraded")
PROCESSED_ACTIONS = (
    "review", "mark_mixed", "downgrade", "hide", "hide_low_evidence",
    "keep_with_conflict_tag", "mixed", "hidden", "downgraded",
)
FILTER_ACTIONS = ("filtered", "hide", "hide_low_evidence", "downgrade", "removed")
METHOD_PROCESSED_ACTIONS = (
    "filtered", "review", "mark_mixed", "downgrade", "hide",
    "hide_low_evidence", "keep_with_conflict_tag",
)
WEAK_STATUSES = ("weak", "weak_review", "review", "review_only", "weak_prompt")
QUALITY_STATUS_ORDER = {
    "pass": 1, "kept": 1, "strong_soft": 2, "mixed_candidate": 3,
    "review": 4, "weak_review": 5, "weak": 6,
}
UPDATE_STATUSES = ("enabled_for_update", "enabled_for_mark_mixed")
REVIEW_STATUSES = ("enabled_for_update", "enabled_for_mark_mixed", "review_only")
STRONG_REASON_PATTERN = "过强|误删|硬约束降为软约束|不启用"
