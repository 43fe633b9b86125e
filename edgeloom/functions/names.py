"""Name normalizers, qualifiers and the actor predicates."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom.constants import (
    ABBREVIATION_MAP,
    BAD_NAMES,
    GENERIC_CODE_NAMES,
    GENERIC_EXACT_NAMES,
    GENERIC_ORG_NAMES,
    MAX_NAME_WORDS,
    ORG_NAME_KEYWORDS,
    ORG_SECTOR_KEYWORDS,
    ORG_TYPE_CODES,
    REDUCTION_BAD_NAMES,
    REDUCTION_NAME_HINTS,
    REDUCTION_TYPE_CODES,
    SMALL_ALIAS_MAP,
)
from edgeloom.functions.parse import ColumnLike, clean_text, col, lookup


def any_of(words: Iterable[str]) -> str:
    """One alternation pattern: a single pass over the text instead of one test per word."""
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def _collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# ---- normalizers ------------------------------------------------------------

def light_name(c: ColumnLike) -> Column:
    """Upper case, white space collapsed."""
    return _collapse(F.upper(clean_text(c)))


def alias_name(c: ColumnLike) -> Column:
    """Light name with the few fixed country spellings replaced."""
    return lookup(light_name(c), SMALL_ALIAS_MAP)


def aligned_name(c: ColumnLike) -> Column:
    """Alignment name: brackets become parentheses and stay, symbols go, THE goes, abbreviations apply."""
    text = F.translate(F.upper(clean_text(c)), "[]{}", "()()")
    text = _collapse(F.regexp_replace(text, r"[^A-Z0-9\s()]", " "))
    text = F.regexp_replace(F.regexp_replace(text, r"\s+\)", ")"), r"\(\s+", "(")
    text = _collapse(F.regexp_replace(text, r"\(\s*\)", " "))
    text = F.trim(F.regexp_replace(text, r"^THE ", ""))
    return lookup(text, ABBREVIATION_MAP)


def lookup_name(c: ColumnLike) -> Column:
    """Feed A lookup name: qualifiers in () and [] dropped, symbols and THE dropped."""
    text = F.regexp_replace(F.upper(clean_text(c)), r"\(.*?\)|\[.*?\]", " ")
    return F.regexp_replace(_collapse(F.regexp_replace(text, r"[^A-Z0-9\s]", " ")), r"^THE\s+", "")


def upper_name(c: ColumnLike) -> Column:
    return F.upper(clean_text(c))


# ---- qualifiers -------------------------------------------------------------

def qualifiers(c: ColumnLike) -> Column:
    """Sorted set of the texts in parentheses."""
    found = F.transform(F.regexp_extract_all(col(c), F.lit(r"\((.*?)\)"), 1), lambda x: F.upper(clean_text(x)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


def base_name(c: ColumnLike) -> Column:
    return _collapse(F.regexp_replace(col(c), r"\(.*?\)", " "))


def qualifiers_differ(a: ColumnLike, b: ColumnLike) -> Column:
    """True when two names share a base but not their qualifiers: such names never merge."""
    return (base_name(a) == base_name(b)) & (qualifiers(a) != qualifiers(b))


def token_sorted(c: ColumnLike) -> Column:
    return F.array_join(F.array_sort(F.split(_collapse(col(c)), " ")), " ")


# ---- packed attributes ------------------------------------------------------

def sector_list(c: ColumnLike) -> Column:
    parts = F.transform(F.split(clean_text(c), ","), lambda x: F.upper(clean_text(x)))
    return F.filter(parts, lambda x: x != "")


def packed_types(known: ColumnLike, first: ColumnLike, second: ColumnLike, third: ColumnLike) -> Column:
    """Four space-separated codes; without a known group the type codes move one place left."""
    k, a, b, c = (F.coalesce(F.nullif(clean_text(x), F.lit("")), F.lit("nan")) for x in (known, first, second, third))
    has_known = clean_text(known) != ""
    shifted = F.concat_ws(" ", a, b, c, F.lit("nan"))
    return F.upper(F.when(has_known, F.concat_ws(" ", k, a, b, F.lit("nan"))).otherwise(shifted))


# ---- predicates -------------------------------------------------------------

def word_count(name: Column) -> Column:
    return F.size(F.split(name, " "))


def is_bad_name(c: ColumnLike) -> Column:
    """Blank, listed, a bare code, one character, digits only, a citizen entry, or more than twelve words."""
    name = light_name(c)
    listed = name.isin(*BAD_NAMES, *GENERIC_CODE_NAMES, *GENERIC_EXACT_NAMES)
    return (
        listed
        | (F.length(name) <= 1)
        | name.rlike(r"^\d+$")
        | name.startswith("CITIZEN (")
        | (word_count(name) > MAX_NAME_WORDS)
    )


def has_org_name(c: ColumnLike) -> Column:
    """A name of several words that contains, but is not, an organization word."""
    name = light_name(c)
    return (
        ~is_bad_name(name)
        & ~name.isin(*ORG_NAME_KEYWORDS)
        & (word_count(name) >= 2)
        & name.rlike(any_of(ORG_NAME_KEYWORDS))
    )


def is_org_type(packed: ColumnLike) -> Column:
    return col(packed).rlike(r"\b(" + any_of(ORG_TYPE_CODES) + r")\b")


def is_org_sector(sector: ColumnLike) -> Column:
    return F.upper(col(sector)).rlike(any_of(ORG_SECTOR_KEYWORDS))


def is_generic_org(c: ColumnLike) -> Column:
    return aligned_name(c).isin(*GENERIC_ORG_NAMES)


def reduction_signal(prefix: str) -> Column:
    """Organization signal of one side of a feed B event, by column prefix."""
    name = upper_name(f"{prefix}Name")
    typed = F.lit(False)
    for n in (1, 2, 3):
        typed = typed | F.upper(F.coalesce(F.col(f"{prefix}Type{n}Code"), F.lit(""))).isin(*REDUCTION_TYPE_CODES)
    known = clean_text(f"{prefix}KnownGroupCode") != ""
    return (known | typed | name.rlike(any_of(REDUCTION_NAME_HINTS))) & ~name.isin(*REDUCTION_BAD_NAMES)
