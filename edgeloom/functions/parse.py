"""Tolerant parsing of text columns. Every function takes a column (or name) and returns a Column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom.constants import FALSE_TOKENS, NULL_TOKENS, TRUE_TOKENS

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


WHITE_SPACE = " \t\n\r\f\v"


def clean_text(c: ColumnLike) -> Column:
    """Null to blank, outer white space removed."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")), F.lit(WHITE_SPACE))


def null_tokens_to_null(c: ColumnLike, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    value = col(c)
    return F.when(value.isin(*tokens), None).otherwise(value)


def to_double(c: ColumnLike, default: float = 0.0) -> Column:
    """Number or default; the words for not-a-number and infinity count as unreadable."""
    text = F.regexp_replace(clean_text(c), r"(?i)^[+-]?(nan|inf|infinity)$", "")
    return F.coalesce(text.try_cast("double"), F.lit(default))


def to_long(c: ColumnLike, default: int = 0) -> Column:
    """Whole part of a number given as text ("12.0" reads as 12)."""
    return F.coalesce(clean_text(c).try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def to_flag(c: ColumnLike) -> Column:
    return F.coalesce(F.lower(clean_text(c)).isin(*TRUE_TOKENS), F.lit(False))


def derived_flag(c: ColumnLike) -> Column:
    """True unless the text says the row is an original one."""
    return ~F.lower(clean_text(c)).isin(*FALSE_TOKENS)


def display_text(c: ColumnLike, default: ColumnLike | None = None) -> Column:
    """Text for a view: blank and null-like words give the default."""
    text = clean_text(c)
    return F.when(F.lower(text).isin("", "nan", "none", "null", "inf", "-inf"), F.lit("") if default is None else col(default)).otherwise(text)


def action_or_keep(c: ColumnLike) -> Column:
    return F.coalesce(F.nullif(clean_text(c), F.lit("")), F.lit("keep"))


def ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    return F.coalesce(F.try_divide(col(numerator).cast("double"), col(denominator).cast("double")), F.lit(0.0))


def percent_text(value: ColumnLike) -> Column:
    return F.format_string("%.2f%%", F.round(col(value) * 100, 2))


def list_text(c: ColumnLike, pattern: str = ";") -> Column:
    """Delimited text to an array of distinct trimmed parts, order kept."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), pattern), lambda x: clean_text(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def append_unique(old: ColumnLike, new: ColumnLike, separator: str = ";") -> Column:
    """Append a text to a delimited list unless it is already a member."""
    merged = F.concat(list_text(old, separator), F.filter(F.array(clean_text(new)), lambda x: x != ""))
    return F.array_join(F.array_distinct(merged), separator)


def sql_literal(value: object) -> str:
    """A Python value as SQL text."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)


def lookup(c: ColumnLike, mapping: Mapping[str, object], default: ColumnLike | None = None) -> Column:
    """Small fixed mapping as a literal map; keys outside it give the default (the key itself if none)."""
    key = col(c)
    literal = F.expr("map(" + ", ".join(sql_literal(x) for pair in mapping.items() for x in pair) + ")")
    return F.coalesce(F.try_element_at(literal, key), key if default is None else col(default))


# ---- dates and months -------------------------------------------------------

def sql_date_month(c: ColumnLike) -> Column:
    text = clean_text(c)
    return F.when(F.length(text) >= 6, F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2))).otherwise("")


def sql_date_day(c: ColumnLike) -> Column:
    text = clean_text(c)
    day = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    return F.when(F.length(text) >= 8, day).otherwise("")


def month_number(c: ColumnLike) -> Column:
    """Month ordinal (year * 12 + month - 1) from the usual spellings, null when unreadable.

    Dashed dates are brought to YYYYMM first; then the first six digits count.
    Written as one chain so that the column is referenced once: filters are
    pushed through projections by substitution, and repeats would multiply.
    """
    text = F.regexp_replace(F.regexp_replace(clean_text(c), r"\.0$", ""), r"[/.]", "-")
    two_digit_month = F.regexp_replace(text, r"^(\d{4})-(\d)(-\d{1,2})?$", "$1-0$2")
    compact = F.regexp_replace(two_digit_month, r"^(\d{4})-(\d{2})(-\d{1,2})?$", "$1$2")
    valid = F.regexp_extract(F.regexp_replace(compact, r"\D", ""), r"^(?!0000)\d{4}(0[1-9]|1[0-2])", 0).try_cast("int")
    return (F.floor(valid / 100) * 12 + valid % 100 - 1).cast("int")


def month_text(number: ColumnLike) -> Column:
    """Month ordinal back to YYYY-MM."""
    n = col(number)
    return F.concat_ws(
        "-",
        F.lpad(F.floor(n / 12).cast("string"), 4, "0"),
        F.lpad((n % 12 + 1).cast("string"), 2, "0"),
    )


def month_prefix(c: ColumnLike) -> Column:
    """Looser month text used on edges: first seven characters when dashed, else from the digits."""
    text = F.regexp_replace(F.regexp_replace(clean_text(c), r"\.0$", ""), r"[/.]", "-")
    six = F.regexp_extract(F.regexp_replace(text, r"\D", ""), r"^\d{6}", 0)
    from_digits = F.regexp_replace(six, r"^(\d{4})(\d{2})$", "$1-$2")
    return F.when(text.rlike(r"^.{4}-.{2}"), F.substring(text, 1, 7)).when(from_digits != "", from_digits).otherwise(F.substring(text, 1, 7))


def month_first_day(event_month: ColumnLike) -> Column:
    """YYYY-MM to the first day of the month, null when malformed."""
    text = clean_text(event_month)
    return F.when(text.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd"))


def month_bounds(event_month: ColumnLike) -> tuple[Column, Column]:
    """First and last day of a YYYY-MM month as YYYYMMDD text."""
    first = month_first_day(event_month)
    return F.date_format(first, "yyyyMMdd"), F.date_format(F.last_day(first), "yyyyMMdd")
