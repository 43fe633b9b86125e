"""Event and relation code normalizers. The two feeds write codes differently, so each has its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom.constants import EVALUATION_GROUPS
from edgeloom.functions.parse import ColumnLike, clean_text, col


def _digits(c: ColumnLike) -> Column:
    """Digits before the first dot."""
    return F.regexp_replace(F.substring_index(clean_text(c), ".", 1), r"\D", "")


# The two digits of a valid relation code, at the start of a digit text.
_VALID = r"^(0[1-9]|1\d|20)"


def event_code_padded(c: ColumnLike) -> Column:
    """Feed A code as text of at least three digits ("51" is 051)."""
    return F.regexp_replace(F.regexp_replace(_digits(c), r"^(\d)$", "00$1"), r"^(\d\d)$", "0$1")


def relation_from_padded(c: ColumnLike) -> Column:
    """Feed A code to its two-digit top level, blank outside 01..20."""
    return F.regexp_extract(event_code_padded(c), _VALID, 1)


def relation_from_compact(c: ColumnLike) -> Column:
    """Feed B code to its two-digit top level.

    Up to two digits are a root code if they read as 1..20, else a code whose
    root is its first digit; longer codes start with the root.
    """
    first_digit = F.regexp_replace(_digits(c), r"^(?:(2)[1-9]|([3-9])\d)$", "0$1$2")
    return F.regexp_extract(F.regexp_replace(first_digit, r"^(\d)$", "0$1"), _VALID, 1)


def relation_from_root_or_code(root: ColumnLike, code: ColumnLike) -> Column:
    return F.coalesce(F.nullif(relation_from_compact(root), F.lit("")), relation_from_compact(code))


def relation_light(c: ColumnLike) -> Column:
    """Drop a trailing ".0" and pad a single digit; anything else stays."""
    return F.regexp_replace(F.regexp_replace(clean_text(c), r"\.0$", ""), r"^(\d)$", "0$1")


def relation_strict(c: ColumnLike) -> Column:
    """Digits before the dot, padded to two, blank unless one of the 20 codes ("X_01" and "1.0" read as 01)."""
    return F.regexp_extract(F.regexp_replace(_digits(c), r"^(\d)$", "0$1"), _VALID + "$", 1)


def relation_category(c: ColumnLike) -> Column:
    """Evaluation group of a relation code, blank when unknown."""
    code = relation_strict(c)
    result = F
    for name, (low, high) in EVALUATION_GROUPS.items():
        result = result.when(code.between(low, high), F.lit(name))
    return result.otherwise("")


def ordered_pair(a: ColumnLike, b: ColumnLike) -> tuple[Column, Column]:
    return F.least(col(a), col(b)), F.greatest(col(a), col(b))
