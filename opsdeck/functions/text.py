"""Small text renderers used by the reports (labels, plurals, severity, money)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsdeck.constants import AGE_AGO_SUFFIX, AGE_TODAY, NOT_AVAILABLE, UNKNOWN_OWNER


def plural(n: Column, word: str) -> Column:
    """``1 day`` / ``2 days`` / ``0 days``."""
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def age_label(days: Column) -> Column:
    """``Today`` for 0, ``1 day ago``, otherwise ``n days ago`` (negative ages included)."""
    return (F.when(days == 0, F.lit(AGE_TODAY))
            .otherwise(F.concat(plural(days, "day"), F.lit(AGE_AGO_SUFFIX))))


def severity(age: Column, warn_days: int, danger_days: int, strict: bool) -> Column:
    """Row class: ``danger`` / ``warning`` / empty. ``strict`` compares with ``>``, else ``>=``.

    A null age gives the empty class.
    """
    over = (lambda limit: age > limit) if strict else (lambda limit: age >= limit)
    return (F.when(over(danger_days), F.lit("danger"))
            .when(over(warn_days), F.lit("warning"))
            .otherwise(F.lit("")))


def short_name(hostname: Column) -> Column:
    """Host name up to its first dot."""
    return F.substring_index(hostname, ".", 1)


def to_pounds(pence: Column) -> Column:
    """Whole pounds, halves rounded up (toward +infinity, also for negative amounts)."""
    return F.floor(pence / F.lit(100.0) + F.lit(0.5)).cast("bigint")


def owner_or_unknown(name: Column, script_truth: bool) -> Column:
    """Owner label: ``Unknown`` when missing or empty; with ``script_truth`` also when ``'0'``."""
    bad = ("", "0") if script_truth else ("",)
    return F.when(F.coalesce(~name.isin(*bad), F.lit(False)), name).otherwise(F.lit(UNKNOWN_OWNER))


def comma_list(text: Column) -> Column:
    """``a,b,c`` -> ``a, b, c``; ``n/a`` when missing, empty or ``'0'``. Trailing empty items
    are dropped, as a script-style split does."""
    items = F.regexp_replace(text, ",+$", "")
    return F.when(F.coalesce(~text.isin("", "0"), F.lit(False)), F.replace(items, F.lit(","), F.lit(", "))) \
        .otherwise(F.lit(NOT_AVAILABLE))
