"""Ratios and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column | str, whole: Column | str) -> Column:
    """``100 * part / whole``, NULL unless ``whole`` is positive."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.when(whole > 0, F.lit(100) * part / whole)


def fraction_true(flag: Column | str) -> Column:
    """Aggregate: share of rows on which a boolean holds; NULL over no rows."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.avg(flag.cast("int"))


def percent_true(flag: Column | str) -> Column:
    """Aggregate: percentage of rows on which a boolean holds."""
    return fraction_true(flag) * 100


def count_text(n: Column | str) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(n, 0)


def percent_text(value: Column | str) -> Column:
    """A percentage rounded to one decimal, which is left out when it is zero: 12.5%, 5%."""
    value = F.col(value) if isinstance(value, str) else value
    text = F.format_number(F.round(value, 1), 1)
    return F.concat(F.regexp_replace(text, r"\.0$", ""), F.lit("%"))
