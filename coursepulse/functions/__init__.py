"""Column expressions shared by the operators; all built-in, none a Python UDF."""

from coursepulse.functions.bands import band_of, band_rank
from coursepulse.functions.numbers import (
    count_text,
    fraction_true,
    percent,
    percent_text,
    percent_true,
)
from coursepulse.functions.timestamps import days_between, last_touch, parse_utc

__all__ = [
    "band_of",
    "band_rank",
    "count_text",
    "days_between",
    "fraction_true",
    "last_touch",
    "parse_utc",
    "percent",
    "percent_text",
    "percent_true",
]
