"""Timestamps are TIMESTAMP_NTZ holding UTC wall time, whatever the session time zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A date alone is not a valid timestamp here, though a plain cast would take it (fixed value).
_DATE_AND_TIME = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?$"
_SECONDS_PER_DAY = 86400.0


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_utc(text: Column | str) -> Column:
    """Parse ``yyyy-MM-dd HH:mm:ss`` with an optional `` UTC`` suffix; anything else is NULL."""
    bare = F.regexp_replace(_column(text), " UTC$", "")
    return F.when(bare.rlike(_DATE_AND_TIME), bare.try_cast("timestamp_ntz"))


def last_touch() -> Column:
    """When a step was last acted on: its completion if there is one, else the first visit."""
    return F.coalesce(F.col("last_completed_at"), F.col("first_visited_at"))


def days_between(start: Column | str, end: Column | str) -> Column:
    """Fractional days from ``start`` to ``end``.

    The subtraction of two TIMESTAMP_NTZ values is exact; ``timestampdiff`` would first move
    them into the session time zone and lose an hour around a clock change.
    """
    seconds = (_column(end) - _column(start)).cast("interval second").cast("decimal(20,6)")
    return seconds.cast("double") / F.lit(_SECONDS_PER_DAY)
