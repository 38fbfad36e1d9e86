"""Engagement bands: a label by completion percentage and a rank to order the labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from coursepulse.model import BANDS, NO_BAND

Bands = Sequence[tuple[str, float]]


def band_of(rate: Column | str, bands: Bands = BANDS) -> Column:
    """Label of the highest band whose lower edge ``rate`` reaches; NULL below all of them."""
    rate = F.col(rate) if isinstance(rate, str) else rate
    label = F.lit(None).cast("string")
    for name, lower in sorted(bands, key=lambda band: band[1]):
        label = F.when(rate >= lower, F.lit(name)).otherwise(label)
    return label


def band_rank(label: Column | str, bands: Bands = BANDS) -> Column:
    """0 for no activity, then 1 for the lowest band upwards."""
    label = F.col(label) if isinstance(label, str) else label
    ordered = [name for name, _ in sorted(bands, key=lambda band: band[1])]
    names = F.array(*(F.lit(name) for name in [NO_BAND, *ordered]))
    return (F.array_position(names, label) - 1).cast("int")
