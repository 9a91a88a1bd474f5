"""Ticks to OHLCV bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars_from_ticks(
    ticks: DataFrame, keys: Sequence[str], price: str, volume: str, order: str
) -> DataFrame:
    """S17. One bar per key: open and close are the first and last price in ``order``.

    All aggregates are mergeable, so each task sends one row per key it saw and an entity with a
    large share of the ticks does not load one reducer. ``order`` must be unique within a key.
    """
    return ticks.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(volume).alias("volume"),
    )
