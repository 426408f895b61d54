"""Broadcasts behind a check of the side's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is sent to every executor.
MOST = 100_000


def small(df: DataFrame, most: int = MOST) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows (no more are counted), else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
