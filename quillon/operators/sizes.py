"""Sides of joins whose size is looked at before they are sent to every executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Narrow rows that a broadcast side has at most; a larger side is shuffled.
ROWS = 200_000


def sent(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df, to be broadcast if it has that many rows at most: the count ends with the first row beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
