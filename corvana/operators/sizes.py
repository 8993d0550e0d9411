"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a stated list (terms, rules, labels) that may be broadcast.
MOST = 10_000


def small(rows: DataFrame, most: int = MOST) -> DataFrame:
    """rows, to be broadcast if they are few; else as they are, for Spark to join by a shuffle or in blocks."""
    return F.broadcast(rows) if len(rows.limit(most + 1).select(F.lit(1)).take(most + 1)) <= most else rows
