"""Joins against tables that are small as a rule: their size is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a checked table is broadcast: 10,000 vectors of 384 floats are 15 MB.
MOST = 10_000


def small(df: DataFrame, most: int = MOST) -> DataFrame:
    """df with a broadcast hint if it has `most` rows or fewer; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
