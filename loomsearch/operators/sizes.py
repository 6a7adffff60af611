"""Sizes that are checked before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which the smaller side of a join may be broadcast.
BROADCAST_ROWS = 200_000


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows, else unchanged: then the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
