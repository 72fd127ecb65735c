"""Join sides of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a side is sent to every task.
BROADCAST_BYTES = 64 << 20


def dimension(df: DataFrame, row_bytes: int = 256) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough; otherwise as it is, for a shuffle join that adaptive execution can split."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
