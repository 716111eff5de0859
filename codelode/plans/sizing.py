"""Choosing join strategies by measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DatetimeType, NumericType

#: A side is broadcast only if it was counted and its rows take at most so many bytes; beyond, the join shuffles.
BROADCAST_BYTES = 8 << 20
#: Bytes of a value of varying length (string, binary, array, struct), unless the caller gives the width of its rows.
VARYING_BYTES = 128


def row_width(df: DataFrame) -> int:
    """Bytes of a row: 8 for numbers, times and flags, VARYING_BYTES for other values."""
    return sum(8 if isinstance(f.dataType, (NumericType, BooleanType, DatetimeType)) else VARYING_BYTES for f in df.schema)


def small_side(df: DataFrame, rows: int | None = None, width: int | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows take few bytes; rows: the count, where it is known already; width: bytes of a row."""
    return F.broadcast(df) if (df.count() if rows is None else rows) * (width or row_width(df)) <= most else df


def parts_for(rows: int, per_part: int, least: int = 1, most: int = 100_000) -> int:
    """How many groups of about per_part rows the rows make."""
    return max(least, min(most, -(-rows // per_part)))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where a scan of few files gives fewer tasks than there are cores; else as it is. For CPU-heavy Python stages.

    Only plans without an exchange are looked at, as asking others for their partitions would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """df exchanged by key into as many partitions as the session names, which adaptive execution doesn't merge: for joins whose result feeds CPU-heavy Python."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
