"""Explicit redistribution of rows. Joins and aggregates shuffle by themselves; use these before a costly map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import estimated_bytes

# Up to half the usual split of a file.
SMALL_BYTES = 64 * 1024 * 1024


def by_key(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Rows of one key in one partition."""
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def at_random(df: DataFrame, partitions: int, seed: int = 7) -> DataFrame:
    """Rows at random; the seed makes a recomputed task send every row to the same place."""
    return df.repartition(partitions, F.rand(seed))


def round_robin(df: DataFrame, partitions: int) -> DataFrame:
    """Even partitions, whatever the keys: the cure for a skewed input to a map."""
    return df.repartition(partitions)


def spread_small(df: DataFrame, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """Spread an input of a few files over all cores before costly row work; large inputs have splits enough.

    The size is the optimizer's estimate; beyond ``most_bytes`` the frame is returned as it is, without a shuffle.
    Rows go by the hash of all their columns: a round robin would sort them first, to be repeatable.
    """
    if df.isStreaming or estimated_bytes(df) > most_bytes:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *df.columns)


def rescale(df: DataFrame, partitions: int) -> DataFrame:
    """Fewer partitions without a shuffle."""
    return df.coalesce(partitions)


def to_all(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a control table for broadcast, after checking that it is no longer than ``max_rows``."""
    if df.limit(max_rows + 1).count() > max_rows:
        return df
    return F.broadcast(df)
