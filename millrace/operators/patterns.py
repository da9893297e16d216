"""Ordered patterns per key: jumps, rises, bounces, first visits. Batch forms; the streaming ones keep state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import ordered


def is_blank(column: Column) -> Column:
    """Null or empty."""
    return F.coalesce(column, F.lit("")) == ""


def level_jumps(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    level: str,
    jump: float = 10,
    literal: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Rows whose level differs from the row before by ``jump`` or more; the level before the first row is 0.

    ``literal`` compares |level| - previous instead, which misses drops.
    """
    seen = ordered.scan(df, keys, order, {"previous_level": ordered.previous(F.col(level))}, hot_rows=hot_rows)
    before = F.coalesce("previous_level", F.lit(0).cast(df.schema[level].dataType))
    change = F.abs(F.col(level)) - before if literal else F.abs(F.col(level) - before)
    return seen.withColumn("previous_level", before).filter(change >= jump)


def rising_alerts(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    level: str,
    hold: timedelta,
    hot_rows: int | None = None,
) -> DataFrame:
    """Keys whose level kept rising for ``hold``: one row per alert with the time of the first rise.

    Every row that does not rise ends a run and starts the next group; the level before the first row is 0. A run
    alerts unless a group starts within ``hold`` of its first rise.
    """
    keys = list(keys)
    cuts = ordered.find_cuts(df, keys, order, hot_rows)
    seen = ordered.scan(df, keys, order, {"_before": ordered.previous(F.col(level))}, cuts=cuts)
    zero = F.lit(0).cast(df.schema[level].dataType)
    marked = seen.withColumn("_rises", F.col(level) > F.coalesce("_before", zero))
    rests = F.when(F.col("_rises"), 0).otherwise(1)
    grouped = ordered.scan(marked, keys, order, {"_group_no": ordered.total(rests)}, cuts=cuts)
    runs = grouped.groupBy(*keys, "_group_no").agg(
        F.min(F.when(F.col("_rises"), F.col(ts))).alias("first_rise"), F.min(ts).alias("_start")
    )
    # The same cuts, along the start of the groups.
    moved = cuts and replace(cuts, axes=("_start", "_group_no"))
    ended = ordered.scan(
        runs, keys, ["_start", "_group_no"], {"_next": ordered.following(F.col("_start"))}, cuts=moved
    )
    late_end = F.col("_next").isNull() | (F.col("_next") > F.col("first_rise") + F.lit(hold))
    return ended.filter(F.col("first_rise").isNotNull() & late_end).select(*keys, "first_rise")


def bounces(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    entry: Column,
    follow: Column,
    timeout: timedelta,
    close_open: bool = True,
    hot_rows: int | None = None,
    cuts: ordered.Cuts | None | str = ordered.SEARCH,
) -> DataFrame:
    """Entry rows that no later row of the key follows before ``timeout`` has passed.

    A row exactly at the timeout is too late. ``close_open`` ends the input after its last row, so an entry without
    any follower counts; otherwise it counts only if the newest time of all rows has reached its timeout.
    """
    flagged = df.withColumn("_entry", entry).withColumn("_follow_ts", F.when(follow, F.col(ts)))
    seen = ordered.scan(
        flagged, keys, order, {"_next": ordered.following_known("_follow_ts")}, hot_rows=hot_rows, cuts=cuts
    ).filter("_entry")
    waited = F.col(ts) + F.lit(timeout)
    if close_open:
        out = seen.filter(F.col("_next").isNull() | (F.col("_next") >= waited))
    else:
        newest = df.agg(F.max(ts)).scalar()
        out = seen.filter(F.coalesce(F.col("_next"), newest) >= waited)
    return out.drop("_entry", "_follow_ts", "_next")


def repair_new_flag(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    flag: Column,
    name: str,
    hot_rows: int | None = None,
    cuts: ordered.Cuts | None | str = ordered.SEARCH,
) -> DataFrame:
    """Only the first row a key flags as new ('1') stays new, later ones become '0'; other rows pass unchanged."""
    marked = df.withColumn("_flag", flag)
    news = F.when(F.col("_flag") == "1", 1).otherwise(0)
    seen = ordered.scan(marked, [key], order, {"_news": ordered.total(news)}, hot_rows=hot_rows, cuts=cuts)
    repaired = F.when((F.col("_flag") == "1") & (F.col("_news") > 1), "0").otherwise(F.col("_flag"))
    return seen.withColumn("_repaired", repaired).drop("_flag", "_news").withColumnRenamed("_repaired", name)


def first_of_day(df: DataFrame, keys: Sequence[str], day: Column, order: Sequence[str], entry: Column) -> DataFrame:
    """The first entry row of every key and day; other rows are dropped.

    Each map task keeps one row per key and day before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(*order))
    return df.filter(entry).withColumn("_day", day).withColumn("_rank", rank).filter("_rank = 1").drop("_day", "_rank")


def distinct_per_key(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Each value of a key once."""
    return df.select(*keys, value).distinct()
