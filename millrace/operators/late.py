"""Late rows: what a window with a watermark does with rows that arrive out of order.

Arrival order is a column. The watermark before a row is the highest event time of all rows that arrived before it,
less the delay. It is a running maximum over the whole input, evaluated chunk by chunk (see ``ordered``).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import ordered
from millrace.operators.windows import time_window

ON_TIME, REFIRE, TOO_LATE = "on_time", "refire", "too_late"


def watermark_trace(
    df: DataFrame,
    ts: str,
    arrival: Sequence[str],
    delay: timedelta,
    name: str = "watermark",
    hot_rows: int | None = None,
) -> DataFrame:
    """Add the watermark before each row: newest earlier time less the delay, less a millisecond; null at first."""
    seen = ordered.scan(df, [], arrival, {"_newest": ordered.largest(F.col(ts), before=True)}, hot_rows=hot_rows)
    return seen.withColumn(name, F.col("_newest") - F.lit(delay + timedelta(milliseconds=1))).drop("_newest")


def classify_late(
    df: DataFrame,
    ts: str,
    arrival: Sequence[str],
    width: str,
    delay: timedelta,
    lateness: timedelta,
    name: str = "status",
    hot_rows: int | None = None,
) -> DataFrame:
    """Tell rows of open windows from rows that make a window fire again and rows for the late output.

    A window fires when the watermark reaches its last millisecond, and is dropped ``lateness`` after that.
    """
    traced = watermark_trace(df, ts, arrival, delay, "_watermark", hot_rows)
    return judge(traced, ts, width, lateness, name)


def judge(df: DataFrame, ts: str, width: str, lateness: timedelta, name: str) -> DataFrame:
    """Status of rows by the watermark before them, in ``_watermark``."""
    last = F.window(ts, width)["end"] - F.lit(timedelta(milliseconds=1))
    status = (
        F.when(F.col("_watermark").isNull() | (F.col("_last") > F.col("_watermark")), ON_TIME)
        .when(F.col("_last") + F.lit(lateness) > F.col("_watermark"), REFIRE)
        .otherwise(TOO_LATE)
    )
    return df.withColumn("_last", last).withColumn(name, status).drop("_watermark", "_last")


def window_fires(classified: DataFrame, ts: str, width: str, keys: Sequence[str], status: str = "status") -> DataFrame:
    """Rows per window at its first fire, at its last one, and rows that went to the late output."""

    def rows(condition):
        return F.count(F.when(condition, 1))

    return time_window(
        classified,
        ts,
        width,
        keys,
        {
            "first_fire": rows(F.col(status) == ON_TIME),
            "last_fire": rows(F.col(status) != TOO_LATE),
            "side_output": rows(F.col(status) == TOO_LATE),
        },
    )
