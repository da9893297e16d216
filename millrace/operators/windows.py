"""Window assigners: tumbling, sliding, session, global and count windows.

Aggregates are passed by name. Time windows are aligned to the epoch and half open. The time column may be a
timestamp with or without zone; every function that uses only built-in windows also takes a streaming frame with a
watermark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import ordered

# Format of window bounds in the marts (fixed value).
BOUND_FORMAT = "yyyy-MM-dd HH:mm:ss"

Aggregates = Mapping[str, Column]


def _named(aggregates: Aggregates) -> list[Column]:
    return [value.alias(name) for name, value in aggregates.items()]


def time_window(
    df: DataFrame, ts: str, width: str, keys: Sequence[str], aggregates: Aggregates, slide: str | None = None
) -> DataFrame:
    """Tumbling windows, or sliding ones with ``slide``: key columns, window_start, window_end, aggregates."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = df.groupBy(*keys, window.alias("_window")).agg(*_named(aggregates))
    return grouped.select(
        *keys, F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *aggregates
    )


def ingest_window(df: DataFrame, width: str, keys: Sequence[str], aggregates: Aggregates) -> DataFrame:
    """Tumbling windows over the time of arrival, stamped once per micro-batch or batch."""
    return time_window(df.withColumn("ingest_ts", F.current_timestamp()), "ingest_ts", width, keys, aggregates)


def with_bounds(df: DataFrame) -> DataFrame:
    """Replace the window bounds by the strings stt and edt."""
    bounds = {"stt": "window_start", "edt": "window_end"}
    rest = [c for c in df.columns if c not in bounds.values()]
    return df.select(*[F.date_format(c, BOUND_FORMAT).alias(n) for n, c in bounds.items()], *rest)


def window_report(df: DataFrame, ts: str, width: str, key: str) -> DataFrame:
    """One message per key and window naming the key, the bounds and the number of rows."""
    counted = time_window(df, ts, width, [key], {"n": F.count(F.lit(1))})
    return counted.withColumn(
        "message",
        F.concat_ws(
            " ",
            F.concat(F.lit("key="), F.col(key).cast("string")),
            F.concat(
                F.lit("window=["),
                F.date_format("window_start", BOUND_FORMAT),
                F.lit(","),
                F.date_format("window_end", BOUND_FORMAT),
                F.lit(")"),
            ),
            F.concat(F.lit("rows="), F.col("n").cast("string")),
        ),
    )


def session_window(
    df: DataFrame,
    ts: str,
    gap: str | Column,
    keys: Sequence[str],
    aggregates: Aggregates,
    order: Sequence[str] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Sessions per key. ``gap`` is an interval string, or a string column for a gap of each row's own.

    A row exactly at the end of a session still joins it. Batch keys too large for a task are cut and numbered by
    ``ordered.scan`` (then ``order`` must be unique within a key); everything else uses Spark's session windows,
    merged in the map tasks first.
    """
    cuts = None if df.isStreaming or not order else ordered.find_cuts(df, keys, order, hot_rows)
    if cuts is None:
        grouped = df.groupBy(*keys, F.session_window(ts, gap).alias("_session")).agg(*_named(aggregates))
        return grouped.select(
            *keys,
            F.col("_session.start").alias("session_start"),
            F.col("_session.end").alias("session_end"),
            *aggregates,
        )
    # A gap is added as Spark's own session windows add it; rows without a time or with a gap of nothing open no session.
    gap_column = F.lit(gap) if isinstance(gap, str) else gap
    ends = df.withColumn("_end", F.col(ts) + gap_column.cast("interval")).filter(F.col("_end") > F.col(ts))
    seen = ordered.scan(ends, keys, order, {"_open": ordered.largest(F.col("_end"), before=True)}, cuts=cuts)
    opens = F.when(F.col("_open").isNull() | (F.col(ts) > F.col("_open")), 1).otherwise(0)
    numbered = ordered.scan(
        seen.withColumn("_opens", opens), keys, order, {"_number": ordered.total(F.col("_opens"))}, cuts=cuts
    )
    bounds = {"session_start": F.min(ts), "session_end": F.max("_end")}
    grouped = numbered.groupBy(*keys, "_number").agg(*_named(bounds | dict(aggregates)))
    return grouped.drop("_number")


def global_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, ordered.Running],
    every: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """One endless window per key: fires after each ``every`` rows over all rows so far; never without a trigger."""
    fired = ordered.scan(df, keys, order, {"row_no": ordered.row_count(), **values}, hot_rows=hot_rows)
    return fired.filter(F.col("row_no") % every == 0 if every else F.lit(False)).select(*keys, "row_no", *values)


def global_window_count_or_time(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    every: int | None,
    span: timedelta | None,
    hot_rows: int | None = None,
) -> DataFrame:
    """One endless window per key with two triggers: firings (keys, ``cause``, ``at_ms``, ``n``), n rows so far.

    ``count``: after each ``every`` rows, at the time of the last of them. ``time``: at every multiple of ``span`` since the
    epoch before which new rows came, over the rows before it. Either trigger can be left out. ``order`` starts with ``ts``; rows
    without a time come first and belong to no span.
    """
    parts = []
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    if every:
        counted = ordered.scan(df, keys, order, {"n": ordered.row_count()}, hot_rows=hot_rows)
        fired = counted.filter(F.col("n") % every == 0)
        parts.append(fired.select(*keys, F.lit("count").alias("cause"), at.alias("at_ms"), F.col("n").cast("long").alias("n")))
    if span:
        width = span // timedelta(milliseconds=1)
        slot = ((F.floor(at / width) + 1) * width).cast("long")
        # Rows are counted by span before they are carried along: a key has a row for each of its spans.
        spans = df.select(*keys, slot.alias("at_ms")).groupBy(*keys, "at_ms").agg(F.count(F.lit(1)).alias("_rows"))
        carried = ordered.scan(spans, keys, ["at_ms"], {"n": ordered.total(F.col("_rows"))}, hot_rows=hot_rows)
        parts.append(carried.filter("at_ms IS NOT NULL").select(*keys, F.lit("time").alias("cause"), "at_ms", "n"))
    if not parts:
        raise ValueError("a window without a trigger never fires")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def count_tumbling(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: int,
    aggregates: Aggregates,
    hot_rows: int | None = None,
) -> DataFrame:
    """Windows of ``size`` rows per key; an unfinished last window is not emitted."""
    numbered = ordered.scan(df, keys, order, {"_row_no": ordered.row_count()}, hot_rows=hot_rows)
    slots = numbered.withColumn("window_no", F.floor((F.col("_row_no") - 1) / size))
    filled = slots.groupBy(*keys, "window_no").agg(*_named(aggregates), F.count(F.lit(1)).alias("_rows"))
    return filled.filter(F.col("_rows") == size).drop("_rows")


def count_sliding(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: int,
    slide: int,
    aggregates: Aggregates,
    hot_rows: int | None = None,
) -> DataFrame:
    """Every ``slide`` rows of a key, the aggregates over its last ``size`` rows (fewer at the start)."""
    cuts = ordered.find_cuts(df, keys, order, hot_rows)
    if cuts is None:
        rows = Window.partitionBy(*keys).orderBy(*order)
        frame = rows.rowsBetween(-(size - 1), 0)
        framed = df.select(
            *keys, F.row_number().over(rows).alias("row_no"), *[v.over(frame).alias(n) for n, v in aggregates.items()]
        )
        return framed.filter(F.col("row_no") % slide == 0).withColumn("row_no", F.col("row_no").cast("long"))
    numbered = ordered.scan(df, keys, order, {"_row_no": ordered.row_count()}, cuts=cuts)
    first = F.ceil(F.col("_row_no") / slide) * slide
    last = F.floor((F.col("_row_no") + size - 1) / slide) * slide
    fires = F.when(first <= last, F.sequence(first, last, F.lit(slide).cast("long")))
    members = numbered.withColumn("row_no", F.explode(fires))
    grouped = members.groupBy(*keys, "row_no").agg(*_named(aggregates), F.max("_row_no").alias("_newest"))
    return grouped.filter(F.col("_newest") == F.col("row_no")).drop("_newest")
