"""Interval, window, lookup, matching and control joins.

No join here forces a broadcast: Spark broadcasts a side when its measured size allows it, at planning time or at run
time, and shuffles (splitting skewed partitions) otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import ordered

# Slots this many times as long as the interval: one row in four or five falls into two slots.
SLOT_FACTOR = 4


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str],
    left_ts: str,
    right_ts: str,
    lower: timedelta,
    upper: timedelta,
    slots: bool = True,
) -> DataFrame:
    """Pairs with equal keys and right time in [left time + lower, left time + upper], both ends included.

    ``on`` maps left to right key columns; column names of the two sides must differ. Keys are joined together with
    a time slot, so a key with many rows is spread over its slots and only rows near in time are compared. A right
    row lies in one slot and a left row reaches for every slot its interval touches, hence no pair appears twice.

    Without ``slots`` batch frames are joined by their keys alone, which is for keys whose rows lie close together anyway,
    as those of an order do: no left row is copied, and a join or an aggregate by the same keys afterwards shuffles nothing.
    """
    if not slots and not (left.isStreaming or right.isStreaming):
        near = left.withColumn("_since", _place(left_ts, NO_LEFT_TIME))
        placed = right.withColumn("_at", _place(right_ts, NO_RIGHT_TIME))
        match = _equal(on) & (F.col("_at") - F.col("_since")).between(_micros(lower), _micros(upper))
        return near.join(placed, match).drop("_since", "_at")
    slot = SLOT_FACTOR * max(_micros(upper - lower), 1)
    since, at = F.col("_since"), F.col("_at")
    reach = F.sequence(_slot(since + _micros(lower), slot), _slot(since + _micros(upper), slot))
    near = left.withColumn("_since", _place(left_ts, NO_LEFT_TIME)).withColumn("_left_slot", F.explode(reach))
    placed = right.withColumn("_at", _place(right_ts, NO_RIGHT_TIME))
    placed = placed.withColumn("_right_slot", F.coalesce(_slot(at, slot), F.lit(NO_RIGHT_TIME)))
    match = (F.col("_left_slot") == F.col("_right_slot")) & _equal(on)
    if left.isStreaming or right.isStreaming:
        # Bounds on the watermarked columns tell the state store which rows can go.
        match = match & (F.col(right_ts) >= F.col(left_ts) + F.lit(lower))
        match = match & (F.col(right_ts) <= F.col(left_ts) + F.lit(upper))
        near, placed = near.drop("_since"), placed.drop("_at")
    else:
        match = match & (at - since).between(_micros(lower), _micros(upper))
    return near.join(placed, match).drop("_left_slot", "_right_slot", "_since", "_at")


# Places of rows without a time: far from all times and from each other. A place is never null, so that the optimizer
# has no reason to filter on it below, where it would work out the time a second time.
NO_LEFT_TIME, NO_RIGHT_TIME = -(10**18), -2 * 10**18


def _micros(interval: timedelta) -> int:
    return interval // timedelta(microseconds=1)


def _place(ts: str, missing: int) -> Column:
    return F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(missing))


def _slot(micros: Column, width: int) -> Column:
    return F.floor(micros / width).cast("long")


def window_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, width: str) -> DataFrame:
    """Pairs of the same keys and the same tumbling window; the right side's other columns get the prefix right_."""
    a = left.withColumn("_window", F.window(ts, width))
    b = right.withColumn("_window", F.window(ts, width))
    b = b.select(*keys, "_window", *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in keys])
    joined = a.join(b, [*keys, "_window"])
    return joined.select(
        F.col("_window.start").alias("window_start"),
        *left.columns,
        *[c for c in b.columns if c not in (*keys, "_window")],
    )


def window_join_count(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, width: str) -> DataFrame:
    """Number of pairs of a window join per key and window: both sides are counted before they meet."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        grouped = df.groupBy(*keys, F.window(ts, width).alias("_window")).agg(F.count(F.lit(1)).alias(name))
        return grouped.select(*keys, F.col("_window.start").alias("window_start"), name)

    both = counted(left, "left_rows").join(counted(right, "right_rows"), [*keys, "window_start"])
    return both.withColumn("pairs", F.col("left_rows") * F.col("right_rows"))


def reconcile(left: DataFrame, right: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """One-to-one matching of two feeds: every record of both sides with its status.

    Keys are unique within a side; ``match_in_order`` takes repeated ones. A null key matches nothing.
    """
    return _reconciled(left, right, _equal(on))


def reconcile_in_time(
    left: DataFrame, right: DataFrame, on: Mapping[str, str], left_ts: str, right_ts: str, within: timedelta
) -> DataFrame:
    """The same for records at most ``within`` apart (also streaming, with a watermark on both times).

    On streams a record without a partner is reported once the watermarks rule one out.
    """
    near = F.col(right_ts) >= F.col(left_ts) - F.lit(within)
    return _reconciled(left, right, _equal(on) & near & (F.col(right_ts) <= F.col(left_ts) + F.lit(within)))


def match_in_order(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str],
    left_order: Sequence[str],
    right_order: Sequence[str],
    hot_rows: int | None = None,
) -> DataFrame:
    """Matching that consumes: the n-th left record of a key meets its n-th right one, each record once.

    Every record of both sides comes back with its number (``match_no``, from 1, in arrival order) and ``status``; what has
    no partner is ``left_only`` or ``right_only``. A null key matches nothing and has no number. Records are numbered by
    ordered scans and joined by key and number, so a hot key is spread in both steps.
    """

    def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
        known = reduce(and_, [F.col(key).isNotNull() for key in keys])
        counted = ordered.scan(df.filter(known), keys, order, {name: ordered.row_count()}, hot_rows=hot_rows)
        return counted, df.filter(~known)

    a, bare_left = numbered(left, list(on), left_order, "_left_no")
    b, bare_right = numbered(right, list(on.values()), right_order, "_right_no")
    status = F.when(F.col("_right_no").isNull(), "left_only").when(F.col("_left_no").isNull(), "right_only").otherwise("matched")
    joined = a.join(b, _equal({**on, "_left_no": "_right_no"}), "full_outer").withColumn("status", status)
    joined = joined.withColumn("match_no", F.coalesce("_left_no", "_right_no")).drop("_left_no", "_right_no")
    out = joined.unionByName(bare_left.withColumn("status", F.lit("left_only")), allowMissingColumns=True)
    return out.unionByName(bare_right.withColumn("status", F.lit("right_only")), allowMissingColumns=True)


def _equal(on: Mapping[str, str]) -> Column:
    return reduce(and_, [F.col(left_key) == F.col(right_key) for left_key, right_key in on.items()])


def _reconciled(left: DataFrame, right: DataFrame, match: Column) -> DataFrame:
    a, b = left.withColumn("_left", F.lit(1)), right.withColumn("_right", F.lit(1))
    status = F.when(F.col("_right").isNull(), "left_only").when(F.col("_left").isNull(), "right_only").otherwise("matched")
    return a.join(b, match, "full_outer").withColumn("status", status).drop("_left", "_right")


def lookup(df: DataFrame, dim: DataFrame, on: Mapping[str, str], columns: Mapping[str, str]) -> DataFrame:
    """Enrich rows from a dimension with unique keys; a row without a match passes with nulls.

    ``on`` maps fact to dimension columns, ``columns`` maps dimension columns to output names. Only these columns
    of the dimension are read.
    """
    side = dim.select(
        *[F.col(key).alias(f"_dim_{key}") for key in dict.fromkeys(on.values())],
        *[F.col(c).alias(name) for c, name in columns.items()],
    )
    match = _equal({fact_key: f"_dim_{dim_key}" for fact_key, dim_key in on.items()})
    return df.join(side, match, "left").drop(*[f"_dim_{key}" for key in on.values()])


def switch(
    data: DataFrame,
    control: DataFrame,
    ts: str,
    order: Sequence[str],
    value: str,
    name: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Every data row with the newest control value at or before its time; null before the first one.

    Control rows are merged into the data and the last known value is carried along the time, so neither side is
    compared with the other: the cost is one shuffle, whatever the number of control rows.
    """
    marks = control.select(F.col(ts), *order, F.col(value).alias(name), F.lit(0).alias("_data"))
    rows = data.withColumn(name, F.lit(None).cast(control.schema[value].dataType)).withColumn("_data", F.lit(1))
    merged = rows.unionByName(marks, allowMissingColumns=True)
    seen = ordered.scan(
        merged, [], [ts, "_data", *order], {"_seen": ordered.last_known(F.col(name))}, hot_rows=hot_rows
    )
    return seen.filter("_data = 1").withColumn(name, F.col("_seen")).drop("_data", "_seen")


def switch_label(column: Column) -> Column:
    """Which configuration a control value selects."""
    return F.when(column == "1", "config_1").when(column == "0", "config_0").otherwise("config_other")
