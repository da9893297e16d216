"""Aggregates that follow the rows of a key: the updated value appears on every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import ordered


def rolling_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    keep_first: Sequence[str] = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """Running sum; ``keep_first`` columns show the first row of the key, as ``first_<column>``."""
    values = {name: ordered.total(value)}
    values |= {f"first_{c}": ordered.first_value(F.col(c)) for c in keep_first}
    return ordered.scan(df, keys, order, values, hot_rows=hot_rows)


def rolling_min_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, low: str, high: str, hot_rows: int | None = None
) -> DataFrame:
    values = {low: ordered.smallest(value), high: ordered.largest(value)}
    return ordered.scan(df, keys, order, values, hot_rows=hot_rows)


def rolling_average(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, hot_rows: int | None = None
) -> DataFrame:
    """Running mean as sum over count; ``value`` should be a decimal or whole number, so that the sum is exact."""
    values = {"_sum": ordered.total(value), "_count": ordered.total(F.when(value.isNotNull(), 1).otherwise(0))}
    out = ordered.scan(df, keys, order, values, hot_rows=hot_rows)
    return out.withColumn(name, F.col("_sum").cast("double") / F.col("_count")).drop("_sum", "_count")


def rolling_extreme(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    payload: Sequence[str],
    *,
    highest: bool = True,
    last_on_ties: bool = True,
    prefix: str = "best_",
    hot_rows: int | None = None,
) -> DataFrame:
    """The whole row with the highest (lowest) value so far; on ties the first or the last such row.

    The order columns must be numbers, times or dates. Rows whose value is null never win.
    """
    rising = highest == last_on_ties
    places = [ordered.axis_number(df, c) for c in order]
    ranked = F.when(
        F.col(value).isNotNull(),
        F.struct(
            F.col(value).alias("value"),
            *[(p if rising else -p).alias(f"place{i}") for i, p in enumerate(places)],
            *[F.col(c).alias(f"payload_{c}") for c in payload],
        ),
    )
    follow = ordered.largest(ranked) if highest else ordered.smallest(ranked)
    out = ordered.scan(df, keys, order, {"_best": follow}, hot_rows=hot_rows)
    for column in payload:
        out = out.withColumn(f"{prefix}{column}", F.col("_best")[f"payload_{column}"])
    return out.drop("_best")


def extreme_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    payload: Sequence[str],
    *,
    highest: bool = True,
    last_on_ties: bool = True,
) -> DataFrame:
    """Final form of ``rolling_extreme``: one row per key, combined before the shuffle."""
    rising = highest == last_on_ties
    places = [ordered.axis_number(df, c) for c in order]
    rank = F.struct(F.col(value), *[p if rising else -p for p in places])
    rank = F.when(F.col(value).isNotNull(), rank)
    pick = F.max_by if highest else F.min_by
    return df.groupBy(*keys).agg(*[pick(F.col(c), rank).alias(c) for c in payload])


def rolling_distinct(
    df: DataFrame,
    column: str,
    order: Sequence[str],
    name: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Exact number of distinct values seen so far over all rows.

    The first place of every value comes from a pre-aggregated minimum. These places are merged into the rows and
    counted along the order; no set of values is ever held.
    """
    firsts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.min(F.struct(*order)).alias("_first"))
        .select("_first.*", F.lit(0).alias("_row"))
    )
    merged = df.withColumn("_row", F.lit(1)).unionByName(firsts, allowMissingColumns=True)
    counted = ordered.scan(
        merged, [], [*order, "_row"], {name: ordered.total(1 - F.col("_row"))}, hot_rows=hot_rows
    )
    return counted.filter("_row = 1").drop("_row").withColumn(name, F.col(name).cast("long"))


def running_row_count(
    df: DataFrame, order: Sequence[str], name: str, hot_rows: int | None = None
) -> DataFrame:
    """Number of rows seen so far over all rows."""
    return ordered.scan(df, [], order, {name: ordered.row_count()}, hot_rows=hot_rows)
