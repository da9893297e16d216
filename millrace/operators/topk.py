"""Highest values per key: final and rolling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import ordered
from millrace.operators.ordered import CHUNK


def top_rows(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], k: int = 3) -> DataFrame:
    """The k highest rows per key with their rank; ties go to the earlier row.

    Spark cuts every map task's rows to k per key before the shuffle, so a hot key costs k rows per task.
    """
    best = Window.partitionBy(*keys).orderBy(F.col(value).desc(), *order)
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def rolling_top3(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """After every row the three highest values of the key so far, as an array in descending order.

    Three running maxima in one sort: what a new value drives out of the first place competes for the second, and
    what is driven out of the second competes for the third. Nulls are ignored.
    """
    keys, order = list(keys), list(order)
    cuts = ordered.find_cuts(df, keys, order, hot_rows)
    if cuts is None:
        return _cascade(df, Window.partitionBy(*keys).orderBy(*order), F.col(value), name)

    chunked = cuts.assign(df)
    local = _cascade(chunked, Window.partitionBy(*keys, CHUNK).orderBy(*order), F.col(value), "_local")
    rows = chunked.filter(F.col("_width").isNotNull()) if keys else chunked
    best = top_rows(rows.select(*keys, CHUNK, *order, value), [*keys, CHUNK], value, order)
    # Three rows per chunk: the best so far after each of them, kept at the last one.
    seen = _cascade(best, Window.partitionBy(*keys).orderBy(CHUNK, "rank"), F.col(value), "_seen")
    ends = seen.groupBy(*keys, CHUNK).agg(F.max_by("_seen", "rank").alias("_seen"))
    carried = ends.withColumn("_carry", F.lag("_seen").over(Window.partitionBy(*keys).orderBy(CHUNK))).drop("_seen")
    joined = ordered.join_carries(local, carried, keys, cuts)
    merged = F.concat(F.coalesce("_carry", F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>")), "_local")
    return joined.withColumn(name, F.slice(F.sort_array(merged, asc=False), 1, 3)).select(*df.columns, name)


def _cascade(df: DataFrame, window, value: Column, name: str) -> DataFrame:
    """Running first, second and third maximum; the helper columns share one sort."""
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    out, stream = df.withColumn("_in1", value), "_in1"
    for place in (1, 2, 3):
        out = out.withColumn(f"_max{place}", F.max(stream).over(upto))
        if place < 3:
            held = F.lag(f"_max{place}").over(window)
            loser = F.when(F.col(stream).isNotNull() & F.col("_held").isNotNull(), F.least("_held", stream))
            out = out.withColumn("_held", held).withColumn(f"_in{place + 1}", loser)
            stream = f"_in{place + 1}"
    best = F.array_compact(F.array("_max1", "_max2", "_max3"))
    return out.withColumn(name, best).drop("_in1", "_in2", "_in3", "_max1", "_max2", "_max3", "_held")
