"""Queries over the marts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import times
from millrace.schemas import MONEY


def latest(mart: DataFrame, keys: list[str], version: str = "ts") -> DataFrame:
    """The newest version of every mart row; each map task keeps one row per key before the shuffle.

    Rows of one version go by their other columns, the largest first, so a repeated run gives the same row.
    """
    others = [c for c in mart.columns if c not in (*keys, version)]
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in (version, *others)])
    return mart.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def gmv_by_day(product_mart: DataFrame) -> DataFrame:
    """Order amount per day, the day as a number."""
    day = times.day_number(F.to_timestamp("stt"))
    return product_mart.groupBy(day.alias("day")).agg(F.sum("order_amount").cast(MONEY).alias("order_amount"))


def gmv(product_mart: DataFrame, day: int = 0) -> DataFrame:
    """Order amount of one day (UTC), today for 0, in the shape of the answer: status and data.

    A stored mart is laid out by the day that windows start on (``dt``), and only the files of the day are read; one that is not
    stored is filtered by the text that windows start with.
    """
    wanted = datetime.strptime(str(day), "%Y%m%d") if day else datetime.now(timezone.utc)
    text = wanted.strftime("%Y-%m-%d")
    stored = "dt" in product_mart.columns
    of_day = product_mart.filter(F.col("dt") == text if stored else F.col("stt").startswith(f"{text} "))
    return of_day.agg(F.lit(0).alias("status"), F.sum("order_amount").cast(MONEY).alias("data"))


def bounce_rate(visitor_mart: DataFrame, keys: list[str]) -> DataFrame:
    """Bounces per session."""
    sums = visitor_mart.groupBy(*keys).agg(F.sum("uj_ct").alias("uj_ct"), F.sum("sv_ct").alias("sv_ct"))
    return sums.withColumn("bounce_rate", F.when(F.col("sv_ct") > 0, F.col("uj_ct") / F.col("sv_ct")))
