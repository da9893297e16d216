"""The landing folder of the behaviour log, and the bronze table made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_MS = 9_000_000_000_000_000 // 1000


def raw_lines(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    """Lines as they arrive, with the day of their own timestamp; null where a line has none that can be read."""
    lines = (spark.readStream if streaming else spark.read).text(path)
    ms = F.get_json_object("value", "$.ts").try_cast("long")
    known = ms.between(-MOST_MS, MOST_MS)  # what a timestamp can hold
    return lines.withColumn("dt", F.date_format(F.timestamp_millis(F.when(known, ms)), "yyyy-MM-dd"))


def write_bronze(lines: DataFrame, path: str, checkpoint: str):
    """Append lines to the bronze table, one folder per day; runs until all present files are read."""
    writer = lines.writeStream.format("parquet").partitionBy("dt").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
