"""Batch and streaming readers for collections, text, delimited lines, change envelopes and JDBC tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schemas import WATER_SENSOR


def collection(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def text(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines of a file or of all files of a directory, in ``value``."""
    return (spark.readStream if streaming else spark.read).text(path)


def typed_csv(spark: SparkSession, path: str, schema: str, streaming: bool = False) -> DataFrame:
    """Delimited files without a header, columns by position."""
    return (spark.readStream if streaming else spark.read).schema(schema).csv(path)


def typed_lines(lines: DataFrame, schema: str, column: str = "value", delimiter: str = ",") -> DataFrame:
    """Delimited lines that already are in a frame (a topic, a socket), columns by position."""
    return lines.select(F.from_csv(column, schema, {"sep": delimiter}).alias("r")).select("r.*")


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def sensors(lines: DataFrame) -> DataFrame:
    """Sensor lines ``id,ts,vc``."""
    return typed_lines(lines, WATER_SENSOR)


def jdbc_table(
    spark: SparkSession, url: str, name: str, split: tuple[str, int, int, int] | None = None, **options: str
) -> DataFrame:
    """A table over JDBC. ``split`` (column, low, high, parts) reads it in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if split:
        column, low, high, parts = split
        reader = reader.options(
            partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)
        )
    return reader.load()


def renamed(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Columns under other names; by default snake case becomes camel case."""
    names = names or {c: _camel(c) for c in df.columns}
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(word.capitalize() for word in rest)


def json_table(
    topic: DataFrame,
    schema: str,
    rowtime: str,
    view: str,
    delay: str = "0 seconds",
) -> DataFrame:
    """A SQL source table over a topic of JSON values: columns, a computed ``rowtime`` and a watermark."""
    parsed = topic.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")
    table = parsed.withColumn("rowtime", F.expr(rowtime))
    if table.isStreaming:
        table = table.withWatermark("rowtime", delay)
    table.createOrReplaceTempView(view)
    return table
