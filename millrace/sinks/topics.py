"""Writing records to topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_records(df: DataFrame, topic: str | Column, key: str | None = None) -> DataFrame:
    """Rows as records: the whole row as JSON under one topic, or a topic of each row's own."""
    name = F.lit(topic) if isinstance(topic, str) else topic
    key_column = F.lit(None).cast("string") if key is None else F.col(key).cast("string")
    return df.select(key_column.alias("key"), F.to_json(F.struct("*")).alias("value"), _seq(df), name.alias("topic"))


def _seq(df: DataFrame) -> Column:
    """The sequence number of the rows, where they have one."""
    return (F.col("seq") if "seq" in df.columns else F.lit(None).cast("long")).alias("seq")


def fact_records(facts: DataFrame) -> DataFrame:
    """Routed facts as records: only the record itself, under the topic its route names."""
    return facts.select(F.lit(None).cast("string").alias("key"), F.to_json("data").alias("value"), _seq(facts), "topic")


def append_folder(records: DataFrame, root: str, batch_id: int) -> None:
    """Write one micro-batch to folder topics; writing it again replaces it."""
    stamped = records.withColumn("timestamp", F.current_timestamp()).withColumn("batch", F.lit(batch_id))
    writer = stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("topic", "batch").parquet(root)


def append_kafka(records: DataFrame, servers: str) -> None:
    """Write one micro-batch to Kafka; the topic column names the topic of each record."""
    records.select("key", "value", "topic").write.format("kafka").option("kafka.bootstrap.servers", servers).save()
