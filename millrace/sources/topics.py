"""Topics: Kafka where a broker is at hand, a folder of Parquet files with the same columns otherwise.

A record has key, value, topic, timestamp and a sequence number (the offset in Kafka). A folder topic keeps one sub-folder per topic and micro-batch, so that
writing a batch again replaces it: a restarted job leaves every record once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "key string, value string, seq long, timestamp timestamp"


def read_kafka(spark: SparkSession, servers: str, topic: str, streaming: bool = True, start: str = "latest") -> DataFrame:
    """A Kafka topic as strings. Needs the Kafka connector on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    records = (
        reader.option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start if streaming else "earliest")
        .load()
    )
    return records.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "topic",
        "timestamp",
        F.col("offset").alias("seq"),
    )


def read_folder(
    spark: SparkSession, root: str, topic: str, streaming: bool = True, files_per_batch: int | None = None
) -> DataFrame:
    """A folder topic; ``files_per_batch`` bounds the size of a micro-batch."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.schema(RECORD).option("recursiveFileLookup", "true")
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{root}/topic={topic}").withColumn("topic", F.lit(topic))


def ensure_folder(spark: SparkSession, root: str, topic: str) -> None:
    """Make a folder topic that holds nothing yet, so that it can be read before it is written."""
    spark.createDataFrame([], RECORD).write.mode("append").parquet(f"{root}/topic={topic}")


def values(records: DataFrame, schema: str) -> DataFrame:
    """The JSON values of a topic as typed columns; numbers may be written as text, as in a change feed.

    A value that does not fit its column is null, so one bad record does not end a job.
    """
    parsed = records.select(F.from_json("value", "map<string,string>").alias("r"))
    fields = T.StructType.fromDDL(schema).fields
    return parsed.select(*[F.col("r")[f.name].try_cast(f.dataType).alias(f.name) for f in fields])
