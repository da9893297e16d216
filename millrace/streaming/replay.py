"""Run a streaming plan over a finished table: everything present is processed in micro-batches, then it stops.

Progress and results go to a fresh folder below the session's checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from millrace.operators.ordered import estimated_bytes
from millrace.session import checkpoint_root, configure_streaming
from millrace.sinks.upsert import latest_per_key

# Input of one micro-batch; it bounds what a stateful operator sorts at a time.
BATCH_BYTES = 1 << 30
# A table is laid out in files of about this size, one range of times in each: what one task sorts, and what one task of a
# micro-batch reads.
RANGE_BYTES = 8 << 20
# A second apart; a file stream passes over files that are a week older than the newest one.
FIRST_CHANGE, MOST_FILES = 1_000_000_000_000, 600_000


def source(
    spark: SparkSession, path: str, schema: str, time: str, closing: str | None = None, batch_rows: int | None = None
) -> DataFrame:
    """A finished Parquet table, a file or a folder, as a stream in the order of its ``time`` column.

    The table is laid out again below the checkpoint folder, a file for each range of times, and a stream takes files by
    the time they were written; so these are set to rise with the ranges. Micro-batches then rise in time however the
    table itself is stored. A table that is not there, or a store that does not keep the times, is an error.

    ``closing``, an interval, adds a last row so much later than all others, null but for its time: it moves the watermark
    past everything that waits. Take it out again with ``without_closing``.

    ``batch_rows`` bounds a micro-batch by about that many rows, or one range, instead of by bytes: for a query that holds or
    copies all rows of one.
    """
    table = configure_streaming(spark).read.schema(schema).parquet(path)
    ranges = 1 + estimated_bytes(table) // RANGE_BYTES
    if batch_rows:
        rows = table.count()
        ranges = max(ranges, -(-rows // batch_rows))
    if closing:
        last = table.agg(F.max(time).alias(time)).withColumn(time, F.col(time) + F.expr(f"INTERVAL {closing}"))
        table = table.unionByName(last.filter(F.col(time).isNotNull()), allowMissingColumns=True)
    feed = _new_feed(spark)
    table.repartitionByRange(ranges, time).sortWithinPartitions(time).write.parquet(feed)
    files = _date_files(spark, feed)
    bound = ("maxFilesPerTrigger", max(1, batch_rows * files // max(1, rows))) if batch_rows else ("maxBytesPerTrigger", BATCH_BYTES)
    return spark.readStream.schema(schema).option(*bound).parquet(feed)


def without_closing(stream: DataFrame, known: str, time: str) -> DataFrame:
    """The rows without the closing one, in which ``known`` is null.

    The condition names the time too, so that it stays behind the watermark, which has to see the closing row.
    """
    return stream.filter(F.col(known).isNotNull() | F.col(time).isNull())


def in_batches(spark: SparkSession, path: str, schema: str, batch: Column, order: str) -> DataFrame:
    """A finished Parquet table as a stream of given micro-batches: one for each value of ``batch``, rising, sorted by ``order``.

    A micro-batch is one file, so it should be no more than a task can sort.
    """
    table = configure_streaming(spark).read.schema(schema).parquet(path).withColumn("_micro_batch", batch.cast("long"))
    feed = _new_feed(spark)
    table.repartition("_micro_batch").sortWithinPartitions("_micro_batch", order).write.partitionBy("_micro_batch").parquet(feed)
    _date_files(spark, feed)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(feed).drop("_micro_batch")


def _new_feed(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/replay/{uuid.uuid4()}/feed"


def _date_files(spark: SparkSession, folder: str) -> int:
    """Give the files of a folder rising times of change: by the number of their micro-batch, and by their names, which rise
    with the ranges. The number of files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found, listed = [], store.listFiles(where, True)
    while listed.hasNext():
        file = listed.next().getPath()
        if file.getName().startswith("part-"):
            number = file.getParent().getName().partition("_micro_batch=")[2]
            found.append((int(number) if number.lstrip("-").isdigit() else 0, str(file)))
    files = [file for _, file in sorted(found)]
    if len(files) < 2:
        return len(files)
    if len(files) > MOST_FILES:
        raise ValueError(f"{len(files)} files are too many for one replay: raise RANGE_BYTES")
    for number, file in enumerate(files):
        store.setTimes(spark._jvm.org.apache.hadoop.fs.Path(file), FIRST_CHANGE + 1000 * number, -1)
    dated = [store.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(f)).getModificationTime() for f in files]
    if dated != sorted(set(dated)):
        raise RuntimeError(f"{folder} does not keep the times of files: a replay would not be in order")
    return len(files)


def drain(stream: DataFrame, mode: str = "append", keys: Sequence[str] = (), settle: bool = True) -> DataFrame:
    """Process all input and read the result back; in update mode the newest row of every key counts.

    Without ``settle`` there is no last micro-batch for what only the watermark releases. It gives no rows of an inner join,
    it just empties its state.
    """
    spark = stream.sparkSession
    run = f"{checkpoint_root(spark)}/replay/{uuid.uuid4()}"
    schema = stream.schema

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/rows/_batch={batch_id}")

    spark.createDataFrame([], schema).write.mode("append").parquet(f"{run}/rows")
    writer = stream.writeStream.outputMode(mode).foreachBatch(each)
    writer = writer.option("checkpointLocation", f"{run}/progress").trigger(availableNow=True)
    _start(spark, writer, settle).awaitTermination()
    rows = spark.read.schema(schema.add("_batch", "long")).parquet(f"{run}/rows")
    return (latest_per_key(rows, keys, ["_batch"]) if mode == "update" else rows).drop("_batch")


def _start(spark: SparkSession, writer: DataStreamWriter, settle: bool = True) -> StreamingQuery:
    """Start a query; on a local master its state has one partition per core, as each costs a store and a worker.

    A query takes its settings when it starts, so the session's own are put back at once.
    """
    partitions = "spark.sql.shuffle.partitions"
    cores = spark.sparkContext.defaultParallelism
    own = {}
    if spark.sparkContext.master.startswith("local") and int(spark.conf.get(partitions)) > cores:
        own[partitions] = str(cores)
    if not settle:
        own["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
