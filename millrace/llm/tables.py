"""Opening tables and keeping intermediate ones where every executor can read them."""

from __future__ import annotations

import ctypes
import sys
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from types import ModuleType

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.session import checkpoint_root, configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared checkpoint folder; it stays, as a checkpoint does."""
    return f"{checkpoint_root(spark).rstrip('/')}/millrace-llm/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives a lost executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Hand the memory that was freed back to the system, where the platform can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(
    df: DataFrame, each: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` whose workers give memory back after a task: they are kept for later tasks, beside those at work."""

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(source)
        finally:
            give_back()

    return df.mapInArrow(batches, schema)


def append(
    df: DataFrame, added: str, each: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]]
) -> DataFrame:
    """The rows with more columns, computed by Arrow batch.

    ``added`` is a schema text; a column that has one of its names already is replaced. ``each`` turns batches into
    (rows, arrays of the added columns).
    """
    fields = StructType.fromDDL(added)
    rest = df.drop(*fields.names)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, columns in each(source):
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, *fields.names])

    return map_batches(rest, batches, StructType([*rest.schema.fields, *fields.fields]))


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Send an object of bounded size to the executors once; the result reads it there. Classes travel with it.

    It is compressed, as a broadcast lies on the disk of the driver and of every executor: tables of weights are mostly zeros.
    """
    held = spark.sparkContext.broadcast(zlib.compress(cloudpickle.dumps(value), 1))
    return lambda: cloudpickle.loads(zlib.decompress(held.value))


def worker_cache() -> dict:
    """A dictionary that lives as long as a Python worker. Code that travels by value has globals of its own in every task."""
    module = sys.modules.setdefault("_millrace_worker", ModuleType("_millrace_worker"))
    return module.__dict__.setdefault("held", {})


def first_rows(df: DataFrame, group: str, place: str, most: int | dict) -> DataFrame:
    """The rows of every group with the lowest places, at most ``most`` of each (by group, where it is a dictionary).

    The last place of each group is found on these two columns alone, so wide rows that are left out are never shuffled.
    Rows with a null group or place are left out.
    """
    spark = df.sparkSession
    limit = F.lit(most) if isinstance(most, int) else F.create_map(*[F.lit(v) for pair in most.items() for v in pair])[F.col(group)]
    nth = F.row_number().over(Window.partitionBy(group).orderBy(place))
    largest = most if isinstance(most, int) else max(most.values())
    known = df.filter(F.col(group).isNotNull() & F.col(place).isNotNull())
    places = known.select(group, place).withColumn("_nth", nth).filter(F.col("_nth") <= largest).filter(F.col("_nth") <= limit)
    last = places.groupBy(group).agg(F.max(place).alias("_last")).collect()  # a row for each group
    ends = spark.createDataFrame(last, places.groupBy(group).agg(F.max(place).alias("_last")).schema)
    near = known.join(F.broadcast(ends), group).filter(F.col(place) <= F.col("_last")).drop("_last")
    # Rows that tie with the last place are cut off by their other columns.
    columns = [place, *(c for c in df.columns if c not in (group, place))]
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*columns))
    return near.withColumn("_nth", nth).filter(F.col("_nth") <= limit).drop("_nth")


# A list of documents is sent to all tasks up to so many rows, and joined by shuffle beyond.
MOST_BROADCAST_ROWS = 500_000


def sent(df: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """A narrow table that is already written, marked for broadcast where its counted rows allow it."""
    return F.broadcast(df) if df.count() <= most else df


# Columns that ``keyed`` and ``same_document`` add.
KEY_NAMES = ("_id", "_tag", "_found_id", "_found_tag")


def keyed(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents with ``_id`` and ``_tag`` (hash of the text): what the operators tell documents apart by."""
    tag = F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    return documents.withColumns({"_id": F.col(id_column), "_tag": tag})


def set_aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with columns of these names (in any case of letters) renamed, so that operators may add their own, and a
    function that brings back exactly the columns of ``df``."""
    taken, wanted = {c.lower() for c in df.columns}, {name.lower() for name in names}
    renamed = {}
    for column in df.columns:
        if column.lower() in wanted:
            fresh = f"_aside_{column}"
            while fresh.lower() in taken | wanted:
                fresh = f"_{fresh}"
            taken.add(fresh.lower())
            renamed[column] = fresh

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(f"`{renamed.get(c, c)}`").alias(c) for c in df.columns])

    return df.withColumnsRenamed(renamed), back


def same_document(found: DataFrame, id_column: str = "doc_id") -> tuple[DataFrame, Column]:
    """Rows (id, tag, ...) renamed, and the condition that ties them to keyed documents; a null id equals a null id."""
    found = found.withColumnsRenamed({id_column: "_found_id", "tag": "_found_tag"})
    return found, F.col("_id").eqNullSafe(F.col("_found_id")) & (F.col("_tag") == F.col("_found_tag"))
