"""Per-row transforms: map, flat map, filter, split, union, per-partition set-up."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """One row in, one row out: exactly the named columns."""
    return df.select(*[value.alias(name) for name, value in columns.items()])


def flat_map(df: DataFrame, name: str, *values: Column) -> DataFrame:
    """One row out per value; the other columns are repeated."""
    return df.withColumn(name, F.explode(F.array(*values)))


def words(df: DataFrame, text: str, name: str = "word", pattern: str = r"\W+") -> DataFrame:
    """One row per word of ``text``; empty tokens are dropped."""
    return df.withColumn(name, F.explode(F.split(F.col(text), pattern))).filter(F.col(name) != "")


def parity(column: Column) -> Column:
    return F.when(column % 2 == 0, "even").otherwise("odd")


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of all frames, duplicates kept, columns matched by name."""
    return reduce(lambda left, right: left.unionByName(right), frames)


def connect(frames: Mapping[str, DataFrame], tag: str = "side") -> DataFrame:
    """Two inputs of different shape side by side: a tag tells them apart, missing columns are null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), tagged)


def rich_map(
    df: DataFrame,
    open_task: Callable[[], object],
    each: Callable[[object, pa.RecordBatch], pa.RecordBatch],
    schema: str,
    close_task: Callable[[object], None] = lambda resource: None,
) -> DataFrame:
    """A map with a resource opened and closed once per task; rows travel as Arrow batches.

    Only for resources that cannot be expressed as columns; everything else is a ``select``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resource = open_task()
        try:
            for batch in batches:
                yield each(resource, batch)
        finally:
            close_task(resource)

    return df.mapInArrow(run, schema)
