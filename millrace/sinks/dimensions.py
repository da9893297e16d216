"""Dimension tables fed by the change feed: all columns text, newest record of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schemas import SINK_DIMENSION
from millrace.sinks.upsert import KeyedTable

MOST_ROUTES = 10_000
SCHEMA = "dim string, pk string, data map<string,string>, seq long"


def dimensions(spark: SparkSession, root: str) -> KeyedTable:
    """All dimensions in one table laid out by dimension; created when missing."""
    table = KeyedTable(spark, f"{root}/dimensions", SCHEMA, ("dim", "pk"), ("seq",), ("dim",))
    table.create()
    return table


def columns_of(config: DataFrame) -> dict[str, list[str]]:
    """Columns of every configured dimension, its key (``id`` by default) first.

    The routing table is configuration; one of more than MOST_ROUTES dimension rows is refused.
    """
    rows = config.filter(F.col("sink_type") == SINK_DIMENSION).limit(MOST_ROUTES + 1).collect()
    if len(rows) > MOST_ROUTES:
        raise ValueError(f"a routing table of more than {MOST_ROUTES} dimensions")
    tables: dict[str, list[str]] = {}
    for row in rows:
        listed = [c.strip() for c in (row.sink_columns or "").split(",") if c.strip()]
        known = tables.setdefault(row.sink_table.upper(), [row.sink_pk or "id"])
        known.extend(c for c in listed if c not in known)
    return tables


def dimension(table: KeyedTable, name: str, columns: list[str]) -> DataFrame:
    """One dimension with its columns as they are now; read it anew for every batch to see updates."""
    rows = table.read().filter(F.col("dim") == name.upper())
    return rows.select(*[F.col("data")[c].alias(c) for c in columns])
