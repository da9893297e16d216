"""Versions of dimension rows: validity intervals from a change feed, and facts joined with the version of their time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import ordered


def intervals(
    changes: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    deleted: Column | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Every change with the time it holds from and up to (``valid_from``, ``valid_to``; null: still valid).

    Of changes at one instant the last one in ``order`` holds; the others would hold for no time and are left out, and so
    are changes without a time. A change for which ``deleted`` is true ends the version before it and opens none.
    """
    order = [c for c in order if c != ts]
    known = changes.filter(F.col(ts).isNotNull())
    known = known.withColumn("_gone", F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False)))
    seen = ordered.scan(known, keys, [ts, *order], {"valid_to": ordered.following(F.col(ts))}, hot_rows=hot_rows)
    lasting = F.col("valid_to").isNull() | (F.col("valid_to") > F.col(ts))
    return seen.filter(lasting & ~F.col("_gone")).withColumn("valid_from", F.col(ts)).drop("_gone")


def as_of_join(
    facts: DataFrame,
    changes: DataFrame,
    on: Mapping[str, str],
    fact_ts: str,
    change_ts: str,
    fact_order: Sequence[str],
    change_order: Sequence[str],
    columns: Mapping[str, str],
    deleted: Column | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Every fact with the columns of the newest change of its key at or before its time; nulls before the first one.

    ``on`` maps fact to change columns, ``columns`` maps change columns to output names. Changes are merged into the facts
    of their key and the last one is carried along the time. Nothing is compared pairwise, and a key with very many facts
    or changes is cut along the time (see ``ordered``). Facts without a time or with a null in the key have no version. A
    change for which ``deleted`` is true leaves nulls behind it. Rows that share a time go by ``fact_order`` and
    ``change_order``, which have equal types; changes come first.
    """
    names = [f"_key_{i}" for i in range(len(on))]
    places = [f"_order_{i}" for i in range(len(fact_order))]
    version = F.struct(*[F.col(c).alias(name) for c, name in columns.items()])
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    # The box is never null, so that a version of nulls is a version.
    marks = changes.filter(F.col(change_ts).isNotNull()).select(
        *[F.col(c).alias(name) for c, name in zip(on.values(), names)],
        F.col(change_ts).alias("_when"),
        *[F.col(c).alias(name) for c, name in zip(change_order, places)],
        F.struct(F.when(~gone, version).alias("version")).alias("_box"),
        F.lit(0).alias("_fact"),
    )
    rows = facts.select(
        *facts.columns,
        *[F.col(c).alias(name) for c, name in zip(on, names)],
        F.col(fact_ts).alias("_when"),
        *[F.col(c).alias(name) for c, name in zip(fact_order, places)],
        F.lit(1).alias("_fact"),
    )
    usable = F.col("_when").isNotNull()
    for name in names:
        usable = usable & F.col(name).isNotNull()
        marks = marks.filter(F.col(name).isNotNull())
    merged = rows.filter(usable).unionByName(marks, allowMissingColumns=True)
    seen = ordered.scan(
        merged, names, ["_when", "_fact", *places], {"_seen": ordered.last_known(F.col("_box"))}, hot_rows=hot_rows
    ).filter("_fact = 1")
    found = [F.col("_seen.version")[name].alias(name) for name in columns.values()]
    kinds = {name: changes.schema[c].dataType for c, name in columns.items()}
    bare = [F.lit(None).cast(kinds[name]).alias(name) for name in columns.values()]
    return seen.select(*facts.columns, *found).unionByName(rows.filter(~usable).select(*facts.columns, *bare))
