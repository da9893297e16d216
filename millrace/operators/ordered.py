"""Running values over the ordered rows of each key, safe for keys that hold a large share of the data.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts one key in one task. That is the best plan while every key
fits a task, and it is the plan used here then. When some keys are larger than ``hot_rows`` their rows are cut into
chunks along the order:

1. each chunk is evaluated as a window of its own (one shuffle on key and chunk), and chunks in which rows crowd are cut
   again until they are small;
2. each chunk of a hot key is summed up in one row (partial aggregation);
3. the summaries, one row per chunk, are carried forward and joined back.

The cut points are numbers fixed before the plan is built, so a recomputed task always sees the same chunks, and the
result does not depend on where the cuts are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of one key that one task may sort, unless the session says otherwise.
HOT_ROWS = 2_000_000
HOT_ROWS_SETTING = "spark.millrace.hotRows"
# Assumed width of a row when only the size of the input is known.
ROW_BYTES = 32
# An input is not counted if its rows would fit though it were packed this many times as densely.
SURE = 16
# Cells are equally wide, rows are not equally dense: cut finer than the average asks for.
OVERSPLIT = 4
# Hot keys looked for; the sketch tracks ten times as many candidates.
MAX_HOT_KEYS = 5_000
# Carry tables up to this many rows are broadcast, larger ones are shuffled.
BROADCAST_ROWS = 100_000

# At most this many chunks are cut again in a level, and at most so many levels.
MAX_HEAVY_CHUNKS = 100_000
MAX_LEVELS = 8

GROUP, CHUNK = "_group", "_chunk"
# Place of rows whose axis is null: before all others, as in the order.
NULL_PLACE = -(2**62)

# Asks ``scan`` to look for hot keys itself.
SEARCH = "search"


# ---------------------------------------------------------------------------------------------------------------
# Running values
# ---------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Running:
    """A value that follows the rows of a key and can be carried from chunk to chunk.

    local    value inside a chunk, over the ordered window
    summary  the chunk in one value, as an aggregate; gets the order as a struct
    carry    summary of the neighbouring chunks, over the chunks of a key; gets the name of the summary column
    merge    carry and local value combined
    """

    local: Callable[[WindowSpec], Column]
    summary: Callable[[Column], Column]
    carry: Callable[[str, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] = lambda value: value


def _upto(window: WindowSpec, last: int = 0) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, last)


def _either(merge: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda carry, local: F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(merge(carry, local))


def total(column: Column, *, before: bool = False) -> Running:
    """Sum up to the current row, or up to the row before it."""
    return Running(
        local=lambda w: F.sum(column).over(_upto(w, -1 if before else 0)),
        summary=lambda order: F.sum(column),
        carry=lambda s, w: F.sum(s).over(_upto(w, -1)),
        merge=_either(lambda carry, local: carry + local),
    )


def row_count() -> Running:
    """Number of rows up to the current one (1 for the first row of a key)."""
    return Running(
        local=lambda w: F.count(F.lit(1)).over(_upto(w)),
        summary=lambda order: F.count(F.lit(1)),
        carry=lambda s, w: F.sum(s).over(_upto(w, -1)),
        merge=_either(lambda carry, local: carry + local),
    )


def smallest(column: Column) -> Running:
    return Running(
        local=lambda w: F.min(column).over(_upto(w)),
        summary=lambda order: F.min(column),
        carry=lambda s, w: F.min(s).over(_upto(w, -1)),
        merge=_either(lambda carry, local: F.least(carry, local)),
    )


def largest(column: Column, *, before: bool = False) -> Running:
    """Maximum up to the current row, or up to the row before it."""
    return Running(
        local=lambda w: F.max(column).over(_upto(w, -1 if before else 0)),
        summary=lambda order: F.max(column),
        carry=lambda s, w: F.max(s).over(_upto(w, -1)),
        merge=_either(lambda carry, local: F.greatest(carry, local)),
    )


def first_value(column: Column) -> Running:
    """The value of the first row of the key, null included."""
    boxed = F.struct(column.alias("v"))
    return Running(
        local=lambda w: F.first(boxed).over(_upto(w)),
        summary=lambda order: F.min_by(boxed, order),
        carry=lambda s, w: F.first(s).over(_upto(w, -1)),
        merge=lambda carry, local: F.coalesce(carry, local),
        finish=lambda value: value["v"],
    )


def last_known(column: Column) -> Running:
    """The newest value that is not null, up to the current row."""
    return Running(
        local=lambda w: F.last(column, ignorenulls=True).over(_upto(w)),
        summary=lambda order: F.max_by(column, F.when(column.isNotNull(), order)),
        carry=lambda s, w: F.last(s, ignorenulls=True).over(_upto(w, -1)),
        merge=lambda carry, local: F.coalesce(local, carry),
    )


def previous(column: Column) -> Running:
    """The value of the row before, null on the first row."""
    boxed = F.struct(column.alias("v"))
    return Running(
        local=lambda w: F.lag(boxed).over(w),
        summary=lambda order: F.max_by(boxed, order),
        carry=lambda s, w: F.lag(s).over(w),
        merge=lambda carry, local: F.coalesce(local, carry),
        finish=lambda value: value["v"],
    )


def following(column: Column) -> Running:
    """The value of the row after, null on the last row."""
    boxed = F.struct(column.alias("v"))
    return Running(
        local=lambda w: F.lead(boxed).over(w),
        summary=lambda order: F.min_by(boxed, order),
        carry=lambda s, w: F.lead(s).over(w),
        merge=lambda carry, local: F.coalesce(local, carry),
        finish=lambda value: value["v"],
    )


def following_known(name: str) -> Running:
    """The next value of a column that is not null, after the current row."""
    column = F.col(name)
    return Running(
        local=lambda w: F.expr(f"lead({name}) IGNORE NULLS").over(w),
        summary=lambda order: F.min_by(column, F.when(column.isNotNull(), order)),
        carry=lambda s, w: F.expr(f"lead({s}) IGNORE NULLS").over(w),
        merge=lambda carry, local: F.coalesce(local, carry),
    )


# ---------------------------------------------------------------------------------------------------------------
# Finding and cutting hot keys
# ---------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class HotGroup:
    """Extent of one hot key along the axis, cut into cells of equal width."""

    group: int
    low: int
    width: int
    cells: int


@dataclass(frozen=True)
class HeavyChunk:
    """A chunk with too many rows for one task, cut into parts.

    Along the first axis, or, when all of its rows share one place ``at`` there, along the second.
    """

    group: int
    chunk: tuple[int, ...]
    at: int | None
    low: int
    width: int
    parts: int


@dataclass(frozen=True)
class Cuts:
    """Chunks of the hot keys. Keys not listed stay whole.

    A chunk is an array: the cell of the key, then, level by level, the part of the chunk so far where that was too
    heavy, else 0. ``axes`` are one or two leading columns of the order. Any cuts are valid for any rows, since a chunk
    only depends on the place of a row and never falls along the order.
    """

    keys: tuple[str, ...]
    axes: tuple[str, ...]
    hot: tuple[HotGroup, ...]
    levels: tuple[tuple[HeavyChunk, ...], ...] = ()

    @property
    def chunks(self) -> int:
        return sum(g.cells for g in self.hot) + sum(c.parts for level in self.levels for c in level)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the chunk; ``_width`` is null for keys that stay whole, ``_part_width`` outside the last level's chunks."""
        spark = df.sparkSession
        first, second = axis_number(df, self.axes[0]), axis_number(df, self.axes[-1])
        if not self.keys:
            (whole,) = self.hot
            out = df.withColumns({GROUP: F.lit(0), "_low": F.lit(whole.low), "_width": F.lit(whole.width)})
        else:
            groups = spark.createDataFrame(
                [(g.group, g.low, g.width) for g in self.hot], f"{GROUP} long, _low long, _width long"
            )
            # At most MAX_HOT_KEYS rows.
            out = df.withColumn(GROUP, group_number(self.keys)).join(F.broadcast(groups), GROUP, "left")
        cell = F.when(F.col("_width").isNull(), F.lit(0)).otherwise(_step(first, F.col("_low"), F.col("_width")))
        out = out.withColumn(CHUNK, F.array(cell)).withColumn("_part_width", F.col("_width")).drop("_low")
        for level in self.levels:
            heavy = spark.createDataFrame(
                [(c.group, list(c.chunk), c.at, c.low, c.width) for c in level],
                "_g long, _c array<long>, _at long, _low long, _part_width long",
            )
            match = (F.col(GROUP) == F.col("_g")) & (F.col(CHUNK) == F.col("_c"))
            known = F.coalesce(first, F.lit(NULL_PLACE))
            # At most MAX_HEAVY_CHUNKS rows.
            out = out.drop("_part_width").join(F.broadcast(heavy), match, "left")
            low, width = F.col("_low"), F.col("_part_width")
            part = (
                F.when(width.isNull(), F.lit(0).cast("long"))
                .when(F.col("_at").isNull(), _step(first, low, width))
                .when(known < F.col("_at"), F.lit(NULL_PLACE))
                .when(known > F.col("_at"), F.lit(-NULL_PLACE))
                .otherwise(_step(second, low, width))
            )
            out = out.withColumn(CHUNK, F.concat(CHUNK, F.array(part))).drop("_g", "_c", "_at", "_low")
        return out


def _step(place: Column, low: Column, width: Column) -> Column:
    """Places outside the measured extent get steps below and above it, so an extent may come from a sample."""
    return F.coalesce(F.floor((place - low) / width).cast("long"), F.lit(NULL_PLACE))


def group_number(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def axis_number(df: DataFrame, axis: str) -> Column:
    """The axis as a whole number that rises with it."""
    kind = df.schema[axis].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(axis).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(axis)).cast("long")
    if isinstance(kind, T.IntegralType):
        return F.col(axis).cast("long")
    raise TypeError(f"{axis} is {kind.simpleString()}: an axis is a time, a date or a whole number")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of a frame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def session_hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))


def axes_of(df: DataFrame, order: Sequence[str]) -> tuple[str, ...]:
    """The columns to cut along: the first of the order, and the second where it has numbers or times too."""
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType, T.IntegralType)
    usable = len(order) > 1 and isinstance(df.schema[order[1]].dataType, kinds)
    return tuple(order[:2]) if usable else (order[0],)


def _fits(df: DataFrame, hot_rows: int) -> bool:
    """Whether all rows together are no more than a task may sort. Files say little about rows: all but very small ones are
    counted, which reads no values from Parquet."""
    size = estimated_bytes(df)
    if size <= hot_rows * ROW_BYTES // SURE:
        return True
    return size <= hot_rows * ROW_BYTES and df.count() <= hot_rows


def find_cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int | None = None) -> Cuts | None:
    """Look for keys with more than ``hot_rows`` rows; None when every key fits one task.

    Inputs of no more rows than one task may sort are not looked at. Otherwise one pass over the key columns feeds a
    frequent-items sketch (no shuffle but that of the sketch), a second one measures the keys it named, and further ones
    look for chunks that are still too heavy: rows may crowd in a short time, even at one instant. Without keys all rows
    are one group, which is always cut. ``hot_rows`` defaults to the session's setting.
    """
    hot_rows = hot_rows or session_hot_rows(df.sparkSession)
    axes = axes_of(df, order)
    place = axis_number(df, axes[0])
    extent = [F.count(F.lit(1)).alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")]
    if not keys:
        row = df.select(place.alias("p")).agg(*extent).first()
        least = 2 * df.sparkSession.sparkContext.defaultParallelism
        cuts = Cuts((), axes, (_hot_group(0, row, hot_rows, least),))
        return _with_levels(df, cuts, row.n, hot_rows)
    if _fits(df, hot_rows):
        return None
    groups = df.select(group_number(keys).alias(GROUP), place.alias("p"))
    sketch = groups.agg(F.expr(f"approx_top_k({GROUP}, {MAX_HOT_KEYS}, {10 * MAX_HOT_KEYS})").alias("top")).first()
    hot = [(item["item"],) for item in sketch.top or [] if item["count"] > hot_rows]
    if not hot:
        return None
    named = groups.join(F.broadcast(df.sparkSession.createDataFrame(hot, f"{GROUP} long")), GROUP)
    measured = named.groupBy(GROUP).agg(*extent).collect()
    cuts = Cuts(tuple(keys), axes, tuple(_hot_group(r[GROUP], r, hot_rows, 1) for r in measured))
    return _with_levels(df, cuts, sum(r.n for r in measured), hot_rows)


def _pieces(rows: int, hot_rows: int) -> int:
    return -(-OVERSPLIT * rows // hot_rows)


def _width(low: int, high: int, pieces: int) -> int:
    return max(1, -(-(high - low + 1) // max(pieces, 1)))


def _hot_group(group: int, row: Row, hot_rows: int, least: int) -> HotGroup:
    low, high = row.lo or 0, row.hi or 0
    pieces = max(_pieces(row.n, hot_rows), least)
    return HotGroup(group, low, _width(low, high, pieces), min(pieces, high - low + 1))


def _with_levels(df: DataFrame, cuts: Cuts, rows: int, hot_rows: int) -> Cuts:
    """Cut chunks with more than ``hot_rows`` rows again, until none is left that can be cut."""
    most = max(hot_rows, rows // MAX_HEAVY_CHUNKS)
    # Rows without a first axis share one place, so they are cut along the second.
    first, second = F.coalesce(axis_number(df, cuts.axes[0]), F.lit(NULL_PLACE)), axis_number(df, cuts.axes[-1])
    while rows > hot_rows and len(cuts.levels) < MAX_LEVELS:
        counted = (
            cuts.assign(df)
            .filter(F.col("_part_width").isNotNull())
            .groupBy(GROUP, CHUNK)
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.min(first).alias("lo"),
                F.max(first).alias("hi"),
                F.min(second).alias("lo2"),
                F.max(second).alias("hi2"),
            )
        )
        level = []
        for r in counted.filter(F.col("n") > most).collect():
            crowded = r.lo == r.hi
            low, high = (r.lo2, r.hi2) if crowded else (r.lo, r.hi)
            if low is not None and low != high:
                pieces = _pieces(r.n, hot_rows)
                at, width = r.lo if crowded else None, _width(low, high, pieces)
                level.append(HeavyChunk(r[GROUP], tuple(r[CHUNK]), at, low, width, min(pieces, high - low + 1)))
        if not level:
            break
        cuts = replace(cuts, levels=(*cuts.levels, tuple(level)))
    return cuts


# ---------------------------------------------------------------------------------------------------------------
# Evaluation
# ---------------------------------------------------------------------------------------------------------------


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Running],
    *,
    hot_rows: int | None = None,
    cuts: Cuts | None | str = SEARCH,
) -> DataFrame:
    """Add running values over the rows of each key, ordered ascending by ``order``.

    ``order`` must be unique within a key and start with a number, a time or a date, along which hot keys are cut.
    ``cuts`` hands over the outcome of ``find_cuts``.
    """
    keys, order = list(keys), list(order)
    if cuts == SEARCH:
        cuts = find_cuts(df, keys, order, hot_rows)
    if cuts is None:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[v.finish(v.local(window)).alias(name) for name, v in values.items()])

    chunked = cuts.assign(df)
    window = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    local = chunked.select("*", *[v.local(window).alias(f"_l_{name}") for name, v in values.items()])
    carried = carries(chunked, keys, order, values)
    joined = join_carries(local, carried, keys, cuts)
    return joined.select(
        *df.columns,
        *[v.finish(v.merge(F.col(f"_c_{name}"), F.col(f"_l_{name}"))).alias(name) for name, v in values.items()],
    )


def carries(chunked: DataFrame, keys: list[str], order: list[str], values: Mapping[str, Running]) -> DataFrame:
    """One row per chunk of a hot key with what its neighbours hand over."""
    rows = chunked.filter(F.col("_width").isNotNull()) if keys else chunked
    place = F.struct(*order)
    summaries = rows.groupBy(*keys, CHUNK).agg(*[v.summary(place).alias(f"_s_{name}") for name, v in values.items()])
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    return summaries.select(
        *keys, CHUNK, *[v.carry(f"_s_{name}", chunks).alias(f"_c_{name}") for name, v in values.items()]
    )


def join_carries(local: DataFrame, carried: DataFrame, keys: list[str], cuts: Cuts) -> DataFrame:
    """Join the carries back; a null key is a key like any other."""
    side = carried.select(
        *[F.col(c).alias(f"_k_{c}") if c in (*keys, CHUNK) else F.col(c) for c in carried.columns]
    )
    if cuts.chunks <= BROADCAST_ROWS:
        side = F.broadcast(side)
    match = F.col(CHUNK) == F.col(f"_k_{CHUNK}")
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return local.join(side, match, "left")
