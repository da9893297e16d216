"""Replays of finished tables give the same rows however the table is stored, in one micro-batch or many."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues

from millrace import queries as registry
from millrace.streaming import in_time, replay, stateful
from oracle import connect, difference

TABLES = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
registry.load()
STREAMED = sorted(name for name in registry.QUERIES if name.startswith("stream_"))


@pytest.fixture(scope="module")
def shuffled(spark, tables, tmp_path_factory):
    """The tables as folders of four files that are not in the order of time."""
    folder = tmp_path_factory.mktemp("shuffled")
    for name in TABLES:
        df = spark.read.parquet(f"{tables}/{name}.parquet")
        df.repartition(4).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", STREAMED)
def test_folder_in_many_batches_equals_sql(spark, tables, shuffled, monkeypatch, name):
    monkeypatch.setattr(replay, "RANGE_BYTES", 12_000)
    monkeypatch.setattr(replay, "BATCH_BYTES", 1)
    assert difference(registry.QUERIES[name](spark, shuffled), connect(tables), registry.SQL[name]) is None


def test_a_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        replay.source(spark, f"{tmp_path}/nothing.parquet", "ts timestamp", "ts")


def test_distinct_values_have_no_horizon(spark, tmp_path):
    rows = [("a", year * 31_536_000_000, year, v) for year in range(12) for v in ("x", None)]
    frame = spark.createDataFrame(rows, "key string, ts long, seq long, value string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    stream = replay.source(spark, f"{tmp_path}/t.parquet", "key string, ts long, seq long, value string", "ts")
    found = replay.drain(stateful.run_keyed(stream, "key", stateful.DistinctValues(), stateful.DistinctValues.SCHEMA))
    assert sorted(((r.key, r.value) for r in found.collect()), key=str) == [("a", "x"), ("a", None)]


def test_nulls_count_as_rows_only(spark, tmp_path):
    schema = "key string, ts long, seq long, value double"
    rows = [("a", i, i, v) for i, v in enumerate([None, 10.1, None, 0.2, 30.0, 30.0])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")

    def run(processor):
        stream = replay.source(spark, f"{tmp_path}/t.parquet", schema, "ts")
        return replay.drain(stateful.run_keyed(stream, "key", processor, processor.SCHEMA)).collect()

    got = sorted((r.seq, None if r.total is None else float(r.total), r.low, r.high, r.n) for r in run(stateful.RollingAggregates()))
    assert got == [(0, None, None, None, 1), (1, 10.1, 10.1, 10.1, 2), (2, 10.1, 10.1, 10.1, 3), (3, 10.3, 0.2, 10.1, 4),
                   (4, 40.3, 0.2, 30.0, 5), (5, 70.3, 0.2, 30.0, 6)]
    assert [r.best for r in sorted(run(stateful.TopThree()))][-1] == "30.00,30.00,10.10"
    assert sorted((r.seq, r.previous, r.level) for r in run(stateful.LevelJump())) == [(1, 0.0, 10.1), (4, 0.2, 30.0)]
    windows = sorted((r.row_no, None if r.total is None else float(r.total), r.n) for r in run(stateful.CountWindow(2, 1)))
    assert windows == [(1, None, 1), (2, 10.1, 2), (3, 10.1, 2), (4, 0.2, 2), (5, 30.2, 2), (6, 60.0, 2)]


def test_a_table_is_laid_out_in_ranges_that_a_task_can_sort(spark, tmp_path):
    rows = spark.range(3_000_000).select(F.col("id").cast("timestamp").alias("ts"), "id", F.rand(1).alias("value"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    stream = replay.source(spark, f"{tmp_path}/t.parquet", "ts timestamp, id long, value double", "ts")
    counted = stream.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    found = sorted(replay.drain(counted, "complete").collect(), key=lambda r: r.a)
    assert len(found) > 2 and max(r.n for r in found) < 1_500_000
    assert sum(r.n for r in found) == 3_000_000 and all(x.b < y.a for x, y in zip(found, found[1:]))


class Held:
    """A state of one key."""

    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


class Handle:
    """What a processor asks of Spark for one key: its states and timers."""

    def __init__(self):
        self.timers = []
        self.registerTimer, self.deleteTimer = self.timers.append, self.timers.remove
        self.getValueState = self.getListState = lambda *args, **kwargs: Held()


KEYED = {
    "reminder": stateful.Reminder(timedelta(seconds=5), event_time=True),
    "visit": stateful.DailyVisit(),
    "bounce": stateful.Bounce(timedelta(days=9)),
    "alert": stateful.RisingAlert(timedelta(days=9)),
    "as_of": in_time.AsOf(),
    "match": in_time.MatchInOrder(timedelta(days=9)),
    "trigger": in_time.Trigger(10, timedelta(seconds=1)),
}


@pytest.mark.parametrize("name", KEYED)
def test_the_rows_of_a_key_set_one_timer(name):
    handle, processor = Handle(), KEYED[name]
    processor.init(handle)
    ts = [i * stateful.DAY_MS // 4 for i in range(20)]
    rows = pd.DataFrame({"ts": ts, "seq": range(20), "value": range(20), "entry": True, "shown": False, "is_data": True, "is_left": True})
    list(processor.handleInputRows(("a",), iter([rows.astype({"value": str}) if name == "as_of" else rows]), TimerValues(0, 0)))
    assert len(handle.timers) == 1


def test_rows_of_one_instant_each_have_a_reminder(spark, tmp_path):
    rows = [("a", ts, seq, datetime.fromtimestamp(ts / 1000, UTC)) for seq, ts in enumerate([1000, 1000, 2000, 3500, 60_000])]
    schema = "key string, ts long, seq long, event_time timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    stream = replay.source(spark, f"{tmp_path}/t.parquet", schema, "event_time").withWatermark("event_time", "0 seconds")
    reminder = stateful.Reminder(timedelta(seconds=5), event_time=True)
    found = replay.drain(stateful.run_keyed(stream.drop("event_time"), "key", reminder, reminder.SCHEMA, "EventTime")).collect()
    assert sorted(r.fired_at for r in found) == [6000, 6000, 7000, 8500]


def test_an_inner_join_ends_with_its_last_rows(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "checkpoint_root", lambda _: str(tmp_path))
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    registry.QUERIES["stream_interval_join"](spark, tables)
    (commits,) = tmp_path.glob("replay/*/progress/commits")
    assert [f.name for f in commits.iterdir() if f.name.isdigit()] == ["0"]
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == before
