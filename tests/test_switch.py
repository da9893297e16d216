"""What waits for a control value, and control values of many rows."""

from __future__ import annotations

import tracemalloc
from datetime import datetime, timedelta

import pandas as pd

from millrace import queries as registry
from millrace.queries import in_time as queries
from millrace.streaming import in_time, replay


class Held:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    """What a processor asks of Spark for one key."""

    def __init__(self):
        self.timers, self.state = [], Held()
        self.registerTimer, self.getValueState = self.timers.append, lambda *args, **kwargs: self.state


class Watermark:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def opened(**options):
    handle, processor = Handle(), in_time.AsOf(**options)
    processor.init(handle)
    return handle, processor


def rows(found):
    return pd.DataFrame(found, columns=["ts", "seq", "is_data", "value"])


def answers(parts):
    return [tuple(None if pd.isna(x) else x for x in row) for part in parts for row in part.itertuples(index=False)]


def test_texts_of_every_kind_wait(monkeypatch):
    monkeypatch.setattr(in_time.AsOf, "OUT", 2, raising=False)
    handle, processor = opened()
    data = [(5, 1, True, "é"), (6, 2, True, None), (7, 3, True, ""), (8, 4, True, "data \U0001f600"), (20, 5, True, "later"), (3, 6, True, "early")]
    marks = [(7, 13, False, "new"), (7, 12, False, "old"), (5, 11, False, "ü"), (6, 10, False, None), (30, 14, False, "far")]
    assert answers(processor.handleInputRows(("k",), iter([rows(data[:3]), rows(marks), rows(data[3:])]), Watermark(0))) == []
    assert handle.timers == [4]
    processor = in_time.AsOf()
    processor.init(handle)
    assert answers(processor.handleExpiredTimer(("k",), Watermark(20), None)) == [
        ("k", 6, None, "early"), ("k", 1, "ü", "é"), ("k", 2, None, None), ("k", 3, "new", ""), ("k", 4, "new", "data \U0001f600"),
    ]
    assert handle.timers == [4, 21]
    assert answers(processor.handleExpiredTimer(("k",), Watermark(20), None)) == []
    processor.init(handle)
    assert answers(processor.handleInputRows(("k",), iter([rows([(20, 15, False, "now"), (9, 16, True, "late")])]), Watermark(100))) == [
        ("k", 16, "new", "late"), ("k", 5, "now", "later"),
    ]


def test_a_key_with_many_rows_is_held_as_packed_columns():
    number = 20_000

    def feed(first):
        for start in range(first, first + 10 * number, number):
            yield pd.DataFrame({"ts": range(start, start + number), "seq": range(start, start + number), "is_data": [True, False] * (number // 2), "value": "1"})

    handle, processor = opened()
    tracemalloc.start()
    try:
        list(processor.handleInputRows(("k",), feed(0), Watermark(0)))
        got = sum(len(part) for part in processor.handleInputRows(("k",), feed(10 * number), Watermark(10 * number)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == 5 * number
    assert peak < 40e6
    assert sum(map(len, handle.state.value)) < 21 * 10 * number + 100


def test_a_switch_in_small_micro_batches_sees_the_values_of_the_microsecond(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "WAITING_ROWS", 10, raising=False)
    monkeypatch.setattr(replay, "checkpoint_root", lambda _: str(tmp_path / "runs"))
    start = datetime(2024, 1, 1)
    events = [
        (i, start + timedelta(microseconds=300 * i), 1, "signup" if i % 5 == 3 else "view", 1.0, None if i % 4 == 0 else f"p{i}") for i in range(80)
    ]
    table = spark.createDataFrame(events[::-1], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    table.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want, mode = {}, None
    for i, *_, in events:
        mode = i % 3 if i % 5 == 3 else mode
        want[i] = {0: "config_0", 1: "config_1"}.get(mode, "config_other")
    found = registry.QUERIES["stream_switch"](spark, str(tmp_path)).collect()
    assert len(found) == 80 and {r.event_id: r.config for r in found} == want
    (progress,) = tmp_path.glob("runs/replay/*/progress/commits")
    assert sum(f.name.isdigit() for f in progress.iterdir()) >= 8


def test_a_micro_batch_is_bounded_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "checkpoint_root", lambda _: str(tmp_path / "runs"))
    spark.range(10_000).selectExpr("cast(id as timestamp) as ts", "id").write.parquet(f"{tmp_path}/t.parquet")
    stream = replay.source(spark, f"{tmp_path}/t.parquet", "ts timestamp, id long", "ts", "1000 days", batch_rows=2_000)
    assert replay.drain(stream).count() == 10_001
    (folder,) = tmp_path.glob("runs/replay/*/rows")
    sizes = [spark.read.parquet(str(part)).count() for part in folder.glob("_batch=*")]
    assert len(sizes) >= 5 and max(sizes) < 4_000
