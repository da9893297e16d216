"""Versions as of a time, matching that consumes, and processors that act by the watermark of their query."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frames import skewed
from millrace.operators import joins, late, versions, windows
from millrace.streaming import in_time, jobs, replay, stateful

T0 = datetime(2024, 1, 1)
MS0 = 1_704_067_200_000


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


# -- versions -------------------------------------------------------------------------------------------------

CHANGES = [
    ("a", at(0), 1, "one", False), ("a", at(10), 2, "lost", False), ("a", at(10), 3, "two", False), ("a", at(20), 4, None, True),
    ("a", at(30), 5, None, False), ("b", at(5), 1, "bee", False), (None, at(0), 1, "nobody", False), ("b", None, 2, "never", False),
]
CHANGE = "id string, since timestamp_ntz, seq long, value string, gone boolean"


def test_intervals(spark):
    changes = spark.createDataFrame(CHANGES, CHANGE)
    found = versions.intervals(changes, ["id"], "since", ["seq"], F.col("gone")).select("id", "value", "valid_from", "valid_to")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        ("a", "one", at(0), at(10)), ("a", "two", at(10), at(20)), ("a", None, at(30), None), ("b", "bee", at(5), None),
        (None, "nobody", at(0), None),
    ], key=str)


FACTS = [("a", at(-1), 1), ("a", at(0), 2), ("a", at(9.99), 3), ("a", at(10), 4), ("a", at(20), 5), ("a", at(31), 6), ("b", at(6), 7),
         ("c", at(6), 8), (None, at(6), 9), ("a", None, 10), ("b", at(5), 11), ("b", at(4.9), 12)]


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_facts_see_the_version_of_their_time(spark, hot_rows):
    facts = spark.createDataFrame(FACTS, "k string, ts timestamp_ntz, no long")
    found = versions.as_of_join(
        facts, spark.createDataFrame(CHANGES, CHANGE), {"k": "id"}, "ts", "since", ["no"], ["seq"],
        {"value": "name", "seq": "version"}, F.col("gone"), hot_rows,
    )
    assert found.columns == ["k", "ts", "no", "name", "version"]
    assert {r.no: (r.name, r.version) for r in found.collect()} == {
        1: (None, None), 2: ("one", 1), 3: ("one", 1), 4: ("two", 3), 5: (None, None), 6: (None, 5), 7: ("bee", 1), 8: (None, None),
        9: (None, None), 10: (None, None), 11: ("bee", 1), 12: (None, None),
    }


def test_a_hot_key_is_cut(spark):
    rows = spark.createDataFrame(skewed(), "k string, ts timestamp_ntz, no long, level int")
    facts, changes = rows.filter("no % 2 = 0"), rows.filter("no % 2 = 1").withColumnsRenamed({"k": "id", "ts": "since", "no": "seq"})
    args = ({"k": "id"}, "ts", "since", ["no"], ["seq"], {"seq": "version"})
    whole, cut = (versions.as_of_join(facts, changes, *args, hot_rows=hot) for hot in (None, 20))
    assert "_chunk" in cut._jdf.queryExecution().toString() and "_chunk" not in whole._jdf.queryExecution().toString()
    assert sorted((r.no, r.version) for r in cut.collect()) == sorted((r.no, r.version) for r in whole.collect())


# -- matching -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_three_payments_and_two_receipts(spark, hot_rows):
    payments = spark.createDataFrame([("t", 1, 10), ("t", 2, 20), ("t", 3, 30), (None, 4, 0), ("u", 5, 0)], "tx string, pay long, pts long")
    receipts = spark.createDataFrame([("t", 7, 5), ("t", 6, 1), (None, 8, 0), ("v", 9, 0)], "rx string, rec long, rts long")
    found = joins.match_in_order(payments, receipts, {"tx": "rx"}, ["pts", "pay"], ["rts", "rec"], hot_rows)
    assert sorted(((r.pay, r.rec, r.match_no, r.status) for r in found.collect()), key=str) == sorted([
        (1, 6, 1, "matched"), (2, 7, 2, "matched"), (3, None, 3, "left_only"), (4, None, None, "left_only"), (5, None, 1, "left_only"),
        (None, 8, None, "right_only"), (None, 9, 1, "right_only"),
    ], key=str)


def feed(spark, tmp_path, rows, schema, name):
    """One micro-batch for each list of rows."""
    path = f"{tmp_path}/{name}.parquet"
    numbered = [(batch, place, *row) for batch, part in enumerate(rows) for place, row in enumerate(part)]
    full = f"batch long, place long, {schema}"
    spark.createDataFrame(numbered, full).repartition(3).write.parquet(path)
    return replay.in_batches(spark, path, full, F.col("batch"), "place")


def marked(df, delay="0 seconds"):
    return df.withColumn("event_time", F.timestamp_millis(F.col("ms"))).withWatermark("event_time", delay).withColumn(
        "ts", in_time.plain_time("event_time"))


def run(df, processor, columns):
    return replay.drain(stateful.run_keyed(df.select(columns), "key", processor, processor.SCHEMA, "EventTime"))


def test_matching_on_a_stream_consumes(spark, tmp_path):
    rows = [
        [("t", MS0, 1, True), ("t", MS0 + 1, 2, True)], [("t", MS0 + 2, 6, False)], [("t", MS0 + 3, 3, True), ("u", MS0, 9, False)],
        [("t", MS0 + 4, 7, False)], [("z", MS0 + 10_000, 10, True)], [("z", MS0 + 20_000, 11, False)], [("y", MS0 + 90_000, 12, True)],
    ]
    stream = marked(feed(spark, tmp_path, rows, "key string, ms long, seq long, is_left boolean", "match"))
    found = run(stream, in_time.MatchInOrder(timedelta(seconds=5)), ["key", "ts", "seq", "is_left"])
    assert sorted(((r.key, r.match_no, r.left_seq, r.right_seq, r.status) for r in found.collect()), key=str) == sorted([
        ("t", 1, 1, 6, "matched"), ("t", 2, 2, 7, "matched"), ("t", None, 3, None, "left_only"), ("u", None, None, 9, "right_only"),
        ("z", None, 10, None, "left_only"), ("z", None, None, 11, "right_only"),
    ], key=str)


# -- late rows ------------------------------------------------------------------------------------------------

# (seq, minutes) in the order of arrival, a micro-batch each.
ARRIVALS = [(1, 5), (2, 50), (3, 61), (4, 55), (5, 71), (6, 58), (7, 30), (8, 130), (9, 59), (10, 62), (11, 131), (12, 61), (13, 132), (14, 20),
            (15, 250), (16, 119), (17, 190), (18, 251), (19, 185), (20, 320), (21, 321)]
LATE = ("1 hour", timedelta(minutes=10), timedelta(minutes=60))


def late_stream(spark, tmp_path, name, per_batch=1):
    rows = [("k", MS0 + 60_000 * minute, seq) for seq, minute in ARRIVALS]
    batches = [rows[i : i + per_batch] for i in range(0, len(rows), per_batch)]
    stream = marked(feed(spark, tmp_path, batches, "key string, ms long, seq long", name), "10 minutes")
    return stream.withColumn("last", in_time.window_last("event_time", "1 hour"))


def classified(spark):
    rows = spark.createDataFrame([(seq, at(minute)) for seq, minute in ARRIVALS], "seq long, ts timestamp_ntz")
    return late.classify_late(rows, "ts", ["seq"], *LATE)


def test_rows_in_batches_of_one_are_judged_as_in_batch(spark, tmp_path):
    rows = late_stream(spark, tmp_path, "judge").select("key", "seq", "ts", "last")
    judge = in_time.Judge(["seq", "ts"], LATE[2])
    found = replay.drain(stateful.run_keyed(rows, "key", judge, "seq long, ts long, status string", "EventTime")).collect()
    want = {r.seq: r.status for r in classified(spark).collect()}
    assert set(want.values()) == {"on_time", "refire", "too_late"}
    assert {r.seq: r.status for r in found} == want


def test_firings_equal_the_late_windows(spark, tmp_path):
    found = run(late_stream(spark, tmp_path, "fires"), in_time.LateWindows(LATE[2], ("seq",)), ["key", "ts", "seq", "last"]).collect()
    judged = classified(spark)
    want = {r.window_start: r for r in late.window_fires(judged, "ts", "1 hour", []).collect()}
    for start, row in want.items():
        last = int((start - T0).total_seconds() * 1000) + MS0 + 3_600_000 - 1
        mine = [r for r in found if r.last == last]
        fires = [r.n for r in mine if r.kind == "fire"]
        again = sorted((r.seq, r.n) for r in mine if r.kind == "refire")
        closed = start + timedelta(hours=1) <= at(321 - 10)
        assert fires == ([row.first_fire] if row.first_fire and closed else [])
        assert [n for _, n in again] == list(range(row.first_fire + 1, row.last_fire + 1))
        assert sum(r.kind == "too_late" for r in mine) == row.side_output
    assert sum(r.side_output for r in want.values()) and any(r.last_fire > r.first_fire for r in want.values())


def test_late_job_keeps_all_columns_and_writes_only_topics(spark, tmp_path):
    house = jobs.Warehouse(spark, str(tmp_path / "root"), str(tmp_path / "cp"))
    rows = [[("a", MS0 + 60_000 * minute, seq)] for seq, minute in ARRIVALS]
    data = feed(spark, tmp_path, rows, "device string, ms long, seq long", "late_job")
    data = data.withColumn("seen_at", F.timestamp_millis("ms")).drop("batch", "place")
    query = jobs.late_job(house, data, "seen_at", LATE[0], LATE[1], LATE[2], "main", "side")
    query.awaitTermination(180)
    assert query.exception() is None
    got = {topic: [json.loads(r.value) for r in house.read(topic, False).collect()] for topic in ("main", "side")}
    want = {r.seq: r.status for r in classified(spark).collect()}
    assert {r["seq"]: r["status"] for part in got.values() for r in part} == want
    assert {r["status"] for r in got["side"]} == {"too_late"}
    assert set(got["main"][0]) == {"device", "ms", "seq", "seen_at", "status"}
    minutes = dict(ARRIVALS)
    assert all(r["seen_at"].startswith(at(minutes[r["seq"]]).isoformat()) for r in got["main"])
    assert sorted(p.name for p in (tmp_path / "root").iterdir()) == ["topics"]


# -- control --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("lag", [0, 3])
def test_control_meets_rows_by_time_whatever_the_batches(spark, tmp_path, lag):
    """The control feed may come batches later than the data; rows wait for it."""
    data = [[(i, MS0 + 1000 * i + 500, None)] for i in range(8)] + [[]] * lag + [[(99, MS0 + 10**7, None)]]
    control = [[]] * lag + [[(i, MS0 + 2000 * i, str(i))] for i in range(1, 4)] + [[(98, MS0 + 10**7, "end")]]
    schema = "seq long, ms long, value string"
    house = jobs.Warehouse(spark, str(tmp_path / "root"), str(tmp_path / "cp"))

    def timed(rows, name):
        return feed(spark, tmp_path, [r for r in rows if r] if name == "c" and not lag else rows, schema, name).withColumn(
            "seen_at", F.timestamp_millis("ms")).select("seq", "seen_at", "value")

    query = jobs.control_job(house, timed(data, "d"), timed(control, "c"), "seen_at", "value", "seq", "switched")
    query.awaitTermination(180)
    assert query.exception() is None
    rows = [json.loads(r.value) for r in house.read("switched", False).collect()]
    assert {r["seq"]: r.get("mode") for r in rows} == {0: None, 1: None, 2: "1", 3: "1", 4: "2", 5: "2", 6: "3", 7: "3"}


# -- triggers -------------------------------------------------------------------------------------------------

TRIGGERS = [(3, None), (None, timedelta(seconds=10)), (2, timedelta(seconds=10))]


@pytest.mark.parametrize("every, span", TRIGGERS)
def test_triggers_on_streams_equal_batch(spark, tmp_path, every, span):
    times = [("a", 1), ("a", 2), ("b", 3), ("a", 9), ("a", 10), ("b", 25), ("a", 31), ("a", 31), ("b", 31), ("a", 47)]
    rows = [(key, MS0 + 1000 * second, seq) for seq, (key, second) in enumerate(times)]
    batches = [rows[:4], rows[4:5], rows[5:], [("z", MS0 + 10**7, 100)]]
    stream = marked(feed(spark, tmp_path, batches, "key string, ms long, seq long", "trigger"))
    found = run(stream, in_time.Trigger(every, span), ["key", "ts", "seq"])
    table = spark.createDataFrame(rows, "key string, ms long, seq long").withColumn("ts", F.timestamp_millis("ms"))
    want = windows.global_window_count_or_time(table, ["key"], "ts", ["ts", "seq"], every, span)
    got = [tuple(r) for r in found.collect() if r.key != "z"]
    assert sorted(got) == sorted(map(tuple, want.collect()))


def test_a_window_without_trigger_is_refused(spark):
    with pytest.raises(ValueError):
        in_time.Trigger()
    with pytest.raises(ValueError):
        windows.global_window_count_or_time(spark.range(1), ["id"], "id", ["id"], None, None)
