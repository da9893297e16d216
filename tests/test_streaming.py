"""Streaming forms against their batch forms, on small inputs split into several files."""

from __future__ import annotations

import json
import subprocess
import sys
import time
from datetime import timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from frames import ROWS_B
from millrace import schemas
from millrace.operators import joins, windows
from millrace.plans import dwd, dwm, dws
from millrace.sinks import dimensions, marts, topics as topic_sink
from millrace.streaming import jobs, stateful

T0 = 1_704_067_200_000


def page(mid, ts, page_id="home", last=None, is_new="0", item=None, item_type=None, displays=None, during=100):
    log = {
        "common": {"mid": mid, "ar": "a", "ch": "c", "vc": "v", "is_new": is_new},
        "page": {"page_id": page_id, "last_page_id": last, "item": item, "item_type": item_type, "during_time": during},
        "ts": T0 + ts,
    }
    if displays:
        log["displays"] = displays
    return json.dumps({k: v for k, v in log.items()})


def start(mid, ts, is_new="0"):
    return json.dumps({"common": {"mid": mid, "is_new": is_new}, "start": {"entry": "icon"}, "ts": T0 + ts})


DAY = 24 * 3600 * 1000
SHOWN = [{"item": "7", "item_type": "sku_id"}, {"item": "sale", "item_type": "activity_id"}]
LOG = [
    start("1", 0, "1"),
    page("1", 1_000, is_new="1"),
    page("1", 5_000, "good_detail", "home", item="7", item_type="sku_id"),
    page("2", 6_000, is_new="1"),
    page("2", 16_000, "search", "home", item="red shoes Red", item_type="keyword"),
    page("3", 20_000, is_new="1", displays=SHOWN),
    page("3", 29_999, "list", "home"),
    page("2", 40_000),
    page("1", DAY - 1_000),
    page("1", DAY + 1_000),
    page("4", DAY + 2_000, is_new="1"),
    page("4", DAY + 60_000, "list", "home"),
]


def house_with(spark, tmp_path, feeds: dict[str, list[list[str]]], **options) -> jobs.Warehouse:
    """A warehouse whose topics hold the given files of values."""
    house = jobs.Warehouse(spark, str(tmp_path / "root"), str(tmp_path / "checkpoints"), **options)
    for topic, files in feeds.items():
        seq = 0
        for number, values in enumerate(files):
            rows = [(None, v, seq + i, topic) for i, v in enumerate(values)]
            seq += len(values)
            records = spark.createDataFrame(rows, "key string, value string, seq long, topic string").coalesce(1)
            topic_sink.append_folder(records, house.topic_root, 1000 + number)
    return house


def finish(query):
    query.awaitTermination(180)
    assert query.exception() is None and not query.isActive


def log_rows(house, topic):
    return dwd.parse_log(house.read(topic, streaming=False).select("seq", "value"))


def seqs(df):
    return sorted(r.seq for r in df.collect())


@pytest.fixture(scope="module")
def behaviour(spark, tmp_path_factory):
    """The behaviour jobs run once over three files, one per micro-batch."""
    path = tmp_path_factory.mktemp("behaviour")
    house = house_with(spark, path, {schemas.ODS_LOG: [LOG[:5], LOG[5:9], LOG[9:]]}, files_per_batch=1)
    finish(jobs.log_job(house))
    finish(jobs.unique_visit_job(house))
    finish(jobs.user_jump_job(house))
    finish(jobs.visitor_mart_job(house, "1 day", "2 days"))
    finish(jobs.keyword_mart_job(house, "1 hour"))
    raw = spark.createDataFrame([(i, v) for i, v in enumerate(LOG)], "seq long, value string")
    return house, dwd.repair_new_visitors(dwd.parse_log(raw))


def test_log_split(behaviour):
    house, log = behaviour
    assert seqs(log_rows(house, schemas.DWD_START)) == seqs(dwd.start_log(log)) == [0]
    assert seqs(log_rows(house, schemas.DWD_PAGE)) == seqs(dwd.page_log(log))
    stream = {r.seq: r.common.is_new for r in log_rows(house, schemas.DWD_PAGE).collect()}
    assert stream == {r.seq: r.common.is_new for r in dwd.page_log(log).collect()}
    assert stream[1] == "0"
    shown = [json.loads(r.value) for r in house.read(schemas.DWD_DISPLAY, streaming=False).collect()]
    assert sorted(d["item"] for d in shown) == ["7", "sale"] and {d["page_id"] for d in shown} == {"home"}


def test_unique_visits(behaviour):
    house, log = behaviour
    pages = dwd.page_log(log)
    assert seqs(log_rows(house, schemas.DWM_UNIQUE_VISIT)) == seqs(dwm.unique_visits(pages)) == [1, 3, 5, 9, 10]


def test_bounces(behaviour):
    house, log = behaviour
    # The next page after exactly ten seconds is too late, a millisecond earlier is in time.
    batch = seqs(dwm.user_jumps(dwd.page_log(log), close_open=False))
    assert batch == [3, 7, 9, 10]
    assert seqs(log_rows(house, schemas.DWM_USER_JUMP)) == batch


def test_visitor_mart(behaviour):
    house, log = behaviour
    pages = dwd.page_log(log)
    facts = dws.visitor_facts(pages, dwm.unique_visits(pages), dwm.user_jumps(pages, close_open=False))
    want = dws.visitor_stats(facts, "1 day", F.lit(0)).drop("ts")
    got = marts.mart(house.spark, house.root, "visitor_stats").read().select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_one_pass_visitor_facts_equal_layered_ones(behaviour):
    house, log = behaviour
    raw = house.spark.createDataFrame([(i, v) for i, v in enumerate(LOG)], "seq long, value string")
    pages = dwd.page_log(log)
    layered = dws.visitor_facts(pages, dwm.unique_visits(pages), dwm.user_jumps(pages))
    fused = dws.visitor_facts_from_log(dwd.parse_log(raw))
    one, two = (dws.visitor_stats(f, "2 seconds", F.lit(0)).collect() for f in (layered, fused))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_both_visitor_marts_agree_on_lines_that_are_neither_start_nor_page(spark):
    odd = json.dumps({"common": {"mid": "1", "ar": "a", "ch": "c", "vc": "v", "is_new": "0"}, "ts": T0 + 1_500})
    both = json.dumps({**json.loads(page("1", 1_700)), "start": {"entry": "icon"}})
    lines = [*LOG, odd, both, "{broken", "", json.dumps({"ts": T0}), json.dumps({"page": {"page_id": "home"}, "ts": T0 + 1})]
    raw = spark.createDataFrame(list(enumerate(lines)), "seq long, value string")
    log = dwd.parse_log(raw)
    pages = dwd.page_log(dwd.repair_new_visitors(log))
    layered = dws.visitor_facts(pages, dwm.unique_visits(pages), dwm.user_jumps(pages))
    one, two = (dws.visitor_stats(f, "2 seconds", F.lit(0)).collect() for f in (layered, dws.visitor_facts_from_log(log)))
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, two), key=str)
    n = len(LOG)
    rejected = {r.seq: r.readable for r in dwd.rejected_log(log).collect()}
    assert rejected == {n: True, n + 2: False, n + 3: False, n + 4: True}
    assert dwd.start_log(log).count() + pages.count() + len(rejected) == len(lines)


def test_keyword_mart(behaviour):
    house, _ = behaviour
    got = marts.mart(house.spark, house.root, "keyword_stats").read()
    assert {(r.keyword, r.ct, r.source) for r in got.collect()} == {("red", 2, "SEARCH"), ("shoes", 1, "SEARCH")}


def change(table, kind, data):
    return json.dumps({"table": table, "type": kind, "data": data})


def order(key, time, user=1, amount="10.00"):
    return {
        "id": key, "province_id": 3, "user_id": user, "order_status": "O", "total_amount": amount, "create_time": time,
    }


def line(key, order_id, time, sku=7, amount="5.00"):
    return {
        "id": key, "order_id": order_id, "sku_id": sku, "sku_num": 2, "order_price": amount,
        "split_total_amount": amount, "create_time": time,
    }


def test_change_feed_to_province_mart(spark, tmp_path):
    text = lambda record: {k: str(v) for k, v in record.items()}
    feed = [
        [
            change("user_info", "bootstrap-insert", {"id": "1", "birthday": "2000-01-01", "gender": "F", "junk": "x"}),
            change("user_info", "update", {"id": "1", "birthday": "1990-01-01", "gender": "F"}),
            change("order_info", "insert", text(order(1, "2024-01-01 10:00:00"))),
            change("order_detail", "insert", text(line(11, 1, "2024-01-01 10:00:05"))),
            change("order_detail", "insert", text(line(12, 1, "2024-01-01 09:59:55"))),
            change("order_detail", "insert", text(line(13, 1, "2024-01-01 10:00:06"))),
        ],
        [
            change("order_info", "insert", text(order(2, "2024-01-01 10:01:00", user=99))),
            change("order_detail", "insert", text(line(21, 2, "2024-01-01 10:01:00"))),
            change("payment_info", "insert", {"id": "5", "order_id": "1", "user_id": "1", "total_amount": "10.00",
                                              "create_time": "2024-01-01 10:15:00"}),
            change("payment_info", "insert", {"id": "6", "order_id": "2", "user_id": "1", "total_amount": "10.00",
                                              "create_time": "2024-01-01 10:16:01"}),
            change("unknown", "insert", {"id": "1"}),
            json.dumps({"table": "order_info", "type": "insert", "data": {}}),
        ],
    ]
    config = spark.createDataFrame(
        [
            ("user_info", "insert", "hbase", "dim_user_info", "id,birthday,gender", None, None),
            ("user_info", "update", "hbase", "dim_user_info", "id,birthday,gender", "id", None),
            ("order_info", "insert", "kafka", "dwd_order_info", "", None, None),
            ("order_detail", "insert", "kafka", "dwd_order_detail", None, None, None),
            ("payment_info", "insert", "kafka", "dwd_payment_info", "", None, None),
        ],
        schemas.ROUTE,
    )
    house = house_with(spark, tmp_path, {schemas.ODS_CHANGES: feed}, files_per_batch=1)
    finish(jobs.change_job(house, lambda: config))
    table = dimensions.dimensions(spark, house.root)
    columns = dimensions.columns_of(config)["DIM_USER_INFO"]
    assert columns == ["id", "birthday", "gender"]
    assert [tuple(r) for r in dimensions.dimension(table, "dim_user_info", columns).collect()] == [("1", "1990-01-01", "F")]

    def dims():
        users = dimensions.dimension(table, "dim_user_info", columns).withColumn("id", F.col("id").cast("long"))
        provinces = spark.createDataFrame(
            [(3, "North", "03", "N-3", "X-3")], "id long, name string, area_code string, iso_code string, iso_3166_2 string"
        )
        products = spark.createDataFrame(
            [(7, "shoe", 1, 2, "c", "spu", "tm", "cat")],
            "id long, sku_name string, spu_id long, tm_id long, category3_id string, spu_name string, tm_name string,"
            "category3_name string",
        )
        return users, provinces, products

    finish(jobs.order_wide_job(house, dims, F.lit("2024-01-01").cast("date")))
    wide = {json.loads(r.value)["detail_id"]: json.loads(r.value) for r in house.read(schemas.DWM_ORDER_WIDE, False).collect()}
    assert sorted(wide) == [11, 12, 21]
    assert wide[11]["user_age"] == 34 and wide[11]["sku_name"] == "shoe"
    assert "user_age" not in wide[21] and wide[21]["province_name"] == "North"

    finish(jobs.payment_wide_job(house))
    paid = [json.loads(r.value) for r in house.read(schemas.DWM_PAYMENT_WIDE, False).collect()]
    assert sorted((p["payment_id"], p["detail_id"]) for p in paid) == [(5, 11), (5, 12)]

    finish(jobs.province_mart_job(house, "1 hour"))
    (row,) = marts.mart(spark, house.root, "province_stats").read().collect()
    assert (row.stt, row.province_name, float(row.order_amount), row.order_count) == ("2024-01-01 10:00:00", "North", 15.0, 3)


# -- stateful processors --------------------------------------------------------------------------------------


def keyed_stream(spark, tmp_path, rows, name, files=2):
    """Rows (key, ts in ms, value) as a stream of several files, one per micro-batch."""
    path = str(tmp_path / f"{name}_in")
    step = -(-len(rows) // files)
    numbered = [(k, t, i, float(v)) for i, (k, t, v) in enumerate(rows)]
    for part in range(0, len(rows), step):
        frame = spark.createDataFrame(numbered[part : part + step], "key string, ts long, seq long, value double")
        frame.coalesce(1).write.mode("append").parquet(path)
    reader = spark.readStream.schema("key string, ts long, seq long, value double").option("maxFilesPerTrigger", 1)
    return reader.parquet(path).withColumn("event_time", F.timestamp_millis("ts"))


def drain(stream, tmp_path, name, mode="append"):
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode)
    finish(writer.option("checkpointLocation", str(tmp_path / f"{name}_cp")).trigger(availableNow=True).start())
    return sorted(tuple(r) for r in stream.sparkSession.table(name).collect())


SENSORS = [(i, t, v) for i, t, v in sorted(ROWS_B, key=lambda r: r[1])]


def test_rolling_aggregates(spark, tmp_path):
    stream = keyed_stream(spark, tmp_path, SENSORS, "roll")
    out = drain(
        stateful.run_keyed(stream, "key", stateful.RollingAggregates(), stateful.RollingAggregates.SCHEMA), tmp_path, "roll"
    )
    assert [(r[0], r[3], r[7]) for r in out] == [
        ("sensor_1", 20.0, 20.0), ("sensor_1", 70.0, 35.0), ("sensor_1", 120.0, 40.0),
        ("sensor_2", 10.0, 10.0), ("sensor_2", 40.0, 20.0),
    ]
    assert [r[2] for r in out] == [0, 0, 0, 1, 1]


def test_top_three_distinct_jumps_and_count_windows(spark, tmp_path):
    rows = [("s", T0 + i, v) for i, v in enumerate([10, 40, 20, 30, 5, 40, 41])]
    stream = keyed_stream(spark, tmp_path, rows, "many", files=3)
    top = drain(stateful.run_keyed(stream, "key", stateful.TopThree(), stateful.TopThree.SCHEMA), tmp_path, "top")
    assert [r[2] for r in top] == [
        ",".join(f"{v}.00" for v in best)
        for best in ([10], [40, 10], [40, 20, 10], [40, 30, 20], [40, 30, 20], [40, 40, 30], [41, 40, 40])
    ]
    unlike = drain(
        stateful.run_keyed(stream, "key", stateful.DistinctValues(), stateful.DistinctValues.SCHEMA), tmp_path, "unlike"
    )
    assert sorted(r[1] for r in unlike) == ["10.0", "20.0", "30.0", "40.0", "41.0", "5.0"]
    jumps = drain(stateful.run_keyed(stream, "key", stateful.LevelJump(), stateful.LevelJump.SCHEMA), tmp_path, "jumps")
    assert [r[1] for r in jumps] == [0, 1, 2, 3, 4, 5]
    tumbling = stateful.run_keyed(stream, "key", stateful.CountWindow(3, 3), stateful.CountWindow.SCHEMA)
    assert [r[1:] for r in drain(tumbling, tmp_path, "tumbling")] == [(3, 70.0, 3), (6, 75.0, 3)]
    sliding = stateful.run_keyed(stream, "key", stateful.CountWindow(3, 2), stateful.CountWindow.SCHEMA)
    assert [r[3] for r in drain(sliding, tmp_path, "sliding")] == [2, 3, 3]


def test_timers(spark, tmp_path):
    rows = [("a", T0, 1), ("a", T0 + 1000, 2), ("b", T0, 5), ("b", T0 + 2000, 4), ("z", T0 + 60_000, 1), ("z", T0 + 61_000, 0)]
    rows.sort(key=lambda r: r[1])
    stream = keyed_stream(spark, tmp_path, rows, "timers", files=3).withWatermark("event_time", "0 seconds")
    alert = stateful.RisingAlert(timedelta(seconds=5))
    out = drain(stateful.run_keyed(stream, "key", alert, alert.SCHEMA, "EventTime"), tmp_path, "alerts")
    assert out == [("a", T0)]
    reminder = stateful.Reminder(timedelta(seconds=5), event_time=True)
    fired = drain(stateful.run_keyed(stream, "key", reminder, reminder.SCHEMA, "EventTime"), tmp_path, "fired")
    assert [r for r in fired if r[0] != "z"] == [("a", T0 + 5000), ("a", T0 + 6000), ("b", T0 + 5000), ("b", T0 + 7000)]


def test_late_rows(spark, tmp_path):
    rows = [("a", T0, 1), ("a", T0 + 20_000, 2), ("a", T0 + 9_000, 3), ("a", T0 + 1_000, 4)]
    house = jobs.Warehouse(spark, str(tmp_path / "root"), str(tmp_path / "cp"))
    stream = keyed_stream(spark, tmp_path, rows, "late", files=2)
    late_args = ("event_time", "5 seconds", timedelta(seconds=3), timedelta(seconds=8), "main", "side")
    finish(jobs.late_job(house, stream, *late_args))
    side = [json.loads(r.value)["seq"] for r in house.read("side", False).collect()]
    main = {json.loads(r.value)["seq"]: json.loads(r.value)["status"] for r in house.read("main", False).collect()}
    # The watermark after the first file is 17 s: the window ending at 10 s still refires, the one ending at 5 s is gone.
    assert side == [3] and main == {0: "on_time", 1: "on_time", 2: "refire"}


def test_control_switch(spark, tmp_path):
    house = jobs.Warehouse(spark, str(tmp_path / "root"), str(tmp_path / "cp"))
    stream = keyed_stream(spark, tmp_path, [("a", T0, 1), ("b", T0 + 1, 2)], "switch")
    control = spark.createDataFrame([(1, "0"), (2, "1")], "ts long, value string")
    finish(jobs.switch_job(house, stream, lambda: control, "switched"))
    assert {json.loads(r.value)["mode"] for r in house.read("switched", False).collect()} == {"1"}


def test_repeated_batches_replace_themselves(spark, tmp_path):
    house = jobs.Warehouse(spark, str(tmp_path / "root"), str(tmp_path / "cp"))
    table = marts.mart(spark, house.root, "keyword_stats")
    row = ("2024-01-01 00:00:00", "2024-01-01 01:00:00", "shoe", "SEARCH", 5, 10)
    frame = spark.createDataFrame([row], marts.KEYWORD_MART)
    for _ in range(2):
        marts.store(table, frame, 0)
        house.write(frame, "t", 0)
    marts.store(table, frame.withColumn("ct", F.lit(9).cast("long")).withColumn("ts", F.lit(11).cast("long")), 1)
    assert [(r.ct, r.ts) for r in table.read().collect()] == [(9, 11)]
    assert house.read("t", False).count() == 1
    table.compact()
    marts.store(table, frame.withColumn("keyword", F.lit("hat")), 2)
    assert sorted(r.keyword for r in table.read().collect()) == ["hat", "shoe"]
    assert [(r.ct, r.ts) for r in table.read().filter("keyword = 'shoe'").collect()] == [(9, 11)]


def test_state_that_expires_by_the_clock(spark, tmp_path):
    house = house_with(spark, tmp_path, {schemas.DWD_PAGE: [LOG[1:]]})
    query = jobs.unique_visit_job(house, by_clock=True)
    try:
        deadline, got = time.time() + 120, []
        while time.time() < deadline and len(got) < 5:
            time.sleep(1)
            got = seqs(log_rows(house, schemas.DWM_UNIQUE_VISIT)) if query.lastProgress else []
    finally:
        query.stop()
    assert got == [0, 2, 4, 8, 9]


def test_unique_visits_by_event_time(spark, tmp_path):
    house = house_with(spark, tmp_path, {schemas.DWD_PAGE: [LOG[1:9], LOG[9:]]}, files_per_batch=1)
    pages = dwd.parse_log(house.read(schemas.DWD_PAGE).select("seq", "value"))
    out = drain(jobs.unique_visits_by_event_time(pages), tmp_path, "event_time_visits")
    assert sorted((r[0], str(r[1])) for r in out) == [
        ("1", "2024-01-01"), ("1", "2024-01-02"), ("2", "2024-01-01"), ("3", "2024-01-01"), ("4", "2024-01-02"),
    ]


def test_reconcile_streams(spark, tmp_path):
    def feed(rows, name):
        path = str(tmp_path / name)
        for part in rows:
            spark.createDataFrame(part, f"{name}_tx string, {name}_ms long").coalesce(1).write.mode("append").parquet(path)
        reader = spark.readStream.schema(f"{name}_tx string, {name}_ms long").option("maxFilesPerTrigger", 1)
        timed = reader.parquet(path).withColumn(f"{name}_ts", F.timestamp_millis(f"{name}_ms"))
        return timed.withWatermark(f"{name}_ts", "0 seconds")

    pay = feed([[("t1", T0), ("t2", T0 + 1000)], [("t9", T0 + 600_000)]], "pay")
    receipt = feed([[("t1", T0 + 5000), ("t3", T0)], [("t9", T0 + 600_000)]], "rec")
    both = joins.reconcile_in_time(pay, receipt, {"pay_tx": "rec_tx"}, "pay_ts", "rec_ts", timedelta(seconds=60))
    out = drain(both.select("status", F.coalesce("pay_tx", "rec_tx").alias("tx")), tmp_path, "reconciled")
    assert out == [("left_only", "t2"), ("matched", "t1"), ("matched", "t9"), ("right_only", "t3")]


def test_session_windows_on_a_stream(spark, tmp_path):
    rows = [("a", T0, 1), ("a", T0 + 10_000, 2), ("a", T0 + 25_000, 3), ("b", T0 + 900_000, 1)]
    stream = keyed_stream(spark, tmp_path, rows, "sessions").withWatermark("event_time", "0 seconds")
    gap = F.when(F.col("value") == 2, "14 seconds").otherwise("10 seconds")
    out = windows.session_window(stream, "event_time", gap, ["key"], {"n": F.count(F.lit(1))})
    got = drain(out.select("key", F.unix_millis("session_start"), F.unix_millis("session_end"), "n"), tmp_path, "sessions")
    assert got == [("a", T0, T0 + 24_000, 2), ("a", T0 + 25_000, T0 + 35_000, 1)]


def test_executors_need_not_have_the_package(tmp_path):
    data = cloudpickle.dumps(stateful.LevelJump()).hex()
    code = f"import pickle; print(type(pickle.loads(bytes.fromhex('{data}'))).__name__)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert done.stdout.strip() == "LevelJump"
