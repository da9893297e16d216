"""Readers and writers on small files."""

from __future__ import annotations

import json
import os
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from frames import SENSOR
from millrace import schemas
from millrace.operators import sketches
from millrace.plans import dwd, serving
from millrace.sinks import dimensions, marts, upsert
from millrace.sinks import topics as topic_sink
from millrace.sources import landing, readers
from millrace.sources import topics as topic_source
from millrace.sources.sensor_source import SensorDataSource


def test_collection_text_and_csv(spark, tmp_path):
    assert readers.collection(spark, [("a", 1, 2)], SENSOR).first() == ("a", 1, 2)
    (tmp_path / "clicks.csv").write_text("543462,1715,beijing,beijing,1511658000\n662867,2244074,guangdong,shenzhen,1511658060\n")
    lines = readers.text(spark, str(tmp_path))
    assert lines.count() == 2
    typed = readers.typed_csv(spark, str(tmp_path), schemas.AD_CLICK)
    again = readers.typed_lines(lines, schemas.AD_CLICK)
    assert sorted(typed.collect()) == sorted(again.collect()) and typed.first().ts == 1511658000


def test_order_and_receipt_lines(spark):
    lines = spark.createDataFrame([("34729,create,,1558430842",), ("34729,pay,sd76f87d6,1558430844",)], "value string")
    typed = readers.typed_lines(lines, schemas.ORDER_EVENT)
    assert [tuple(r) for r in typed.filter("event_type = 'pay'").collect()] == [(34729, "pay", "sd76f87d6", 1558430844)]
    assert typed.filter("event_type = 'create'").first().tx_id is None
    receipt = spark.createDataFrame([("ewr342as4,wechat,1558430845",)], "value string")
    assert tuple(readers.typed_lines(receipt, schemas.RECEIPT_EVENT).first()) == ("ewr342as4", "wechat", 1558430845)
    behavior = spark.createDataFrame([("543462,1715,1464116,pv,1511658000",)], "value string")
    assert tuple(readers.typed_lines(behavior, schemas.USER_BEHAVIOR).first()) == (543462, 1715, 1464116, "pv", 1511658000)
    channel = spark.createDataFrame([("7,download,store,1511658000",)], "value string")
    assert tuple(readers.typed_lines(channel, schemas.MARKETING_BEHAVIOR).first()) == (7, "download", "store", 1511658000)


def test_sensor_lines_and_custom_source(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text("sensor_1,1,10\nsensor_2,2,20\n")
    assert readers.sensors(readers.text(spark, str(folder))).count() == 2
    spark.dataSource.register(SensorDataSource)
    assert sorted(map(tuple, spark.read.format("sensor_lines").load(str(folder)).collect())) == [
        ("sensor_1", 1, 10),
        ("sensor_2", 2, 20),
    ]
    def run(name, **options):
        stream = spark.readStream.format("sensor_lines").options(**options).load(str(folder))
        writer = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name))
        return writer.start()

    query = run("sensor_rows")
    try:
        query.processAllAvailable()
        (folder / "2.txt").write_text("sensor_3,3,30\n")
        query.processAllAvailable()
        (folder / "0.txt").write_text("sensor_0,4,40\n")  # sorts first, comes last
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.vc for r in spark.table("sensor_rows").collect()) == [10, 20, 30, 40]


def test_sensor_files_by_trigger_and_bad_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    spark.dataSource.register(SensorDataSource)
    for i in range(5):
        (folder / f"{9 - i}.txt").write_text(f"s,{i},{i}\nbroken\n\ns,x,1\n")
        os.utime(folder / f"{9 - i}.txt", (1000 + i // 2, 1000 + i // 2))  # two files at a time share their time of change
    (folder / "_hidden").write_text("s,1,1\n")
    plain = spark.read.format("sensor_lines").load(folder.as_uri())
    assert sorted(r.vc for r in plain.collect()) == [0, 1, 2, 3, 4]
    kept = spark.read.format("sensor_lines").option("badLines", "keep").load(str(folder))
    assert sorted(r.bad_line for r in kept.filter("bad_line IS NOT NULL").collect()) == ["broken"] * 5 + ["s,x,1"] * 5
    stream = spark.readStream.format("sensor_lines").option("filesPerTrigger", 2).load(str(folder))
    seen = []
    query = stream.writeStream.foreachBatch(lambda df, i: seen.append([r.vc for r in df.orderBy("vc").collect()])).option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and sum(map(len, seen)) < 5:
            time.sleep(0.2)
    finally:
        query.stop()
    assert [rows for rows in seen if rows] == [[0, 1], [2, 3], [4]]
    for i in range(3):
        (folder / f"new{i}.txt").write_text(f"s,9,{9 + i}\n")
    again = stream.writeStream.foreachBatch(lambda df, i: seen.append([r.vc for r in df.collect()])).option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and sum(map(len, seen)) < 8:
            time.sleep(0.2)
    finally:
        again.stop()
    assert [rows for rows in seen[3:] if rows] == [[9, 10], [11]]


def test_sketches_of_windows_add_up(spark):
    rows = spark.range(40_000).selectExpr(
        "CASE WHEN id % 50 = 0 THEN null ELSE (id * 7919) % 9000 END AS mid", "timestamp_seconds(1704067200 + id % 7200) AS ts", "id % 2 AS k")
    mart = sketches.window_sketches(rows, "ts", "2 seconds", ["k"], "mid", {"pv": F.count(F.lit(1))})
    by_key = {r.k: r.uv for r in sketches.estimated(sketches.merged(mart, ["k"])).collect()}
    exact = {r.k: r.n for r in rows.groupBy("k").agg(F.count_distinct("mid").alias("n")).collect()}
    assert all(abs(by_key[k] - exact[k]) <= 0.02 * exact[k] for k in exact) and mart.count() == 7200


def test_renamed_columns(spark):
    df = spark.createDataFrame([("a", "b")], "source_table string, sink_pk string")
    assert readers.renamed(df).columns == ["sourceTable", "sinkPk"]
    assert readers.renamed(df, {"sink_pk": "key"}).columns == ["source_table", "key"]


def test_bronze_table_by_day(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "app.log").write_text('{"ts":1704067200000,"a":1}\n{"ts":1704153600000,"a":2}\n')
    query = landing.write_bronze(landing.raw_lines(spark, str(folder)), str(tmp_path / "bronze"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    bronze = spark.read.parquet(str(tmp_path / "bronze"))
    assert sorted((str(r.dt), json.loads(r.value)["a"]) for r in bronze.collect()) == [("2024-01-01", 1), ("2024-01-02", 2)]


def test_sql_source_table(spark, tmp_path):
    page = {"common": {"mid": "1"}, "page": {"item": "red shoes", "item_type": "keyword"}, "ts": 1704067201500}
    records = spark.createDataFrame([(None, json.dumps(page), 1, "pages")], "key string, value string, seq long, topic string")
    topic_sink.append_folder(records, str(tmp_path), 0)
    topic = topic_source.read_folder(spark, str(tmp_path), "pages", streaming=False)
    readers.json_table(
        topic,
        "common map<string,string>, page map<string,string>, ts bigint",
        "to_timestamp(from_unixtime(ts div 1000, 'yyyy-MM-dd HH:mm:ss'))",
        "sql_pages",
        "2 seconds",
    )
    (row,) = spark.sql(
        "SELECT page['item'] AS item, date_format(window(rowtime, '2 seconds').start, 'HH:mm:ss') AS stt FROM sql_pages"
    ).collect()
    assert tuple(row) == ("red shoes", "00:00:00")
    stream = topic_source.read_folder(spark, str(tmp_path), "pages")
    table = readers.json_table(stream, "ts bigint", "timestamp_millis(ts)", "sql_pages_stream", "2 seconds")
    assert table.isStreaming and "EventTimeWatermark" in table._jdf.queryExecution().toString()


def test_topic_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, kind string")
    topic_sink.append_folder(topic_sink.to_records(df, F.col("kind"), key="id"), str(tmp_path), 0)
    back = topic_source.values(topic_source.read_folder(spark, str(tmp_path), "a", streaming=False), "id long, kind string")
    assert [tuple(r) for r in back.collect()] == [(1, "a")]


def test_routing_table_cases(spark):
    def envelope(table, kind, data):
        return json.dumps({"table": table, "type": kind, "data": data})

    rows = [
        envelope(None, "insert", {"id": "1"}),
        envelope("base_trademark", "insert", None),
        envelope("base_trademark", "insert", {}),
        envelope("base_trademark", "bootstrap-insert", {"id": "1", "tm_name": "x", "logo": "y"}),
        envelope("base_trademark", "insert", {"id": "1", "tm_name": "z", "logo": "y"}),
        envelope("order_info", "insert", {"id": "5", "user": "u"}),
        envelope("unknown", "insert", {"id": "5"}),
        "not json",
    ]
    config = spark.createDataFrame(
        [
            ("base_trademark", "insert", "hbase", "dim_base_trademark", "id,tm_name", None, None),
            ("order_info", "insert", "kafka", "dwd_order_info", "", "id", None),
        ],
        schemas.ROUTE,
    )
    raw = spark.createDataFrame(list(enumerate(rows)), "seq long, value string")
    routed = dwd.route(dwd.parse_changes(raw), config)
    (fact,) = dwd.facts(routed).collect()
    assert (fact.topic, fact.data) == ("dwd_order_info", {"id": "5", "user": "u"})
    (dim,) = dwd.latest_dimension_rows(dwd.dimensions(routed)).collect()
    assert (dim.dim, dim.pk, dim.data) == ("DIM_BASE_TRADEMARK", "1", {"id": "1", "tm_name": "z"})


def test_upsert_keeps_the_newest(spark, tmp_path):
    table = upsert.KeyedTable(spark, str(tmp_path / "t"), "k string, v int, at long", ("k",), ("at",))
    table.create()
    assert table.read().count() == 0

    def rows(*values):
        return spark.createDataFrame(list(values), "k string, v int, at long")

    table.apply(rows(("a", 1, 1), ("a", 2, 2), ("b", 3, 1)), 0)
    table.apply(rows(("a", 9, 1)), 1)
    table.apply(rows(("b", 4, 1)), 2)
    want = {("a", 2, 2), ("b", 4, 1)}
    assert set(map(tuple, table.read().collect())) == want
    table.compact()
    table.compact()
    assert set(map(tuple, table.read().collect())) == want
    table.apply(rows(("c", 5, 0)), 3)
    assert set(map(tuple, table.read().collect())) == want | {("c", 5, 0)}


def test_a_table_of_fifty_batches_stays_small(spark, tmp_path):
    table = upsert.KeyedTable(spark, str(tmp_path / "t"), "day string, k long, v long", ("day", "k"), ("v",), ("day",), fan=4, retain=6)
    table.create()
    want, most = {}, 0
    for batch in range(50):
        rows = [(f"d{batch % 3}", (batch * 7 + i) % 40, batch * (1 if i else -1)) for i in range(5)]
        for day, key, value in rows:
            want[day, key] = max(want.get((day, key), value), value)
        table.apply(spark.createDataFrame(rows, "day string, k long, v long").coalesce(1), batch)
        runs = table.runs()
        most = max(most, len(runs))
        assert [r.first for r in runs] == [0, *(r.last + 1 for r in runs[:-1])] and runs[-1].last == batch
    # Four levels of at most three runs, and the batch that waits for the next to be folded.
    assert most <= 3 * 3 + 1 + 1
    assert len(list((tmp_path / "t").glob("run-*"))) <= 3 * most
    assert {(r.day, r.k): r.v for r in table.read().collect()} == want
    one = table.read(F.col("k").between(3, 5) & (F.col("day") == "d1"))
    assert {(r.day, r.k): r.v for r in one.collect()} == {k: v for k, v in want.items() if k[0] == "d1" and 3 <= k[1] <= 5}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,3)" in plan and "PartitionFilters: [isnotnull(day" in plan


def test_a_run_counts_when_it_is_complete(spark, tmp_path):
    table = upsert.KeyedTable(spark, str(tmp_path / "t"), "k long, v long", ("k",), ("v",), fan=2)
    rows = spark.createDataFrame([(1, 1)], "k long, v long")
    for batch in range(3):
        table.apply(rows.withColumn("v", F.lit(batch).cast("long")), batch)
    assert [r.name for r in table.runs()] == ["run-1-0-1", "run-0-2-2"]
    (tmp_path / "t" / "run-1-0-1" / "_SUCCESS").rename(tmp_path / "t" / "run-1-0-1" / "_gone")
    # A fold that died: what it was made of is still there, and the next batch folds again.
    assert [r.name for r in table.runs()] == ["run-0-0-0", "run-0-1-1", "run-0-2-2"]
    assert [tuple(r) for r in table.read().collect()] == [(1, 2)]
    table.apply(rows.withColumn("v", F.lit(3).cast("long")), 3)
    table.apply(rows.withColumn("v", F.lit(3).cast("long")), 3)
    assert [tuple(r) for r in table.read().collect()] == [(1, 3)]
    table.compact()
    assert len(table.runs()) == 1 and [tuple(r) for r in table.read().collect()] == [(1, 3)]


def test_marts_hold_their_columns_only(spark, tmp_path):
    mart = marts.mart(spark, str(tmp_path), "keyword_stats")
    row = ("2024-01-01 00:00:00", "2024-01-01 00:00:02", "shoe", "SEARCH", 1, 1, "scratch")
    marts.store(mart, spark.createDataFrame([row], f"{marts.KEYWORD_MART}, extra string"), 0)
    stored = mart.read()
    assert stored.columns == ["stt", "edt", "keyword", "source", "ct", "ts", "dt"]
    assert (tmp_path / "keyword_stats" / "run-0-0-0" / "dt=2024-01-01").is_dir()


def test_gmv_reads_the_files_of_its_day_only(spark, tmp_path):
    mart = marts.mart(spark, str(tmp_path), "province_stats")
    names = spark.createDataFrame([], marts.PROVINCE_MART).columns
    for batch, (day, amount) in enumerate([("2024-01-01", 5), ("2024-01-02", 7), ("2024-01-01", 1)]):
        row = {n: None for n in names} | {"stt": f"{day} 00:00:0{batch}", "edt": f"{day} 00:00:09", "province_id": 1, "ts": batch,
                                          "order_amount": Decimal(amount), "order_count": 1}
        marts.store(mart, spark.createDataFrame([tuple(row[n] for n in names)], marts.PROVINCE_MART), batch)
    found = serving.gmv(mart.read(), 20240101)
    assert [tuple(r) for r in found.collect()] == [(0, Decimal("6.00"))]
    assert "PartitionFilters: [isnotnull(dt" in found._jdf.queryExecution().executedPlan().toString()


def test_a_routing_table_of_any_size_is_not_collected(spark, monkeypatch):
    config = spark.range(5).selectExpr("'hbase' AS sink_type", "concat('t', id) AS sink_table", "'id,a' AS sink_columns", "'id' AS sink_pk")
    assert len(dimensions.columns_of(config)) == 5
    monkeypatch.setattr(dimensions, "MOST_ROUTES", 4)
    with pytest.raises(ValueError):
        dimensions.columns_of(config)


def test_documents(spark):
    docs = upsert.as_documents(spark.createDataFrame([(1, "x")], "id int, name string"), "id")
    assert [tuple(r) for r in docs.collect()] == [("1", '{"id":1,"name":"x"}')]
