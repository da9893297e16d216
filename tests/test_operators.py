"""Documented outputs and boundary cases of the operators, on literal rows."""

from __future__ import annotations

import re
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frames import ROWS_A, ROWS_B, SENSOR
from millrace import schemas
from millrace.functions import averages, keywords, times
from millrace.operators import exchange, joins, late, ordered, patterns, rolling, rows, topk, windows
from millrace.plans import dws
from millrace.queries import joined as joined_queries

T0 = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def a(spark):
    return spark.createDataFrame(ROWS_A, SENSOR)


@pytest.fixture(scope="module")
def b(spark):
    return spark.createDataFrame(ROWS_B, SENSOR)


def by_key(df, *columns):
    out = {}
    for r in df.orderBy("id", "ts").collect():
        value = tuple(r[c] for c in columns)
        out.setdefault(r["id"][-1], []).append(value[0] if len(value) == 1 else value)
    return out


# -- rows -----------------------------------------------------------------------------------------------------


def test_map_flat_map_filter(spark):
    one_to_five = spark.createDataFrame([(i,) for i in range(1, 6)], "x int")
    assert [r.y for r in rows.map_rows(one_to_five, y=F.col("x") * 2).collect()] == [2, 4, 6, 8, 10]
    flat = rows.flat_map(one_to_five, "y", F.col("x") * 2, F.col("x") * 3)
    assert [r.y for r in flat.collect()] == [2, 3, 4, 6, 6, 9, 8, 12, 10, 15]
    some = spark.createDataFrame([(i,) for i in (10, 2, 5, 6, 7)], "x int")
    assert [r.x for r in some.filter("x % 2 = 0").collect()] == [10, 2, 6]


def test_words_drop_empty_tokens(spark):
    text = spark.createDataFrame([(" red, green  blue!",), ("",), (None,)], "t string")
    assert [r.word for r in rows.words(text, "t").collect()] == ["red", "green", "blue"]


def test_connect_keeps_both_shapes(spark):
    left = spark.createDataFrame([(1,)], "x int")
    right = spark.createDataFrame([("a",)], "y string")
    got = {tuple(r) for r in rows.connect({"l": left, "r": right}).select("side", "x", "y").collect()}
    assert got == {("l", 1, None), ("r", None, "a")}


def test_union_keeps_duplicates(spark):
    one = spark.createDataFrame([(1,)], "x int")
    assert rows.union_all([one, one, one]).count() == 3


def test_rich_map_opens_and_closes_once_per_task(spark, tmp_path):
    folder = str(tmp_path)

    def opened():
        return open(f"{folder}/{__import__('uuid').uuid4()}", "w", encoding="utf-8")

    def each(handle, batch):
        handle.write("batch\n")
        return batch

    def closed(handle):
        handle.write("closed\n")
        handle.close()

    df = spark.range(100).repartition(3)
    assert rows.rich_map(df, opened, each, "id long", closed).count() == 100
    logs = [p.read_text().split() for p in tmp_path.iterdir()]
    assert len(logs) == 3 and all(log.count("closed") == 1 and log[-1] == "closed" for log in logs)


# -- redistribution -------------------------------------------------------------------------------------------


def test_exchanges(spark):
    df = spark.range(1000)
    assert exchange.by_key(df, "id", partitions=5).rdd.getNumPartitions() == 5
    assert exchange.rescale(exchange.round_robin(df, 6), 2).rdd.getNumPartitions() == 2
    sizes = exchange.round_robin(df, 4).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 8
    assert exchange.at_random(df, 4).distinct().count() == 1000


def test_control_tables_are_broadcast_only_when_short(spark):
    df = spark.range(10)
    big = spark.range(100_000_000)
    marked, unmarked = exchange.to_all(df, 10), exchange.to_all(df, 9)
    assert "BroadcastHashJoin" in big.join(marked, "id")._jdf.queryExecution().toString()
    assert "broadcast" in marked._jdf.queryExecution().toString() or marked is not df
    assert unmarked is df


def test_only_small_inputs_are_spread(spark):
    df = spark.range(1000).coalesce(1)
    assert exchange.spread_small(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert exchange.spread_small(df, most_bytes=10) is df


# -- rolling aggregates ---------------------------------------------------------------------------------------

PLANS = pytest.mark.parametrize("hot_rows", [None, 1])


@PLANS
def test_rolling_sum_keeps_first_time(a, hot_rows):
    out = rolling.rolling_sum(a, ["id"], ["ts"], F.col("vc"), "total", ["ts"], hot_rows)
    assert by_key(out, "total", "first_ts") == {
        "1": [(20, 1607527992000), (70, 1607527992000), (100, 1607527992000)],
        "2": [(10, 1607527993000), (40, 1607527993000)],
    }


@PLANS
def test_rolling_max_by(a, b, hot_rows):
    last = rolling.rolling_extreme(a, ["id"], ["ts"], "vc", ["ts", "vc"], hot_rows=hot_rows)
    assert by_key(last, "best_ts", "best_vc") == {
        "1": [(1607527992000, 20), (1607527994000, 50), (1607527994000, 50)],
        "2": [(1607527993000, 10), (1607527995000, 30)],
    }
    for last_on_ties, winner in ((True, 1607527996000), (False, 1607527994000)):
        out = rolling.rolling_extreme(b, ["id"], ["ts"], "vc", ["ts"], last_on_ties=last_on_ties, hot_rows=hot_rows)
        assert by_key(out, "best_ts")["1"][-1] == winner
        final = rolling.extreme_row(b, ["id"], ["ts"], "vc", ["ts"], last_on_ties=last_on_ties)
        assert {r.id[-1]: r.ts for r in final.collect()}["1"] == winner


@PLANS
def test_rolling_average_and_reduce(b, hot_rows):
    out = rolling.rolling_average(b, ["id"], ["ts"], F.col("vc"), "average", hot_rows)
    assert by_key(out, "average") == {"1": [20.0, 35.0, 40.0], "2": [10.0, 20.0]}
    out = rolling.rolling_sum(b, ["id"], ["ts"], F.col("vc"), "total", ["id"], hot_rows)
    assert by_key(out, "total") == {"1": [20, 70, 120], "2": [10, 40]}


@PLANS
def test_top_three_and_distinct(spark, b, hot_rows):
    levels = spark.createDataFrame([("s1", i, v) for i, v in enumerate([10, 40, 20, 30, 5])], SENSOR)
    out = topk.rolling_top3(levels, ["id"], ["ts"], "vc", "best", hot_rows=hot_rows)
    assert by_key(out, "best")["1"] == [[10], [40, 10], [40, 20, 10], [40, 30, 20], [40, 30, 20]]
    assert {tuple(r) for r in patterns.distinct_per_key(b, ["id"], "vc").collect()} == {
        ("sensor_1", 20), ("sensor_1", 50), ("sensor_2", 10), ("sensor_2", 30),
    }


@PLANS
def test_level_jumps(spark, b, hot_rows):
    out = patterns.level_jumps(b, ["id"], ["ts"], "vc", 10, hot_rows=hot_rows)
    assert by_key(out, "vc") == {"1": [20, 50], "2": [10, 30]}
    drop = spark.createDataFrame([("s1", 1, 50), ("s1", 2, 20)], SENSOR)
    assert patterns.level_jumps(drop, ["id"], ["ts"], "vc", 10, hot_rows=hot_rows).count() == 2
    assert patterns.level_jumps(drop, ["id"], ["ts"], "vc", 10, literal=True, hot_rows=hot_rows).count() == 1


# -- windows --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def timed(spark):
    """Rows of one key at given seconds."""

    def build(*seconds, key="k"):
        return spark.createDataFrame([(key, at(s), i) for i, s in enumerate(seconds)], "k string, ts timestamp_ntz, seq int")

    return build


def n() -> dict:
    return {"n": F.count(F.lit(1))}


def test_time_windows_are_half_open(timed):
    out = windows.time_window(timed(0, 4.999, 5), "ts", "5 seconds", ["k"], n())
    assert {(r.window_start, r.n) for r in out.collect()} == {(at(0), 2), (at(5), 1)}
    out = windows.time_window(timed(7), "ts", "10 seconds", ["k"], n(), slide="5 seconds")
    assert {r.window_start for r in out.collect()} == {at(0), at(5)}


@PLANS
def test_session_gap_at_the_limit_merges(timed, hot_rows):
    out = windows.session_window(timed(0, 10, 20.001), "ts", "10 seconds", ["k"], n(), ["ts"], hot_rows)
    assert sorted((r.session_start, r.session_end, r.n) for r in out.collect()) == [
        (at(0), at(20), 2),
        (at(20.001), at(30.001), 1),
    ]


@PLANS
def test_session_with_a_gap_per_row(spark, hot_rows):
    rows_in = [("ab", at(0)), ("abcdef", at(1)), ("a", at(5)), ("a", at(8))]
    df = spark.createDataFrame([("k", t, w) for w, t in rows_in], "k string, ts timestamp_ntz, word string")
    gap = F.concat(F.length("word"), F.lit(" seconds"))
    out = windows.session_window(df, "ts", gap, ["k"], n(), ["ts"], hot_rows)
    assert sorted((r.session_start, r.session_end, r.n) for r in out.collect()) == [
        (at(0), at(7), 3),
        (at(8), at(9), 1),
    ]


@PLANS
def test_count_windows(timed, hot_rows):
    tumbling = windows.count_tumbling(timed(*range(7)), ["k"], ["ts"], 3, n(), hot_rows)
    assert sorted(r.n for r in tumbling.collect()) == [3, 3]
    sliding = windows.count_sliding(timed(*range(6)), ["k"], ["ts"], 3, 2, n(), hot_rows)
    assert [r.n for r in sliding.orderBy("row_no").collect()] == [2, 3, 3]


def test_global_window_needs_a_trigger(timed):
    df = timed(*range(5))
    values = {"total": ordered.total(F.col("seq"))}
    assert windows.global_window(df, ["k"], ["ts"], values).count() == 0
    fired = windows.global_window(df, ["k"], ["ts"], values, every=2)
    assert [(r.row_no, r.total) for r in fired.orderBy("row_no").collect()] == [(2, 1), (4, 6)]


def test_ingest_window_and_report(timed):
    (row,) = windows.ingest_window(timed(0, 1, 2), "1 day", ["k"], n()).collect()
    assert row.n == 3
    (row,) = windows.window_report(timed(0, 1), "ts", "5 seconds", "k").collect()
    assert row.message == "key=k window=[2024-01-01 00:00:00,2024-01-01 00:00:05) rows=2"


def test_user_defined_aggregate(a):
    spread = averages.grouped(lambda values: float(values.max() - values.min()))
    assert {r.id: r.s for r in a.groupBy("id").agg(spread("vc").alias("s")).collect()} == {"sensor_1": 30.0, "sensor_2": 20.0}


def test_user_defined_aggregate_takes_many_groups_at_a_time_and_nulls(spark):
    many = averages.grouped(lambda values: float(len(values) + values.isna().sum()))
    df = spark.createDataFrame([("a", None), ("a", 1.0), ("b", 2.0), ("c", None)], "k string, v double")
    found = df.groupBy("k").agg(many("v").alias("n"))
    assert {r.k: r.n for r in found.collect()} == {"a": 3.0, "b": 1.0, "c": 2.0}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "ArrowAggregatePython" not in plan


# -- patterns -------------------------------------------------------------------------------------------------


@PLANS
def test_rising_alert_boundaries(spark, hot_rows):
    def alerts(*levels):
        df = spark.createDataFrame(
            [("k", at(s), i, v) for i, (s, v) in enumerate(levels)], "k string, ts timestamp_ntz, seq int, vc int"
        )
        out = patterns.rising_alerts(df, ["k"], "ts", ["ts", "seq"], "vc", timedelta(seconds=5), hot_rows)
        return sorted(r.first_rise for r in out.collect())

    assert alerts((0, 1), (3, 2), (6, 3)) == [at(0)]
    assert alerts((0, 1), (5, 1)) == []
    assert alerts((0, 1), (5.001, 1)) == [at(0)]
    assert alerts((0, 1)) == [at(0)]
    assert alerts((0, 0), (1, 1), (2, 1), (3, 2)) == [at(3)]


@PLANS
def test_bounce_boundaries(spark, hot_rows):
    def bounced(close_open, *pages):
        df = spark.createDataFrame(
            [(m, at(s), i, last, page) for i, (m, s, last, page) in enumerate(pages)],
            "m string, ts timestamp_ntz, seq int, last string, page string",
        )
        entry, follow = patterns.is_blank(F.col("last")), ~patterns.is_blank(F.col("page"))
        out = patterns.bounces(
            df, ["m"], "ts", ["ts", "seq"], entry, follow, timedelta(seconds=10), close_open, hot_rows
        )
        return sorted((r.m, r.seq) for r in out.collect())

    first = [("101", 1, None, "home"), ("102", 0, None, "home"), ("102", 2, "home", "list"), ("102", 20, "detail", "list")]
    assert bounced(True, *first) == [("101", 0)]
    assert bounced(False, *first[:3]) == []
    second = [("101", 0, None, "home"), ("102", 0, None, "home"), ("102", 19, "aa", "home"), ("102", 29, "aa", "home")]
    assert bounced(True, *second) == [("101", 0), ("102", 1)]
    assert bounced(True, ("1", 0, "", "home"), ("1", 10, "home", "x")) == [("1", 0)]
    assert bounced(True, ("1", 0, "", "home"), ("1", 9.999, "home", "x")) == []
    # A row without a page is no follower, another entry page is one.
    assert bounced(True, ("1", 0, "", "home"), ("1", 2, "home", ""), ("1", 5, "", "home"), ("1", 7, "x", "y")) == []


def test_first_of_day(spark):
    day = datetime(2024, 1, 1)
    rows_in = [
        ("m", day + timedelta(hours=23, minutes=59, seconds=59), None),
        ("m", day + timedelta(days=1, seconds=1), ""),
        ("m", day + timedelta(days=1, seconds=2), None),
        ("m", day + timedelta(days=2), "home"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_in)], "seq int, m string, ts timestamp_ntz, last string")
    out = patterns.first_of_day(df, ["m"], F.to_date("ts"), ["ts", "seq"], patterns.is_blank(F.col("last")))
    assert sorted(r.seq for r in out.collect()) == [0, 1]


# -- joins ----------------------------------------------------------------------------------------------------


def sides(spark, left, right):
    a = spark.createDataFrame([(k, t) for k, t in left], "lk int, lt timestamp_ntz")
    b = spark.createDataFrame([(k, t) for k, t in right], "rk int, rt timestamp_ntz")
    return a, b


def test_interval_join_bounds_are_inclusive(spark):
    offsets = [-5.001, -5, 0, 5, 5.001]
    a, b = sides(spark, [(1, at(100)), (1, None), (2, at(100))], [(1, at(100 + o)) for o in offsets] + [(1, None), (None, at(100))])
    out = joins.interval_join(a, b, {"lk": "rk"}, "lt", "rt", timedelta(seconds=-5), timedelta(seconds=5))
    assert sorted(r.rt for r in out.collect()) == [at(95), at(100), at(105)]
    assert out.columns == ["lk", "lt", "rk", "rt"]
    offsets = [-901, -900, -1, 0, 1]
    a, b = sides(spark, [(1, at(1000))], [(1, at(1000 + o)) for o in offsets])
    out = joins.interval_join(a, b, {"lk": "rk"}, "lt", "rt", timedelta(minutes=-15), timedelta(0))
    assert sorted(r.rt for r in out.collect()) == [at(100), at(999), at(1000)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    left=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), max_size=12),
    right=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), max_size=12),
    bounds=st.tuples(st.integers(-20, 20), st.integers(0, 25)),
)
def test_interval_join_finds_each_pair_once(spark, left, right, bounds):
    low, high = bounds[0], bounds[0] + bounds[1]
    a, b = sides(spark, [(k, at(s)) for k, s in left], [(k, at(s)) for k, s in right])
    out = joins.interval_join(a, b, {"lk": "rk"}, "lt", "rt", timedelta(seconds=low), timedelta(seconds=high))
    want = sorted((k, at(s), j, at(t)) for k, s in left for j, t in right if k == j and s + low <= t <= s + high)
    assert sorted(map(tuple, out.collect())) == want


def test_window_join_pairs_and_counts(spark):
    left = spark.createDataFrame([(1, at(0), "a"), (1, at(4), "b"), (2, at(1), "c")], "k int, ts timestamp_ntz, v string")
    right = spark.createDataFrame([(1, at(3), "x"), (1, at(5), "y"), (2, at(7), "z")], "k int, ts timestamp_ntz, v string")
    out = joins.window_join(left, right, ["k"], "ts", "5 seconds")
    assert sorted((r.v, r.right_v) for r in out.collect()) == [("a", "x"), ("b", "x")]
    (row,) = joins.window_join_count(left, right, ["k"], "ts", "5 seconds").collect()
    assert (row.k, row.window_start, row.pairs) == (1, at(0), 2)


def test_reconcile_reports_every_record(spark):
    pay = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, None)], "order_id int, tx string")
    receipt = spark.createDataFrame([("t1", "card"), ("t9", "cash")], "tx_id string, channel string")
    out = joins.reconcile(pay, receipt, {"tx": "tx_id"})
    assert {(r.order_id, r.tx_id, r.status) for r in out.collect()} == {
        (1, "t1", "matched"), (2, None, "left_only"), (3, None, "left_only"), (None, "t9", "right_only"),
    }


def test_lookup_keeps_rows_without_a_match(spark):
    facts = spark.createDataFrame([(1, 2), (3, 4), (None, 1)], "a int, b int")
    dim = spark.createDataFrame([(1, 2, "x"), (3, 9, "y")], "p int, q int, name string")
    out = joins.lookup(facts, dim, {"a": "p", "b": "q"}, {"name": "label"})
    assert out.columns == ["a", "b", "label"]
    assert {tuple(r) for r in out.collect()} == {(1, 2, "x"), (3, 4, None), (None, 1, None)}


def test_switch_sees_the_newest_control_row(spark):
    data = spark.createDataFrame([(i, at(s)) for i, s in enumerate([0, 1, 2, 3, 9])], "seq int, ts timestamp_ntz")
    control = spark.createDataFrame([(0, at(1), "1"), (1, at(2.5), "0"), (2, at(8), "7")], "seq int, ts timestamp_ntz, v string")
    seen = joins.switch(data, control, "ts", ["seq"], "v", "mode").withColumn("label", joins.switch_label(F.col("mode")))
    got = {r.seq: r.label for r in seen.collect()}
    assert got == {0: "config_other", 1: "config_1", 2: "config_1", 3: "config_0", 4: "config_other"}


# -- late rows ------------------------------------------------------------------------------------------------


def test_late_rows_by_window_end(spark):
    # Window of 5 s, delay 3 s, lateness 3 s; the newest time before row i decides.
    seconds = [1, 8, 2, 10.999, 3, 11, 4, 13]
    df = spark.createDataFrame([(i, at(s)) for i, s in enumerate(seconds)], "seq int, ts timestamp_ntz")
    out = late.classify_late(df, "ts", ["seq"], "5 seconds", timedelta(seconds=3), timedelta(seconds=3))
    got = {r.seq: r.status for r in out.collect()}
    assert got == {
        0: "on_time", 1: "on_time", 2: "refire", 3: "on_time", 4: "refire", 5: "on_time", 6: "too_late", 7: "on_time",
    }


# -- functions ------------------------------------------------------------------------------------------------


def test_times(spark):
    df = spark.createDataFrame([("2024-01-31 23:59:59", 1706745599999)], "text string, ms long")
    (row,) = df.select(
        times.text_to_millis(F.col("text")).alias("ms"),
        times.millis_to_text(F.col("ms")).alias("text"),
        times.millis_to_day(F.col("ms")).alias("day"),
        times.day_number(times.text_to_time(F.col("text"))).alias("number"),
        times.whole_years(F.lit("1990-02-01").cast("date"), F.lit("2024-01-31").cast("date")).alias("age"),
        times.text_to_time(F.lit("no time")).alias("none"),
        times.seconds_to_time(F.lit(0)).cast("string").alias("epoch"),
        times.time_to_text(times.millis_to_time(F.col("ms"))).alias("again"),
    ).collect()
    assert tuple(row) == (
        1706745599000, "2024-01-31 23:59:59", "2024-01-31", 20240131, 34, None, "1970-01-01 00:00:00", "2024-01-31 23:59:59",
    )


def test_only_texts_in_the_format_are_times(spark):
    texts = ["2024-01-31 23:59:59", "2024", "2024-01-31", "2024-01-31 23:59:59.5", "2024-13-31 00:00:00", "2024-01-31T00:00:00", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r.i: r.ms for r in df.select("i", times.text_to_millis(F.col("t")).alias("ms")).collect()}
    assert found == {0: 1706745599000} | dict.fromkeys(range(1, len(texts)))


def test_keywords_with_a_dictionary(spark):
    text = spark.createDataFrame([(1, "Red红色连衣裙, size 42"), (2, "连衣裙子"), (3, None)], "id int, t string")
    dictionary = spark.createDataFrame([("红色",), ("连衣",), ("连衣裙",), ("裙子",)], "word string")
    plain = keywords.keywords(text, "t")
    assert [r.keyword for r in plain.filter("id = 1").collect()] == ["red红色连衣裙", "size", "42"]
    split = keywords.keywords(text, "t", dictionary=dictionary)
    assert sorted(r.keyword for r in split.filter("id = 1").collect()) == sorted(
        ["r", "e", "d", "红色", "连衣裙", "size", "42"]
    )
    assert sorted(r.keyword for r in split.filter("id = 2").collect()) == sorted(["连衣裙", "子"])
    keywords.register(spark)
    assert [r.word for r in spark.sql("SELECT word FROM ik_analyze('Big data, 2024')").collect()] == ["big", "data", "2024"]


def test_table_function_with_a_dictionary_equals_the_join(spark):
    dice = random.Random(1)
    characters = "一丁七万丈三上下不与𠀀"
    words = ["".join(dice.choice(characters) for _ in range(dice.randrange(1, 5))) for _ in range(150)] + ["Abc", "", "丁a"]
    texts = ["".join(dice.choice(characters + " aB1") for _ in range(dice.randrange(60))) for _ in range(200)] + [None, "", " ,"]
    texts.append("".join(dice.choice(characters) for _ in range(4000)))
    dictionary = spark.createDataFrame([(w,) for w in words], "word string")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    df.createOrReplaceTempView("han_texts")
    keywords.register(spark, dictionary)
    found = spark.sql("SELECT id, word FROM han_texts, LATERAL ik_analyze(t)")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    joined = keywords.keywords(df, "t", dictionary=dictionary)
    assert sorted(map(tuple, found.collect())) == sorted((r.id, r.keyword) for r in joined.collect())
    keywords.register(spark, dictionary.limit(0))
    assert [r.word for r in spark.sql("SELECT word FROM ik_analyze('丁七 x')").collect()] == ["丁", "七", "x"]


def test_a_dictionary_too_large_for_a_table_is_refused(spark, monkeypatch):
    monkeypatch.setattr(keywords, "MOST_TABLE_WORDS", 2)
    with pytest.raises(ValueError):
        keywords.register(spark, spark.createDataFrame([("a",), ("b",), ("c",)], "word string"))


@pytest.mark.parametrize("gap", ["500 milliseconds", "1 week", "1 minute 30 seconds", "0 seconds", "-5 seconds", None])
def test_gaps_mean_the_same_with_and_without_cuts(spark, gap):
    rows = [("a", i * 100, i) for i in range(20)] + [("a", None, 50), ("b", 40_000, 60), ("a", 700_000, 61), ("a", 788_000, 62)]
    df = spark.createDataFrame(rows, "k string, ms long, seq long").withColumn("ts", F.timestamp_millis("ms"))
    df = df.withColumn("gap", F.lit(gap).cast("string"))
    found = [
        sorted(windows.session_window(df, "ts", F.col("gap"), ["k"], {"n": F.count("*")}, ["ts", "seq"], hot_rows=cut).collect())
        for cut in (None, 2)
    ]
    assert found[0] == found[1] and bool(found[0]) == (gap in ("500 milliseconds", "1 week", "1 minute 30 seconds"))


def test_a_long_run_is_split_in_time_of_its_length(spark):
    text = spark.createDataFrame([(1, "红色连衣裙" * 4000)], "id int, t string")
    dictionary = spark.createDataFrame([("红色",), ("连衣",), ("连衣裙",)], "word string")
    found = keywords.keywords(text, "t", dictionary=dictionary).groupBy("keyword").count().collect()
    assert sorted(tuple(r) for r in found) == sorted([("红色", 4000), ("连衣裙", 4000)])


def test_wide_rows_are_not_shuffled_again_for_payments(spark, tables):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        plan = joined_queries.payment_wide(spark, tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(setting, before)
    # Orders, lines and payments are dealt by order, each once.
    assert len(re.findall(r"hashpartitioning\((?:order_key|order_id|paid_order_id)#", plan)) == 3


def test_interval_join_by_keys_alone_gives_the_same_pairs(spark):
    rows = [(key, second) for key in (1, 1, 2, None) for second in (0, 4, 5, 6, None)]
    at = "timestamp_seconds(s) AS {0}"
    a = spark.createDataFrame(rows, "lk long, s long").selectExpr("lk", at.format("lt"))
    b = spark.createDataFrame(rows, "rk long, s long").selectExpr("rk", at.format("rt"))
    found = [
        sorted(joins.interval_join(a, b, {"lk": "rk"}, "lt", "rt", timedelta(seconds=-5), timedelta(seconds=1), slots).collect())
        for slots in (True, False)
    ]
    assert found[0] == found[1] and found[0]


def test_product_measures_of_all_kinds_of_facts_without_decimal_sums(spark):
    amounts, counts = schemas.PRODUCT_AMOUNTS, schemas.PRODUCT_COUNTS
    schema = ", ".join(
        ["sku_id long", "event_time timestamp", *[f"{c} long" for c in counts], *[f"{a} decimal(18,2)" for a in amounts],
         "order_kind string", "order_id long"]
    )
    at = datetime(2024, 1, 1, 5)

    def fact(kind, order, amount, count):
        return (7, at, *[count] * len(counts), *[amount and Decimal(amount)] * len(amounts), kind, order)

    facts = spark.createDataFrame(
        [fact("order", 1, "1.10", 1), fact("order", 1, "-0.05", 0), fact("order", 2, "9999999999999999.00", 2), fact("order", None, "0.01", 0),
         fact("payment", 1, None, 3), fact("refund", 1, "2.00", 4), fact("gift", 5, "3.00", 5), fact(None, None, "0.00", 6),
         (None, at, *[None] * (len(counts) + len(amounts)), None, None)],
        schema,
    )
    out = dws.product_measures(facts.filter("order_id IS NULL OR order_id <> 2"), "1 day")
    found = {r.sku_id: r for r in out.collect()}
    assert found[7].order_amount == found[7].refund_amount == Decimal("6.06") and found[7].cart_ct == 19
    assert (found[7].order_ct, found[7].paid_order_ct, found[7].refund_order_ct) == (1, 1, 1)
    assert found[None].order_amount is None and found[None].cart_ct is None and found[None].order_ct == 0
    large = dws.product_measures(facts.filter("order_id = 2"), "1 day")
    assert large.first().order_amount == Decimal("9999999999999999.00") and large.schema["order_amount"].dataType.simpleString() == "decimal(18,2)"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "sum(order_amount#" in plan and not re.search(r"sum\(order_amount#\d+\)", plan)
