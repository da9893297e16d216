"""Streaming forms run over the test tables: built-in windows and joins, stateful processors, timers."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import joins, windows
from millrace.plans import dwd, dwm, star_views
from millrace.queries import query
from millrace.queries.ordered_rows import BOUNCE_HOURS_MS, PAGES
from millrace.queries.per_row import LOG
from millrace.streaming import replay, stateful


TIMES = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return replay.source(spark, f"{sf}/{name}.parquet", star_views.SCHEMAS[name], TIMES[name])


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a watermarked time, and the key, sequence and value the processors expect."""
    events = stream(spark, sf, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    return events.select(
        F.col("user_id").cast("string").alias("key"),
        F.unix_millis("event_time").alias("ts"),
        F.col("event_id").alias("seq"),
        "value",
        "event_type",
        "event_time",
    )


def keyed(rows: DataFrame, processor, time_mode: str = "None") -> DataFrame:
    """Results of a processor; the watermarked column, which it has no use for, is left out."""
    return replay.drain(stateful.run_keyed(rows.drop("event_time"), "key", processor, processor.SCHEMA, time_mode))


# -- windows and joins ----------------------------------------------------------------------------------------


@query(
    """
    SELECT event_type, strftime(time_bucket(INTERVAL 8 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS stt, count(*) AS n
    FROM events GROUP BY event_type, time_bucket(INTERVAL 8 HOUR, ts)
    """
)
def stream_tumbling_count(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_rows(spark, sf).withWatermark("event_time", "10 seconds")
    counted = windows.time_window(rows, "event_time", "8 hours", ["event_type"], {"n": F.count(F.lit(1))})
    return replay.drain(windows.with_bounds(counted).drop("edt"), "update", ["event_type", "stt"])


@query(
    """
    SELECT CAST(user_id AS VARCHAR) AS key, event_type, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('day', ts)) AS day_s,
           count(DISTINCT props) AS kinds
    FROM events GROUP BY user_id, event_type, date_trunc('day', ts)
    """
)
def stream_window_distinct(spark: SparkSession, sf: str) -> DataFrame:
    events = stream(spark, sf, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    rows = events.withColumn("key", F.col("user_id").cast("string")).withWatermark("event_time", "10 seconds")
    kinds = {"kinds": F.size(F.collect_set("props")).cast("long")}
    counted = windows.time_window(rows, "event_time", "1 day", ["key", "event_type"], kinds)
    flat = counted.select("key", "event_type", F.unix_seconds("window_start").alias("day_s"), "kinds")
    return replay.drain(flat, "update", ["key", "event_type", "day_s"])


@query(
    """
    SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey
     AND l_shipdate BETWEEN o_orderdate - INTERVAL 15 DAY AND o_orderdate + INTERVAL 15 DAY
    """
)
def stream_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = stream(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ordered"))
    lines = stream(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("timestamp").alias("shipped")
    )
    joined = joins.interval_join(
        orders.withWatermark("ordered", "10 seconds"),
        lines.withWatermark("shipped", "10 seconds"),
        {"o_orderkey": "l_orderkey"},
        "ordered",
        "shipped",
        timedelta(days=-15),
        timedelta(days=15),
    )
    return replay.drain(joined.select("o_orderkey", "l_linenumber", "l_partkey"), settle=False)


@query("SELECT count(*) AS seen FROM events")
def stream_row_count(spark: SparkSession, sf: str) -> DataFrame:
    return replay.drain(event_rows(spark, sf).groupBy().agg(F.count("*").alias("seen")), "update")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, event_type FROM events")
def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(event_rows(spark, sf), stateful.DistinctValues("event_type")).withColumnRenamed("value", "event_type")


# -- stateful processors --------------------------------------------------------------------------------------


@query(
    """
    SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, first_value(event_id) OVER w AS first_seq,
           sum(CAST(value AS DECIMAL(18,6))) OVER w AS total, min(value) OVER w AS low, max(value) OVER w AS high,
           count(*) OVER w AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) OVER w AS DOUBLE) / count(value) OVER w AS average
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
    """
)
def stream_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(event_rows(spark, sf), stateful.RollingAggregates())


@query(
    """
    SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, before AS previous, value AS level FROM (
        SELECT event_id, user_id, value,
               coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before FROM events)
    WHERE abs(value - before) >= 10
    """
)
def stream_level_jump(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(event_rows(spark, sf), stateful.LevelJump(10))


@query(
    """
    SELECT CAST(user_id AS VARCHAR) AS key, rn AS row_no, total, n FROM (
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
               sum(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY user_id ORDER BY ts, event_id
                   ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS total,
               count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n
        FROM events)
    WHERE rn % 2 = 0
    """
)
def stream_count_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(event_rows(spark, sf), stateful.CountWindow(3, 2))


@query(
    """
    SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq,
           array_to_string(CAST(list_slice(list_reverse_sort(list(CAST(value AS DECIMAL(18,2))) OVER w), 1, 3) AS VARCHAR[]),
                           ',') AS best
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
    """
)
def stream_top3(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(event_rows(spark, sf), stateful.TopThree())


# -- log patterns ---------------------------------------------------------------------------------------------


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of the behaviour log as a stream, with the columns the processors expect."""
    log = dwd.parse_log(star_views.as_app_log(stream(spark, sf, "events")), ("seq", "value"))
    return dwd.page_log(log).select(
        F.col("common.mid").alias("mid"),
        "seq",
        "ts",
        "value",
        dwm.is_entry().alias("entry"),
        (F.col("page.page_id") != "").alias("shown"),
        F.timestamp_millis("ts").alias("event_time"),
    )


@query(
    f"""WITH {PAGES} SELECT seq, mid FROM followed
    WHERE last_page_id IS NULL AND (next_ms >= ms + {BOUNCE_HOURS_MS}
                                    OR next_ms IS NULL AND ms + {BOUNCE_HOURS_MS} <= (SELECT max(ms) FROM pages))"""
)
def stream_bounce(spark: SparkSession, sf: str) -> DataFrame:
    rows = page_rows(spark, sf).withWatermark("event_time", "0 seconds").drop("event_time")
    bounce = stateful.Bounce(timedelta(milliseconds=BOUNCE_HOURS_MS))
    return replay.drain(stateful.run_keyed(rows, "mid", bounce, bounce.SCHEMA, "EventTime")).select("seq", "mid")


@query(
    f"""WITH {PAGES} SELECT seq, mid FROM pages WHERE last_page_id IS NULL
    QUALIFY row_number() OVER (PARTITION BY mid, date_trunc('day', ts) ORDER BY ms, seq) = 1"""
)
def stream_unique_visit(spark: SparkSession, sf: str) -> DataFrame:
    rows = page_rows(spark, sf).filter("entry").withWatermark("event_time", "1 day").drop("event_time")
    visit = stateful.DailyVisit()
    return replay.drain(stateful.run_keyed(rows, "mid", visit, visit.SCHEMA, "EventTime")).select("seq", "mid")


@query(f"WITH {LOG} SELECT seq, mid, is_new FROM fixed")
def stream_new_user_fix(spark: SparkSession, sf: str) -> DataFrame:
    log = dwd.parse_log(star_views.as_app_log(stream(spark, sf, "events")), ("seq", "value"))
    rows = log.select(
        F.col("common.mid").alias("mid"), "seq", "ts", F.col("common.is_new").alias("is_new"), "value"
    )
    new = stateful.NewVisitor()
    return replay.drain(stateful.run_keyed(rows, "mid", new, new.SCHEMA)).select("seq", "mid", "is_new")


@query(
    """
    SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 + 5000 AS fired_at FROM events
    WHERE epoch_us(ts) // 1000 + 5000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events)
    """
)
def stream_reminder(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_rows(spark, sf).withWatermark("event_time", "0 seconds")
    return keyed(rows, stateful.Reminder(timedelta(seconds=5), event_time=True), "EventTime")
