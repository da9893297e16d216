"""Versions of dimensions as of a time, matching that consumes, and what streams do by their own watermark."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import joins, versions, windows
from millrace.plans import star_views
from millrace.plans.star_views import table
from millrace.queries import query
from millrace.queries.aggregates import ORDER, events
from millrace.queries.ordered_rows import DISORDERED
from millrace.streaming import in_time, replay, stateful

# -- versions of dimensions -----------------------------------------------------------------------------------

CHANGES = f"""
    steps AS (
        SELECT *, unnest(range(0, {star_views.USER_VERSIONS} + 1)) AS step FROM customer),
    changes AS (
        SELECT c_custkey AS id, TIMESTAMP '2024-01-01' + to_minutes(CASE WHEN step = 0 THEN -1 ELSE c_custkey % 211 + step * step * 300 END)
                   AS changed_at, c_custkey * 100 + step * 2 + again AS seq, lower(c_mktsegment) || '/' || step || '/' || again AS segment,
               step = {star_views.USER_VERSIONS} AND c_custkey % 11 = 0 AS gone
        FROM (SELECT *, unnest(range(0, (c_custkey + step) % 2 + 1)) AS again FROM steps)),
    newest AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY id, changed_at ORDER BY seq DESC) = 1),
    ordered AS (SELECT o_orderkey, o_custkey, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey) AS ordered_at FROM orders)
"""


def user_changes(spark: SparkSession, sf: str) -> DataFrame:
    return star_views.user_changes(spark, sf)


def deleted() -> Column:
    return F.col("type") == "delete"


def ordered_at(orders: DataFrame) -> DataFrame:
    """Orders a minute apart, as the star views date them."""
    at = F.lit(star_views.ORDER_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("o_orderkey").cast("int"))
    return orders.select("o_orderkey", "o_custkey", at.alias("ordered_at"))


@query(
    f"""
    WITH {CHANGES}
    SELECT id, segment, changed_at AS valid_from, valid_to
    FROM (SELECT *, lead(changed_at) OVER (PARTITION BY id ORDER BY changed_at) AS valid_to FROM newest) WHERE NOT gone
    """
)
def dimension_versions(spark: SparkSession, sf: str) -> DataFrame:
    found = versions.intervals(user_changes(spark, sf), ["id"], "changed_at", ["seq"], deleted())
    return found.select("id", "segment", "valid_from", "valid_to")


@query(
    f"""
    WITH {CHANGES}
    SELECT o_orderkey, CASE WHEN NOT gone THEN segment END AS segment
    FROM ordered ASOF LEFT JOIN newest ON o_custkey = id AND ordered_at >= changed_at
    """
)
def lookup_as_of(spark: SparkSession, sf: str) -> DataFrame:
    orders = ordered_at(table(spark, sf, "orders"))
    joined = versions.as_of_join(
        orders, user_changes(spark, sf), {"o_custkey": "id"}, "ordered_at", "changed_at", ["o_orderkey"], ["seq"],
        {"segment": "segment"}, deleted(),
    )
    return joined.select("o_orderkey", "segment")


# -- streams whose last row closes them -----------------------------------------------------------------------

CLOSING = "1000 days"
# Rows of a micro-batch that wait for the next one, and of which the control rows are copied to every bucket.
WAITING_ROWS = 1_000_000


def closed_events(spark: SparkSession, sf: str, delay: str = "0 seconds", batch_rows: int | None = None) -> DataFrame:
    """Events as a stream with a watermark that in the end passes all of them."""
    rows = replay.source(spark, f"{sf}/events.parquet", star_views.SCHEMAS["events"], "ts", CLOSING, batch_rows)
    timed = rows.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    return replay.without_closing(timed, "event_id", "event_time").withColumn("ms", in_time.plain_time("event_time"))


def by_processor(rows: DataFrame, processor, time_mode: str = "EventTime") -> DataFrame:
    return replay.drain(stateful.run_keyed(rows, "key", processor, processor.SCHEMA, time_mode))


@query(
    """
    SELECT event_id, CASE mode WHEN '1' THEN 'config_1' WHEN '0' THEN 'config_0' ELSE 'config_other' END AS config
    FROM events ASOF LEFT JOIN (SELECT ts AS since, CAST(event_id % 3 AS VARCHAR) AS mode FROM events WHERE event_type = 'signup')
      ON ts >= since
    """
)
def stream_switch(spark: SparkSession, sf: str) -> DataFrame:
    """Two feeds in one query: control rows reach every key of the data rows, which wait for the slower watermark.

    In many rows a control row is no millisecond apart from the data, so times are compared by the microsecond.
    """
    number = int(spark.sparkContext.defaultParallelism)
    at = F.unix_micros(F.col("event_time").cast("timestamp")).alias("ts")
    data = closed_events(spark, sf, batch_rows=WAITING_ROWS).select(
        "event_id", at, F.col("event_id").alias("seq"), F.lit(True).alias("is_data"), F.col("props").alias("value")
    )
    control = closed_events(spark, sf, batch_rows=WAITING_ROWS).filter("event_type = 'signup' OR event_time IS NULL")
    control = control.select(
        "event_id", at, F.col("event_id").alias("seq"), F.lit(False).alias("is_data"), (F.col("event_id") % 3).cast("string").alias("value")
    )
    both = in_time.buckets(data, ["event_id"], number).unionByName(in_time.to_all_buckets(control, number))
    found = by_processor(both.select("key", "ts", "seq", "is_data", "value"), in_time.AsOf(per_ms=1000))
    return found.select(F.col("seq").alias("event_id"), joins.switch_label(F.col("value")).alias("config"))


@query(
    """
    SELECT event_id, CAST(since AS VARCHAR) AS value
    FROM events p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS since FROM events WHERE event_type = 'view' GROUP BY ALL) v
      ON p.user_id = v.user_id AND p.ts >= v.ts
    WHERE event_type = 'purchase'
    """
)
def stream_lookup_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases with the newest view of the same user at their time: versions of a key on streams."""
    rows = closed_events(spark, sf).filter("event_type IN ('view', 'purchase') OR event_time IS NULL")
    tagged = rows.select(
        F.col("user_id").cast("string").alias("key"), F.col("ms").alias("ts"), F.col("event_id").alias("seq"),
        (F.col("event_type") == "purchase").alias("is_data"), F.col("event_id").cast("string").alias("value"),
    )
    return by_processor(tagged, in_time.AsOf()).select(F.col("seq").alias("event_id"), "value")


# -- matching that consumes -----------------------------------------------------------------------------------

MATCHES = """
    SELECT v.event_id AS view_id, c.event_id AS click_id, coalesce(v.n, c.n) AS match_no,
           CASE WHEN c.n IS NULL THEN 'left_only' WHEN v.n IS NULL THEN 'right_only' ELSE 'matched' END AS status
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view') v
    FULL JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click') c
      ON v.user_id = c.user_id AND v.n = c.n
"""


@query(MATCHES)
def match_in_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")

    def side(kind: str, name: str) -> DataFrame:
        return rows.filter(F.col("event_type") == kind).select(
            F.col("user_id").alias(f"{name}_user"), F.col("ts").alias(f"{name}_ts"), F.col("event_id").alias(f"{name}_id")
        )

    matched = joins.match_in_order(
        side("view", "view"), side("click", "click"), {"view_user": "click_user"}, ["view_ts", "view_id"], ["click_ts", "click_id"]
    )
    return matched.select("view_id", "click_id", "match_no", "status")


@query(f"SELECT view_id, click_id, CASE WHEN status = 'matched' THEN match_no END AS match_no, status FROM ({MATCHES})")
def stream_match_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The same on a stream: what still waits a year after its time is given up."""
    rows = closed_events(spark, sf).filter("event_type IN ('view', 'click') OR event_time IS NULL").select(
        F.col("user_id").cast("string").alias("key"), F.col("ms").alias("ts"), F.col("event_id").alias("seq"),
        (F.col("event_type") == "view").alias("is_left"),
    )
    found = by_processor(rows, in_time.MatchInOrder(timedelta(days=365)))
    return found.select(F.col("left_seq").alias("view_id"), F.col("right_seq").alias("click_id"), "match_no", "status")


# -- late rows ------------------------------------------------------------------------------------------------

DELAY, LATENESS, WIDTH = "10 minutes", timedelta(minutes=60), "1 hour"
DAYS_PER_BATCH = 3

# As the batch form, but the watermark moves after every micro-batch, not after every row.
BATCHED = DISORDERED.replace(
    "SELECT event_id, CASE", f"SELECT event_id, date_diff('day', TIMESTAMP '2024-01-01', ts) // {DAYS_PER_BATCH} AS batch, CASE"
).replace(
    "max(event_ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "max(event_ts) OVER (ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)


def disordered(spark: SparkSession, sf: str) -> DataFrame:
    """Events that come late, in micro-batches of a few days of arrival, with the last millisecond of their window."""
    days = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / DAYS_PER_BATCH)
    rows = replay.in_batches(spark, f"{sf}/events.parquet", star_views.SCHEMAS["events"], days, "event_id")
    delay = F.when(F.col("event_id") % 7 == 0, 180).when(F.col("event_id") % 5 == 0, 60).otherwise(0)
    zero = F.lit(0)
    late = rows.withColumn("event_time", (F.col("ts") - F.make_dt_interval(zero, zero, delay)).cast("timestamp"))
    marked = late.withWatermark("event_time", DELAY)
    return marked.select(
        F.col("event_id").alias("seq"), in_time.plain_time("event_time").alias("ts"), in_time.window_last("event_time", WIDTH).alias("last")
    )


@query(f"WITH {BATCHED} SELECT event_id, status FROM classified")
def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Main and side output in one, tagged by the watermark of the query itself."""
    rows = in_time.buckets(disordered(spark, sf), ["seq"], int(spark.sparkContext.defaultParallelism))
    judged = stateful.run_keyed(rows, "key", in_time.Judge(["seq"], LATENESS), "seq long, status string", "EventTime")
    return replay.drain(judged).select(F.col("seq").alias("event_id"), "status")


@query(
    f"""
    WITH {BATCHED},
    closed AS (
        SELECT epoch_ms(date_trunc('hour', event_ts)) AS window_ms, count(*) FILTER (status = 'on_time') AS n FROM classified GROUP BY 1)
    SELECT 'fire' AS kind, window_ms, n, NULL AS event_id FROM closed
    WHERE n > 0 AND window_ms + 3600000 <= (SELECT epoch_ms(max(event_ts) - INTERVAL 10 MINUTE) FROM disordered)
    UNION ALL
    SELECT 'refire', window_ms, n + row_number() OVER (PARTITION BY window_ms ORDER BY event_id), event_id
    FROM classified JOIN closed ON epoch_ms(date_trunc('hour', event_ts)) = window_ms WHERE status = 'refire'
    UNION ALL
    SELECT 'too_late', epoch_ms(date_trunc('hour', event_ts)), NULL, event_id FROM classified WHERE status = 'too_late'
    """
)
def stream_late_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every firing of windows that are kept for late rows, and the rows that come later still."""
    rows = disordered(spark, sf).withColumn("key", F.lit("all"))
    found = by_processor(rows, in_time.LateWindows(LATENESS, ("seq",)))
    return found.select("kind", (F.col("last") + 1 - 3_600_000).alias("window_ms"), "n", F.col("seq").alias("event_id"))


# -- triggers -------------------------------------------------------------------------------------------------

EVERY, SPAN = 10, timedelta(hours=12)
SPAN_MS = SPAN // timedelta(milliseconds=1)
TRIGGERED = f"""
    SELECT user_id, 'count' AS cause, epoch_us(ts) // 1000 AS at_ms, n FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % {EVERY} = 0
    UNION ALL
    SELECT user_id, 'time', at_ms, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY at_ms) AS BIGINT) FROM (
        SELECT user_id, (epoch_us(ts) // 1000 // {SPAN_MS} + 1) * {SPAN_MS} AS at_ms, count(*) AS n FROM events GROUP BY ALL)
"""


@query(TRIGGERED)
def global_window_count_or_time(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("user_id", "ts", "event_id")
    return windows.global_window_count_or_time(rows, ["user_id"], "ts", ORDER, EVERY, SPAN)


@query(f"SELECT CAST(user_id AS VARCHAR) AS key, cause, at_ms, n FROM ({TRIGGERED})")
def stream_count_or_time(spark: SparkSession, sf: str) -> DataFrame:
    rows = closed_events(spark, sf).select(
        F.col("user_id").cast("string").alias("key"), F.col("ms").alias("ts"), F.col("event_id").alias("seq")
    )
    return by_processor(rows, in_time.Trigger(EVERY, SPAN))


@query(
    """
    WITH marked AS (
        SELECT user_id, ts, event_id, value > coalesce(lag(value) OVER w, 0) AS rises
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (
        SELECT *, sum(CASE WHEN rises THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM marked),
    runs AS (SELECT user_id, g, min(ts) FILTER (WHERE rises) AS first_rise, min(ts) AS g0 FROM numbered GROUP BY user_id, g),
    ended AS (SELECT *, lead(g0) OVER (PARTITION BY user_id ORDER BY g) AS e FROM runs)
    SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(first_rise) // 1000 AS first_rise FROM ended
    WHERE first_rise IS NOT NULL AND (e IS NULL OR e > first_rise + INTERVAL 12 HOUR)
    """
)
def stream_rising_alert(spark: SparkSession, sf: str) -> DataFrame:
    """The alert of the batch form by a timer that a row without a rise deletes."""
    rows = closed_events(spark, sf).select(
        F.col("user_id").cast("string").alias("key"), F.col("ms").alias("ts"), F.col("event_id").alias("seq"), "value"
    )
    return by_processor(rows, stateful.RisingAlert(timedelta(hours=12), once=True))
