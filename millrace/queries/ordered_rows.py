"""Patterns along the rows of a key and late rows along the arrival order."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import late, patterns
from millrace.plans import dwd, dwm, star_views
from millrace.queries import query
from millrace.queries.aggregates import ORDER, events
from millrace.queries.per_row import LOG

BOUNCE_HOURS_MS = 6 * 3600 * 1000


@query(
    """
    SELECT event_id, user_id, value, before FROM (
        SELECT event_id, user_id, value,
               coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before FROM events)
    WHERE abs(value - before) >= 10
    """
)
def level_jump_alert(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("event_id", "user_id", "ts", "value")
    jumps = patterns.level_jumps(rows, ["user_id"], ORDER, "value", 10)
    return jumps.select("event_id", "user_id", "value", F.col("previous_level").alias("before"))


@query(
    """
    SELECT event_id, user_id, value, before FROM (
        SELECT event_id, user_id, value,
               coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before FROM events)
    WHERE abs(value) - before >= 10
    """
)
def level_rise_alert(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("event_id", "user_id", "ts", "value")
    jumps = patterns.level_jumps(rows, ["user_id"], ORDER, "value", 10, literal=True)
    return jumps.select("event_id", "user_id", "value", F.col("previous_level").alias("before"))


@query(
    """
    WITH marked AS (
        SELECT user_id, ts, event_id, value > coalesce(lag(value) OVER w, 0) AS rises
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (
        SELECT *, sum(CASE WHEN rises THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM marked),
    runs AS (SELECT user_id, g, min(ts) FILTER (WHERE rises) AS first_rise, min(ts) AS g0 FROM numbered GROUP BY user_id, g),
    ended AS (SELECT *, lead(g0) OVER (PARTITION BY user_id ORDER BY g) AS e FROM runs)
    SELECT user_id, first_rise FROM ended
    WHERE first_rise IS NOT NULL AND (e IS NULL OR e > first_rise + INTERVAL 12 HOUR)
    """
)
def rising_alert(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("event_id", "user_id", "ts", "value")
    return patterns.rising_alerts(rows, ["user_id"], "ts", ORDER, "value", timedelta(hours=12))


PAGES = f"""
    {LOG},
    pages AS (SELECT * FROM fixed WHERE event_type <> 'signup'),
    followed AS (SELECT *, lead(ms) OVER (PARTITION BY mid ORDER BY ms, seq) AS next_ms FROM pages)
"""


@query(
    f"""WITH {PAGES} SELECT seq, mid, ms FROM followed
    WHERE last_page_id IS NULL AND (next_ms IS NULL OR next_ms >= ms + {BOUNCE_HOURS_MS})"""
)
def bounce_detail(spark: SparkSession, sf: str) -> DataFrame:
    raw = star_views.app_log(spark, sf)
    jumps = dwm.user_jumps(dwd.page_log(dwd.parse_log(raw)), BOUNCE_HOURS_MS, cuts=dwd.device_cuts(raw))
    return jumps.select("seq", F.col("common.mid").alias("mid"), F.col("ts").alias("ms"))


@query(
    f"""WITH {PAGES} SELECT seq, mid, ms FROM followed
    WHERE last_page_id IS NULL AND coalesce(next_ms, (SELECT max(ms) FROM pages)) >= ms + {BOUNCE_HOURS_MS}"""
)
def bounce_detail_open(spark: SparkSession, sf: str) -> DataFrame:
    raw = star_views.app_log(spark, sf)
    jumps = dwm.user_jumps(dwd.page_log(dwd.parse_log(raw)), BOUNCE_HOURS_MS, close_open=False, cuts=dwd.device_cuts(raw))
    return jumps.select("seq", F.col("common.mid").alias("mid"), F.col("ts").alias("ms"))


@query(
    f"""WITH {PAGES} SELECT seq, mid, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS day FROM pages
    WHERE last_page_id IS NULL
    QUALIFY row_number() OVER (PARTITION BY mid, date_trunc('day', ts) ORDER BY ms, seq) = 1"""
)
def daily_unique_visit(spark: SparkSession, sf: str) -> DataFrame:
    visits = dwm.unique_visits(dwd.page_log(dwd.parse_log(star_views.app_log(spark, sf))))
    day = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd")
    return visits.select("seq", F.col("common.mid").alias("mid"), day.alias("day"))


# -- late rows ------------------------------------------------------------------------------------------------

# Every seventh row is three hours late, every other fifth row one hour.
DISORDERED = """
    disordered AS (
        SELECT event_id, CASE WHEN event_id % 7 = 0 THEN ts - INTERVAL 180 MINUTE
                              WHEN event_id % 5 = 0 THEN ts - INTERVAL 60 MINUTE ELSE ts END AS event_ts FROM events),
    traced AS (
        SELECT *, max(event_ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                  - INTERVAL 10 MINUTE - INTERVAL 1 MILLISECOND AS watermark,
               date_trunc('hour', event_ts) + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS last FROM disordered),
    classified AS (
        SELECT *, CASE WHEN watermark IS NULL OR last > watermark THEN 'on_time'
                       WHEN last + INTERVAL 60 MINUTE > watermark THEN 'refire' ELSE 'too_late' END AS status FROM traced)
"""


def disordered(spark: SparkSession, sf: str) -> DataFrame:
    delay = F.when(F.col("event_id") % 7 == 0, 180).when(F.col("event_id") % 5 == 0, 60).otherwise(0)
    zero = F.lit(0)
    event_ts = F.col("ts") - F.make_dt_interval(zero, zero, delay)
    return events(spark, sf).select("event_id", event_ts.alias("event_ts"))


@query(f"WITH {DISORDERED} SELECT event_id, watermark FROM traced")
def watermark_trace(spark: SparkSession, sf: str) -> DataFrame:
    traced = late.watermark_trace(disordered(spark, sf), "event_ts", ["event_id"], timedelta(minutes=10))
    return traced.select("event_id", "watermark")


@query(f"WITH {DISORDERED} SELECT event_id, status FROM classified")
def late_classify(spark: SparkSession, sf: str) -> DataFrame:
    out = late.classify_late(
        disordered(spark, sf), "event_ts", ["event_id"], "1 hour", timedelta(minutes=10), timedelta(minutes=60)
    )
    return out.select("event_id", "status")


@query(
    f"""
    WITH {DISORDERED}
    SELECT date_trunc('hour', event_ts) AS window_start, count(*) FILTER (WHERE status = 'on_time') AS first_fire,
           count(*) FILTER (WHERE status <> 'too_late') AS last_fire,
           count(*) FILTER (WHERE status = 'too_late') AS side_output
    FROM classified GROUP BY ALL
    """
)
def late_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = late.classify_late(
        disordered(spark, sf), "event_ts", ["event_id"], "1 hour", timedelta(minutes=10), timedelta(minutes=60)
    )
    return late.window_fires(rows, "event_ts", "1 hour", []).drop("window_end")
