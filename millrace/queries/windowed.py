"""Tumbling, sliding, session, global and count windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import averages
from millrace.operators import ordered, rows, windows
from millrace.queries import query
from millrace.queries.aggregates import ORDER, events, measured
from millrace.schemas import MONEY


def row_total() -> dict:
    return {"n": F.count(F.lit(1))}


@query(
    """
    SELECT event_type, time_bucket(INTERVAL 8 HOUR, ts) AS window_start,
           time_bucket(INTERVAL 8 HOUR, ts) + INTERVAL 8 HOUR AS window_end, count(*) AS n
    FROM events GROUP BY ALL
    """
)
def tumbling_count(spark: SparkSession, sf: str) -> DataFrame:
    rows_in = events(spark, sf).select("event_type", "ts")
    return windows.time_window(rows_in, "ts", "8 hours", ["event_type"], row_total())


@query(
    """
    SELECT word, time_bucket(INTERVAL 8 HOUR, ts) AS window_start, count(*) AS n
    FROM (SELECT ts, unnest(regexp_split_to_array(props, '[^a-zA-Z0-9_]+')) AS word FROM events)
    WHERE word <> '' GROUP BY ALL
    """
)
def tumbling_words(spark: SparkSession, sf: str) -> DataFrame:
    words = rows.words(events(spark, sf).select("ts", "props"), "props")
    return windows.time_window(words, "ts", "8 hours", ["word"], row_total()).drop("window_end")


@query(
    """
    SELECT event_type, window_start, count(*) AS n
    FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR])
                             AS window_start FROM events)
    GROUP BY ALL
    """
)
def sliding_count(spark: SparkSession, sf: str) -> DataFrame:
    rows_in = events(spark, sf).select("event_type", "ts")
    out = windows.time_window(rows_in, "ts", "2 hours", ["event_type"], row_total(), slide="1 hour")
    return out.drop("window_end")


@query(
    """
    SELECT word, window_start, count(*) AS n
    FROM (SELECT word, unnest([newest, newest - INTERVAL 5 HOUR]) AS window_start
          FROM (SELECT time_bucket(INTERVAL 5 HOUR, ts, TIMESTAMP '1970-01-01') AS newest,
                       unnest(regexp_split_to_array(props, '[^a-zA-Z0-9_]+')) AS word FROM events) WHERE word <> '')
    GROUP BY ALL
    """
)
def sliding_words(spark: SparkSession, sf: str) -> DataFrame:
    words = rows.words(events(spark, sf).select("ts", "props"), "props")
    return windows.time_window(words, "ts", "10 hours", ["word"], row_total(), slide="5 hours").drop("window_end")


@query(
    """
    WITH marked AS (
        SELECT user_id, ts, event_id,
               CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM marked)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n
    FROM numbered GROUP BY user_id, no
    """
)
def session_static(spark: SparkSession, sf: str) -> DataFrame:
    rows_in = events(spark, sf).select("user_id", "ts", "event_id")
    return windows.session_window(rows_in, "ts", "6 hours", ["user_id"], row_total(), ORDER)


@query(
    """
    WITH gaps AS (
        SELECT user_id, ts, event_id, ts + to_hours(CAST(length(event_type) AS INTEGER)) AS ends FROM events),
    marked AS (
        SELECT *, CASE WHEN ts <= max(ends) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                       THEN 0 ELSE 1 END AS opens
        FROM gaps),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM marked)
    SELECT user_id, min(ts) AS session_start, max(ends) AS session_end, count(*) AS n
    FROM numbered GROUP BY user_id, no
    """
)
def session_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    rows_in = events(spark, sf).select("user_id", "ts", "event_id", "event_type")
    gap = F.concat(F.length("event_type"), F.lit(" hours"))
    return windows.session_window(rows_in, "ts", gap, ["user_id"], row_total(), ORDER)


@query(
    """
    SELECT user_id, row_no, total FROM (
        SELECT user_id, row_number() OVER w AS row_no,
               CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DECIMAL(18,2)) AS total
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    WHERE row_no % 10 = 0
    """
)
def global_window_triggered(spark: SparkSession, sf: str) -> DataFrame:
    values = {"total": ordered.total(F.col("value"))}
    out = windows.global_window(measured(spark, sf), ["user_id"], ORDER, values, every=10)
    return out.select("user_id", "row_no", F.col("total").cast(MONEY).alias("total"))


@query(
    """
    SELECT user_id, CAST((rn - 1) // 3 AS BIGINT) AS window_no, CAST(sum(value) AS DECIMAL(18,2)) AS total
    FROM (SELECT user_id, CAST(value AS DECIMAL(18,2)) AS value,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
    GROUP BY user_id, (rn - 1) // 3 HAVING count(*) = 3
    """
)
def count_tumbling_3(spark: SparkSession, sf: str) -> DataFrame:
    total = {"total": F.sum("value").cast(MONEY)}
    return windows.count_tumbling(measured(spark, sf), ["user_id"], ORDER, 3, total)


@query(
    """
    SELECT user_id, rn AS row_no, n FROM (
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
               count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n
        FROM events)
    WHERE rn % 2 = 0
    """
)
def count_sliding_3_2(spark: SparkSession, sf: str) -> DataFrame:
    return windows.count_sliding(measured(spark, sf), ["user_id"], ORDER, 3, 2, row_total())


@query(
    """
    SELECT user_id, date_trunc('day', ts) AS window_start, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total
    FROM events GROUP BY ALL
    """
)
def window_reduce(spark: SparkSession, sf: str) -> DataFrame:
    total = {"total": F.sum("value").cast(MONEY)}
    return windows.time_window(measured(spark, sf), "ts", "1 day", ["user_id"], total).drop("window_end")


@query(
    """
    SELECT user_id, date_trunc('day', ts) AS window_start,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average
    FROM events GROUP BY ALL
    """
)
def window_average(spark: SparkSession, sf: str) -> DataFrame:
    average = {"average": F.sum("value").cast("double") / F.count("value")}
    return windows.time_window(measured(spark, sf), "ts", "1 day", ["user_id"], average).drop("window_end")


@query(
    """
    SELECT user_id, date_trunc('day', ts) AS window_start, round(median(value), 6) AS middle
    FROM events GROUP BY ALL
    """
)
def window_grouped_function(spark: SparkSession, sf: str) -> DataFrame:
    """An aggregate of one's own over small windows, as a grouped Pandas function."""
    middle = averages.grouped(lambda values: float(values.median()))
    rows_in = events(spark, sf).select("user_id", "ts", "value")
    found = windows.time_window(rows_in, "ts", "1 day", ["user_id"], {"middle": middle("value")})
    return found.select("user_id", "window_start", F.round("middle", 6).alias("middle"))


@query(
    """
    SELECT event_type,
           'key=' || event_type || ' window=[' || strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') || ','
           || strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') || ') rows=' || count(*) AS message
    FROM events GROUP BY event_type, date_trunc('day', ts)
    """
)
def window_report(spark: SparkSession, sf: str) -> DataFrame:
    return windows.window_report(events(spark, sf), "ts", "1 day", "event_type").select("event_type", "message")


@query(
    """
    SELECT strftime(time_bucket(INTERVAL 2 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS stt,
           strftime(time_bucket(INTERVAL 2 SECOND, ts) + INTERVAL 2 SECOND, '%Y-%m-%d %H:%M:%S') AS edt,
           event_type, count(*) AS n
    FROM events GROUP BY event_type, time_bucket(INTERVAL 2 SECOND, ts)
    """
)
def window_bounds(spark: SparkSession, sf: str) -> DataFrame:
    rows_in = events(spark, sf).select("event_type", "ts")
    return windows.with_bounds(windows.time_window(rows_in, "ts", "2 seconds", ["event_type"], row_total()))


@query(
    """
    SELECT strftime(time_bucket(INTERVAL 2 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS stt,
           strftime(time_bucket(INTERVAL 2 SECOND, ts) + INTERVAL 2 SECOND, '%Y-%m-%d %H:%M:%S') AS edt,
           user_id, count(*) AS n
    FROM events GROUP BY user_id, time_bucket(INTERVAL 2 SECOND, ts)
    """
)
def sql_tumble(spark: SparkSession, sf: str) -> DataFrame:
    events(spark, sf).createOrReplaceTempView("event_rows")
    return spark.sql(
        """
        SELECT date_format(window.start, 'yyyy-MM-dd HH:mm:ss') AS stt, date_format(window.end, 'yyyy-MM-dd HH:mm:ss') AS edt,
               user_id, count(*) AS n
        FROM event_rows GROUP BY window(ts, '2 seconds'), user_id
        """
    )
