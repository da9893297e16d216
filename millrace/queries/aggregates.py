"""Final and rolling aggregates, top three, distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import patterns, rolling, sketches, topk
from millrace.plans.star_views import table
from millrace.queries import query
from millrace.schemas import MONEY

ORDER = ["ts", "event_id"]


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def measured(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", "ts", "user_id", F.col("value").cast(MONEY).alias("value"))


# -- final ----------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS pv FROM events WHERE event_type = 'view'")
def pv_count(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).filter("event_type = 'view'").agg(F.count("*").alias("pv"))


@query("SELECT count(DISTINCT user_id) AS uv FROM events WHERE event_type = 'view'")
def uv_count(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).filter("event_type = 'view'").agg(F.count_distinct("user_id").alias("uv"))


# Sketched numbers may be off by so many percent.
SKETCH_PERCENT = 2


@query(
    """
    SELECT date_trunc('day', ts) AS day, event_type, count(*) AS pv, count(DISTINCT user_id) AS exact_uv, true AS sketch_is_close
    FROM events GROUP BY ALL
    UNION ALL
    SELECT NULL, event_type, count(*), count(DISTINCT user_id), true FROM events GROUP BY ALL
    """
)
def uv_sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Visitors of a day and of all time, from sketches of two-second windows, beside the exact numbers."""
    rows = events(spark, sf).select("ts", "event_type", "user_id")
    mart = sketches.window_sketches(rows, "ts", "2 seconds", ["event_type"], "user_id", {"pv": F.count(F.lit(1))})
    day = F.date_trunc("day", "window_start").cast("timestamp_ntz").alias("day")
    days = mart.groupBy(day, "event_type").agg(F.hll_union_agg("visitors").alias("visitors"), F.sum("pv").alias("pv"))
    whole = days.groupBy(F.lit(None).cast("timestamp_ntz").alias("day"), "event_type").agg(
        F.hll_union_agg("visitors").alias("visitors"), F.sum("pv").alias("pv")
    )
    told = sketches.estimated(days.unionByName(whole))
    exact_day = rows.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type")
    exact = exact_day.agg(F.count_distinct("user_id").alias("exact_uv")).unionByName(
        rows.groupBy(F.lit(None).cast("timestamp_ntz").alias("day"), "event_type").agg(F.count_distinct("user_id").alias("exact_uv"))
    )
    exact = exact.withColumnsRenamed({"day": "_day", "event_type": "_type"})
    joined = told.join(exact, F.col("day").eqNullSafe(F.col("_day")) & (F.col("event_type") == F.col("_type")))
    close = F.abs(F.col("uv") - F.col("exact_uv")) * 100 <= SKETCH_PERCENT * F.col("exact_uv")
    return joined.select("day", "event_type", "pv", "exact_uv", close.alias("sketch_is_close"))


@query(
    """SELECT o_orderpriority AS channel, o_orderstatus AS behavior, count(*) AS n
    FROM orders GROUP BY o_orderpriority, o_orderstatus"""
)
def count_by_channel_behavior(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("channel"), F.col("o_orderstatus").alias("behavior")
    )
    return orders.groupBy("channel", "behavior").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    """
    SELECT s_nationkey, p_brand, count(*) AS n
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
    GROUP BY s_nationkey, p_brand
    """
)
def count_by_nation_brand(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    # Lines shrink to one row per supplier and part before they meet the dimensions.
    counted = lines.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    joined = counted.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("s_nationkey", "p_brand").agg(F.sum("n").alias("n"))


@query(
    """
    SELECT user_id, max_by(event_id, (value, ts, event_id)) AS event_id, max(value) AS value
    FROM events GROUP BY user_id
    """
)
def maxby_last(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.extreme_row(events(spark, sf), ["user_id"], ORDER, "value", ["event_id", "value"])


@query(
    """
    SELECT user_id, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) = 1
    """
)
def maxby_first(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.extreme_row(
        events(spark, sf), ["user_id"], ORDER, "value", ["event_id", "value"], last_on_ties=False
    )


@query(
    """
    SELECT user_id, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, ts, event_id) = 1
    """
)
def minby_first(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.extreme_row(
        events(spark, sf), ["user_id"], ORDER, "value", ["event_id", "value"], highest=False, last_on_ties=False
    )


@query(
    """
    SELECT user_id, event_id, value, CAST(row_number() OVER w AS BIGINT) AS rank FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, ts, event_id) QUALIFY row_number() OVER w <= 3
    """
)
def top3_per_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("user_id", "event_id", "ts", "value")
    best = topk.top_rows(rows, ["user_id"], "value", ORDER)
    return best.select("user_id", "event_id", "value", F.col("rank").cast("long").alias("rank"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_values_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.distinct_per_key(events(spark, sf), ["user_id"], "event_type")


# -- rolling: the updated value on every row ------------------------------------------------------------------

SO_FAR = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
AMOUNT = "CAST(value AS DECIMAL(18,2))"


@query(
    f"""
    SELECT event_id, user_id, CAST(sum({AMOUNT}) {SO_FAR} AS DECIMAL(18,2)) AS total,
           first_value(event_id) {SO_FAR} AS first_event_id
    FROM events
    """
)
def running_sum(spark: SparkSession, sf: str) -> DataFrame:
    out = rolling.rolling_sum(
        measured(spark, sf), ["user_id"], ORDER, F.col("value"), "total", keep_first=["event_id"]
    )
    return out.select("event_id", "user_id", F.col("total").cast(MONEY).alias("total"), "first_event_id")


@query(f"SELECT event_id, user_id, min({AMOUNT}) {SO_FAR} AS low, max({AMOUNT}) {SO_FAR} AS high FROM events")
def running_min_max(spark: SparkSession, sf: str) -> DataFrame:
    out = rolling.rolling_min_max(measured(spark, sf), ["user_id"], ORDER, F.col("value"), "low", "high")
    return out.select("event_id", "user_id", "low", "high")


@query(
    f"""
    SELECT event_id, user_id,
           CAST(CAST(sum({AMOUNT}) {SO_FAR} AS DECIMAL(18,2)) AS DOUBLE) / count(value) {SO_FAR} AS average
    FROM events
    """
)
def running_avg(spark: SparkSession, sf: str) -> DataFrame:
    out = rolling.rolling_average(measured(spark, sf), ["user_id"], ORDER, F.col("value"), "average")
    return out.select("event_id", "user_id", "average")


@query(
    """
    SELECT l.o_orderkey, l.o_custkey, CAST(sum(CAST(l.o_totalprice AS DECIMAL(18,2))) OVER w AS DECIMAL(18,2)) AS spent,
           first_value(l.o_orderpriority) OVER w AS first_priority, first_value(l.o_orderdate) OVER w AS first_date
    FROM orders l
    WINDOW w AS (PARTITION BY l.o_custkey ORDER BY l.o_orderdate, l.o_orderkey ROWS UNBOUNDED PRECEDING)
    """
)
def reduce_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.col("o_totalprice").cast(MONEY).alias("price"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("date"),
    )
    out = rolling.rolling_sum(
        orders, ["o_custkey"], ["date", "o_orderkey"], F.col("price"), "spent", keep_first=["priority", "date"]
    )
    return out.select("o_orderkey", "o_custkey", F.col("spent").cast(MONEY).alias("spent"), "first_priority", "first_date")


@query(
    """
    SELECT event_id, user_id, (max((value, ts, event_id)) OVER w)[3] AS best_event_id
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
    """
)
def running_maxby_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("event_id", "ts", "user_id", "value")
    out = rolling.rolling_extreme(rows, ["user_id"], ORDER, "value", ["event_id"])
    return out.select("event_id", "user_id", "best_event_id")


@query(
    """
    SELECT event_id, user_id, -(max((value, -event_id)) OVER w)[2] AS best_event_id
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
    """
)
def running_maxby_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("event_id", "ts", "user_id", "value")
    out = rolling.rolling_extreme(rows, ["user_id"], ORDER, "value", ["event_id"], last_on_ties=False)
    return out.select("event_id", "user_id", "best_event_id")


@query(
    """
    SELECT event_id, user_id, (min((value, event_id)) OVER w)[2] AS best_event_id
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
    """
)
def running_minby_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("event_id", "ts", "user_id", "value")
    out = rolling.rolling_extreme(
        rows, ["user_id"], ORDER, "value", ["event_id"], highest=False, last_on_ties=False
    )
    return out.select("event_id", "user_id", "best_event_id")


@query(
    f"""
    SELECT event_id, array_to_string(CAST(list_slice(list_reverse_sort(list({AMOUNT}) OVER w), 1, 3) AS VARCHAR[]), ',') AS best
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
    """
)
def running_top3(spark: SparkSession, sf: str) -> DataFrame:
    out = topk.rolling_top3(measured(spark, sf), ["user_id"], ORDER, "value", "best")
    return out.select("event_id", F.concat_ws(",", F.col("best").cast("array<string>")).alias("best"))


@query("SELECT event_id, count(*) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS pv FROM events WHERE event_type = 'view'")
def running_pv(spark: SparkSession, sf: str) -> DataFrame:
    views = events(spark, sf).filter("event_type = 'view'").select("event_id", "ts")
    return rolling.running_row_count(views, ORDER, "pv").select("event_id", "pv")


@query(
    """
    SELECT event_id, CAST(sum(is_first) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS uv
    FROM (SELECT event_id, ts, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
                                    THEN 1 ELSE 0 END AS is_first
          FROM events WHERE event_type = 'view')
    """
)
def running_uv(spark: SparkSession, sf: str) -> DataFrame:
    views = events(spark, sf).filter("event_type = 'view'").select("event_id", "ts", "user_id")
    return rolling.rolling_distinct(views, "user_id", ORDER, "uv").select("event_id", "uv")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS seen FROM events")
def running_row_count(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.running_row_count(events(spark, sf).select("event_id"), ["event_id"], "seen")
