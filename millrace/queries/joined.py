"""Interval, window, lookup, matching and control joins; wide orders and payments."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import keywords
from millrace.operators import joins
from millrace.plans import dwm, star_views
from millrace.plans.star_views import table
from millrace.queries import query

AS_OF = "2024-06-01"


def orders_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate")


def lines_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@query(
    """
    SELECT o_orderkey, o_orderdate, l_linenumber, l_partkey, l_shipdate
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey
     AND l_shipdate BETWEEN o_orderdate - INTERVAL 15 DAY AND o_orderdate + INTERVAL 15 DAY
    """
)
def interval_join_sym(spark: SparkSession, sf: str) -> DataFrame:
    return joins.interval_join(
        orders_by_date(spark, sf),
        lines_by_date(spark, sf),
        {"o_orderkey": "l_orderkey"},
        "o_orderdate",
        "l_shipdate",
        timedelta(days=-15),
        timedelta(days=15),
    ).drop("l_orderkey")


@query(
    """
    SELECT o_orderkey, o_orderdate, l_linenumber, l_partkey, l_shipdate
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey
     AND l_shipdate BETWEEN o_orderdate - INTERVAL 15 DAY AND o_orderdate
    """
)
def interval_join_asym(spark: SparkSession, sf: str) -> DataFrame:
    return joins.interval_join(
        orders_by_date(spark, sf),
        lines_by_date(spark, sf),
        {"o_orderkey": "l_orderkey"},
        "o_orderdate",
        "l_shipdate",
        timedelta(days=-15),
        timedelta(0),
    ).drop("l_orderkey")


@query(
    """
    SELECT v.user_id, date_trunc('day', v.ts) AS window_start, count(*) AS pairs
    FROM events v JOIN events c ON v.user_id = c.user_id AND date_trunc('day', v.ts) = date_trunc('day', c.ts)
    WHERE v.event_type = 'view' AND c.event_type = 'click'
    GROUP BY v.user_id, date_trunc('day', v.ts)
    """
)
def window_join(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "ts", "event_type")
    views, clicks = events.filter("event_type = 'view'"), events.filter("event_type = 'click'")
    return joins.window_join_count(views, clicks, ["user_id"], "ts", "1 day").drop("left_rows", "right_rows")


@query(
    """
    SELECT date_trunc('day', v.ts) AS window_start, v.user_id, v.event_id, v.ts, c.event_id AS right_event_id, c.ts AS right_ts
    FROM events v JOIN events c ON v.user_id = c.user_id AND date_trunc('day', v.ts) = date_trunc('day', c.ts)
    WHERE v.event_type = 'view' AND c.event_type = 'click'
    """
)
def window_join_rows(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    views, clicks = events.filter("event_type = 'view'").drop("event_type"), events.filter("event_type = 'click'").drop("event_type")
    return joins.window_join(views, clicks, ["user_id"], "ts", "1 day")


@query(
    """
    SELECT o_orderkey, o_totalprice, k AS receipt_key, n AS lines,
           CASE WHEN k IS NULL THEN 'left_only' WHEN o_orderkey IS NULL THEN 'right_only' ELSE 'matched' END AS status
    FROM orders FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = k
    """
)
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    receipts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("receipt_key"))
    return joins.reconcile(orders, receipts.agg(F.count("*").alias("lines")), {"o_orderkey": "receipt_key"})


@query(
    """
    SELECT c_custkey, c_nationkey, s_name, s_acctbal
    FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 100 = s_suppkey
    """
)
def lookup_two_columns(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", (F.col("c_custkey") % 100).alias("partner")
    )
    names = {"s_name": "s_name", "s_acctbal": "s_acctbal"}
    on = {"c_nationkey": "s_nationkey", "partner": "s_suppkey"}
    return joins.lookup(customers, table(spark, sf, "supplier"), on, names).drop("partner")


@query(
    """
    WITH control AS (SELECT ts AS since, CAST(event_id % 3 AS VARCHAR) AS mode FROM events WHERE event_type = 'signup')
    SELECT event_id, CASE mode WHEN '1' THEN 'config_1' WHEN '0' THEN 'config_0' ELSE 'config_other' END AS config
    FROM events ASOF LEFT JOIN control ON ts >= since
    """
)
def broadcast_switch(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "ts", "event_type")
    control = events.filter("event_type = 'signup'").withColumn("mode", (F.col("event_id") % 3).cast("string"))
    seen = joins.switch(events, control, "ts", ["event_id"], "mode", "mode")
    return seen.select("event_id", joins.switch_label(F.col("mode")).alias("config"))


@query(
    """
    SELECT event_id, unnest(regexp_extract_all(lower(props), '[\\p{L}\\p{N}]+')) AS word FROM events
    """
)
def lateral_keywords(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "events").select("event_id", "props").createOrReplaceTempView("event_props")
    keywords.register(spark)
    return spark.sql("SELECT event_id, word FROM event_props, LATERAL ik_analyze(props)")


# -- wide orders and payments ---------------------------------------------------------------------------------

# Orders, lines and dimensions as the star views show them.
ORDER_SQL = """
    info AS (
        SELECT o_orderkey AS id, o_custkey % 25 AS province_id, o_custkey AS user_id, o_orderstatus AS order_status,
               CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount, o_orderpriority AS payment_type,
               CAST(o_orderkey % 7 AS DECIMAL(18,2)) AS activity_reduce_amount,
               CAST(o_orderkey % 5 AS DECIMAL(18,2)) AS coupon_reduce_amount,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) + o_orderkey % 7 + o_orderkey % 5 AS DECIMAL(18,2))
                   AS original_total_amount, CAST(o_orderkey % 11 AS DECIMAL(18,2)) AS feight_fee,
               TIMESTAMP '2024-01-01' + to_minutes(o_orderkey) AS created FROM orders),
    detail AS (
        SELECT l_orderkey * 10 + l_linenumber AS detail_id, l_orderkey AS order_id, l_partkey AS sku_id,
               CAST(l_quantity AS BIGINT) AS sku_num, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
               CAST(l_linenumber % 3 AS DECIMAL(18,2)) AS split_activity_amount,
               CAST(l_linenumber % 2 AS DECIMAL(18,2)) AS split_coupon_amount,
               TIMESTAMP '2024-01-01' + to_minutes(l_orderkey) + to_seconds(l_linenumber * 2 - 9) AS line_created
        FROM lineitem),
    wide AS (
        SELECT * FROM info JOIN detail ON id = order_id
         AND line_created BETWEEN created - INTERVAL 5 SECOND AND created + INTERVAL 5 SECOND)
"""


def order_details(spark: SparkSession, sf: str) -> DataFrame:
    return dwm.order_details(star_views.order_info(spark, sf), star_views.order_detail(spark, sf))


def products(spark: SparkSession, sf: str) -> DataFrame:
    return dwm.product_dimension(
        star_views.skus(spark, sf),
        star_views.spus(spark, sf),
        star_views.trademarks(spark, sf),
        star_views.categories(spark, sf),
    )


# What a wide line has besides the order's own time, buyer and amount, and where it comes from.
WIDE_COLUMNS = f"""
    detail_id, order_id, sku_id, sku_num, amount AS order_price, amount AS split_total_amount, split_activity_amount,
    split_coupon_amount, province_id, order_status, activity_reduce_amount, coupon_reduce_amount, original_total_amount,
    feight_fee, CAST(created AS DATE) AS create_date, strftime(created, '%H:%M:%S') AS create_hour,
    CAST(hour(created) AS INTEGER) AS create_hour_number,
    CAST(date_diff('day', DATE '1950-01-01' + CAST(c_custkey % 20000 AS INTEGER), DATE '{AS_OF}') // 365 AS INTEGER)
        AS user_age,
    CASE WHEN c_custkey IS NULL THEN NULL WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS user_gender,
    n_name AS province_name, '0' || n_nationkey AS province_area_code, 'N-' || n_nationkey AS province_iso_code,
    r_name || '-' || n_nationkey AS province_3166_2_code,
    p_name AS sku_name, CAST(p_size AS BIGINT) AS spu_id, CAST(split_part(p_brand, '#', 2) AS BIGINT) AS tm_id,
    p_type AS category3_id, 'spu ' || p_size AS spu_name, p_brand AS tm_name, lower(p_type) AS category3_name
"""
WIDE_DIMENSIONS = """
    LEFT JOIN customer ON user_id = c_custkey
    LEFT JOIN nation ON province_id = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN part ON sku_id = p_partkey
"""


def wide_orders(spark: SparkSession, sf: str) -> DataFrame:
    return dwm.order_wide(
        star_views.order_info(spark, sf),
        star_views.order_detail(spark, sf),
        star_views.users(spark, sf),
        star_views.provinces(spark, sf),
        products(spark, sf),
        F.lit(AS_OF).cast("date"),
    )


@query(
    f"""
    WITH {ORDER_SQL}
    SELECT {WIDE_COLUMNS}, user_id, total_amount, strftime(created, '%Y-%m-%d %H:%M:%S') AS create_time
    FROM wide {WIDE_DIMENSIONS}
    """
)
def order_wide(spark: SparkSession, sf: str) -> DataFrame:
    return wide_orders(spark, sf).drop("create_ts")


@query(
    f"""
    WITH {ORDER_SQL},
    paid AS (
        SELECT id AS payment_id, user_id AS payer, total_amount AS paid_amount, 'order ' || id AS subject,
               payment_type AS kind, created + to_minutes(id % 20 - 1) AS paid_at FROM info)
    SELECT {WIDE_COLUMNS}, payment_id, payer AS user_id, paid_amount AS total_amount, subject, kind AS payment_type,
           strftime(paid_at, '%Y-%m-%d %H:%M:%S') AS payment_create_time,
           strftime(paid_at, '%Y-%m-%d %H:%M:%S') AS callback_time,
           strftime(created, '%Y-%m-%d %H:%M:%S') AS order_create_time
    FROM paid JOIN wide ON payment_id = order_id AND created BETWEEN paid_at - INTERVAL 15 MINUTE AND paid_at
    {WIDE_DIMENSIONS}
    """
)
def payment_wide(spark: SparkSession, sf: str) -> DataFrame:
    return dwm.payment_wide(star_views.payment_info(spark, sf), wide_orders(spark, sf))
