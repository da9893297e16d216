"""Per-row transforms, scalar functions, redistribution, typed reading, log and change-feed splitting."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import times
from millrace.operators import exchange, patterns, rows
from millrace.plans import dwd, star_views
from millrace.plans.star_views import table
from millrace.queries import query
from millrace.sources import readers


# -- map, flat map, filter, union -----------------------------------------------------------------------------


@query("SELECT event_id, event_id * 2 AS doubled FROM events")
def map_double(spark: SparkSession, sf: str) -> DataFrame:
    return rows.map_rows(table(spark, sf, "events"), event_id=F.col("event_id"), doubled=F.col("event_id") * 2)


@query("SELECT event_id, unnest([event_id * 2, event_id * 3]) AS multiple FROM events")
def flatmap_2x3x(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id")
    return rows.flat_map(events, "multiple", F.col("event_id") * 2, F.col("event_id") * 3)


@query("SELECT event_id, user_id FROM events WHERE event_id % 2 = 0")
def filter_even(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id").filter(F.col("event_id") % 2 == 0)


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM events")
def key_parity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", rows.parity(F.col("event_id")).alias("parity"))


@query("SELECT event_id AS id, value AS vc FROM events")
def process_project(spark: SparkSession, sf: str) -> DataFrame:
    return rows.map_rows(table(spark, sf, "events"), id=F.col("event_id"), vc=F.col("value"))


@query("SELECT user_id AS current_key, event_id, 'key ' || user_id || ' row ' || event_id AS line FROM events")
def keyed_process(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws(" ", F.lit("key"), F.col("user_id"), F.lit("row"), F.col("event_id"))
    return rows.map_rows(table(spark, sf, "events"), current_key=F.col("user_id"), event_id=F.col("event_id"), line=line)


@query("SELECT event_id, event_id * 10 AS scaled FROM events")
def rich_map(spark: SparkSession, sf: str) -> DataFrame:
    def each(factor: object, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("event_id")
        return pa.RecordBatch.from_arrays([ids, pc.multiply(ids, factor)], names=["event_id", "scaled"])

    events = table(spark, sf, "events").select("event_id")
    return rows.rich_map(events, lambda: 10, each, "event_id long, scaled long")


@query(
    "SELECT l_orderkey AS id FROM lineitem UNION ALL SELECT o_orderkey FROM orders UNION ALL SELECT c_custkey FROM customer"
)
def union_all_3(spark: SparkSession, sf: str) -> DataFrame:
    return rows.union_all(
        [
            table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")),
            table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")),
            table(spark, sf, "customer").select(F.col("c_custkey").alias("id")),
        ]
    )


@query(
    """
    SELECT 'customer' AS side, c_custkey AS key, c_name AS name, NULL::DOUBLE AS price FROM customer
    UNION ALL SELECT 'order', o_orderkey, NULL, o_totalprice FROM orders
    """
)
def connect_two(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    return rows.connect({"customer": customers, "order": orders})


@query(
    """
    SELECT word, count(*) AS n
    FROM (SELECT unnest(regexp_split_to_array(props, '[^a-zA-Z0-9_]+')) AS word FROM events)
    WHERE word <> '' GROUP BY word
    """
)
def word_split(spark: SparkSession, sf: str) -> DataFrame:
    return rows.words(table(spark, sf, "events").select("props"), "props").groupBy("word").agg(F.count("*").alias("n"))


# -- redistribution -------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey")
def exchange_by_key(spark: SparkSession, sf: str) -> DataFrame:
    keyed = exchange.by_key(table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), "key")
    return keyed.groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events")
def exchange_at_random(spark: SparkSession, sf: str) -> DataFrame:
    return exchange.at_random(table(spark, sf, "events").select("event_id"), 8)


@query("SELECT event_id FROM events")
def exchange_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return exchange.round_robin(table(spark, sf, "events").select("event_id"), 8)


@query("SELECT event_id FROM events")
def exchange_rescale(spark: SparkSession, sf: str) -> DataFrame:
    return exchange.rescale(exchange.round_robin(table(spark, sf, "events").select("event_id"), 8), 2)


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def exchange_to_all(spark: SparkSession, sf: str) -> DataFrame:
    nations = exchange.to_all(table(spark, sf, "nation").select("n_nationkey", "n_name"), max_rows=10_000)
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


# -- scalar functions -----------------------------------------------------------------------------------------


@query(
    """
    SELECT event_id,
           epoch_us(ts) // 1000 AS ms,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS text,
           strftime(ts, '%Y-%m-%d') AS day,
           CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day_number,
           epoch_us(date_trunc('second', ts)) // 1000 AS parsed_ms,
           date_trunc('second', ts) + INTERVAL 2 SECOND AS later
    FROM events
    """
)
def time_functions(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    text = times.millis_to_text(F.col("ms"))
    return (
        table(spark, sf, "events")
        .select("event_id", ms.alias("ms"))
        .select(
            "event_id",
            "ms",
            text.alias("text"),
            times.millis_to_day(F.col("ms")).alias("day"),
            times.day_number(times.millis_to_time(F.col("ms"))).alias("day_number"),
            times.text_to_millis(text).alias("parsed_ms"),
            (times.text_to_time(text) + F.expr("INTERVAL 2 SECONDS")).cast("timestamp_ntz").alias("later"),
        )
    )


@query(
    """
    SELECT o_orderkey,
           upper(o_orderstatus) AS status,
           o_orderstatus || '_' || o_orderpriority AS label,
           length(o_orderpriority) AS label_length,
           split_part(o_orderpriority, '-', 1) AS rank,
           coalesce(o_orderstatus, '') = '' AS blank
    FROM orders
    """
)
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.upper("o_orderstatus").alias("status"),
        F.concat("o_orderstatus", F.lit("_"), "o_orderpriority").alias("label"),
        F.length("o_orderpriority").cast("long").alias("label_length"),
        F.split("o_orderpriority", "-")[0].alias("rank"),
        patterns.is_blank(F.col("o_orderstatus")).alias("blank"),
    )


@query(
    """
    SELECT c_custkey,
           abs(CAST(c_acctbal AS DECIMAL(18,2))) AS size,
           greatest(CAST(c_acctbal AS DECIMAL(18,2)), 0::DECIMAL(18,2)) AS credit,
           c_custkey % 7 AS remainder,
           c_custkey // 7 AS quotient,
           CAST(CAST(c_acctbal AS DECIMAL(18,2)) + 1.50::DECIMAL(18,2) AS DECIMAL(18,2)) AS with_fee
    FROM customer
    """
)
def number_functions(spark: SparkSession, sf: str) -> DataFrame:
    balance = F.col("c_acctbal").cast("decimal(18,2)")
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.abs(balance).alias("size"),
        F.greatest(balance, F.lit(0).cast("decimal(18,2)")).alias("credit"),
        (F.col("c_custkey") % 7).alias("remainder"),
        F.expr("c_custkey div 7").alias("quotient"),
        (balance + F.expr("1.50BD")).cast("decimal(18,2)").alias("with_fee"),
    )


@query("SELECT event_id, props->>'k' AS k, 1::BIGINT AS entries, '{\"k\":\"' || (props->>'k') || '\"}' AS json FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    parsed = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("map"))
    return parsed.select(
        "event_id",
        F.col("map")["k"].alias("k"),
        F.size("map").cast("long").alias("entries"),
        F.to_json("map").alias("json"),
    )


@query("SELECT o_orderkey AS order_id, o_orderstatus AS event_type, o_orderpriority AS tx_id, o_custkey AS event_time FROM orders")
def csv_typed_scan(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "orders").select(
        F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey").alias("value")
    )
    return readers.typed_lines(lines, "order_id long, event_type string, tx_id string, event_time long")


# -- behaviour log --------------------------------------------------------------------------------------------

# The log as rows: what app_log writes as JSON.
LOG = """
    log AS (
        SELECT event_id AS seq, ts, epoch_us(ts) // 1000 AS ms, event_type, CAST(user_id AS VARCHAR) AS mid,
               'ar' || (user_id % 5) AS ar, 'ch' || (user_id % 3) AS ch, 'v' || (user_id % 2) AS vc,
               CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE 0 END AS flagged,
               CAST(floor(value * 100) AS BIGINT) AS during_time,
               CASE event_type WHEN 'click' THEN props WHEN 'purchase' THEN CAST(event_id % 200 AS VARCHAR) END AS item,
               CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'search'
                               WHEN 'purchase' THEN 'good_detail' ELSE 'good_list' END AS page_id,
               CASE event_type WHEN 'purchase' THEN 'search' WHEN 'view' THEN NULL ELSE 'home' END AS last_page_id
        FROM events),
    fixed AS (
        SELECT *, CASE WHEN flagged = 1 AND sum(flagged) OVER (PARTITION BY mid ORDER BY ms, seq) = 1
                       THEN '1' ELSE '0' END AS is_new
        FROM log)
"""


def repaired_log(spark: SparkSession, sf: str) -> DataFrame:
    raw = star_views.app_log(spark, sf)
    return dwd.repair_new_visitors(dwd.parse_log(raw), dwd.device_cuts(raw))


@query(f"WITH {LOG} SELECT seq, mid, ms, flagged::VARCHAR AS was_new, is_new FROM fixed")
def new_user_fix(spark: SparkSession, sf: str) -> DataFrame:
    raw = star_views.app_log(spark, sf)
    log = dwd.parse_log(raw).withColumn("was_new", F.col("common.is_new"))
    return dwd.repair_new_visitors(log, dwd.device_cuts(raw)).select(
        "seq", F.col("common.mid").alias("mid"), F.col("ts").alias("ms"), "was_new", F.col("common.is_new").alias("is_new")
    )


@query(f"WITH {LOG} SELECT seq, mid, is_new, 'icon' AS entry, ms FROM fixed WHERE event_type = 'signup'")
def log_start(spark: SparkSession, sf: str) -> DataFrame:
    return dwd.start_log(repaired_log(spark, sf)).select(
        "seq",
        F.col("common.mid").alias("mid"),
        F.col("common.is_new").alias("is_new"),
        F.col("start")["entry"].alias("entry"),
        F.col("ts").alias("ms"),
    )


@query(
    f"""WITH {LOG} SELECT seq, mid, is_new, page_id, last_page_id, item, during_time, ms
    FROM fixed WHERE event_type <> 'signup'"""
)
def log_page(spark: SparkSession, sf: str) -> DataFrame:
    return dwd.page_log(repaired_log(spark, sf)).select(
        "seq",
        F.col("common.mid").alias("mid"),
        F.col("common.is_new").alias("is_new"),
        "page.page_id",
        "page.last_page_id",
        "page.item",
        "page.during_time",
        F.col("ts").alias("ms"),
    )


@query(
    """
    SELECT event_id AS seq, 'good_list' AS page_id, d.item AS item, d.item_type AS item_type
    FROM events, unnest([{'item': CAST(event_id % 200 AS VARCHAR), 'item_type': 'sku_id'},
                         {'item': 'sale', 'item_type': 'activity_id'}]) AS t(d)
    WHERE event_type = 'error'
    """
)
def log_display(spark: SparkSession, sf: str) -> DataFrame:
    return dwd.display_log(dwd.parse_log(star_views.app_log(spark, sf)))


# -- change feed ----------------------------------------------------------------------------------------------


@query(
    """
    SELECT o_orderkey AS seq, 'dwd_order_info' AS topic,
           '{"id":"' || o_orderkey || '","user_id":"' || o_custkey || '"}' AS value
    FROM orders WHERE o_orderstatus = 'O'
    UNION ALL
    SELECT o_orderkey, 'dwd_order_update',
           '{"id":"' || o_orderkey || '","user_id":"' || o_custkey || '","priority":"' || o_orderpriority || '"}'
    FROM orders WHERE o_orderstatus = 'F'
    """
)
def cdc_facts(spark: SparkSession, sf: str) -> DataFrame:
    routed = dwd.route(dwd.parse_changes(star_views.change_log(spark, sf)), star_views.routes(spark))
    return dwd.facts(routed).select("seq", "topic", F.to_json("data").alias("value"))


@query(
    """
    SELECT c_custkey AS seq, 'insert' AS type, c_mktsegment AS segment, 'DIM_USER_INFO' AS sink FROM customer
    UNION ALL SELECT c_custkey + 1000000000000, 'update', lower(c_mktsegment), 'DIM_USER_INFO' FROM customer
    """
)
def cdc_history(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of a user as it is routed: rows loaded from history count as inserts."""
    routed = dwd.route(dwd.parse_changes(star_views.change_log(spark, sf)), star_views.routes(spark))
    users = routed.filter("table = 'user_info'")
    return users.select("seq", "type", F.col("data")["segment"].alias("segment"), F.upper("sink_table").alias("sink"))


@query(
    """
    SELECT 'DIM_USER_INFO' AS dim, CAST(c_custkey AS VARCHAR) AS pk,
           '{"id":"' || c_custkey || '","name":"' || c_name || '","segment":"' || lower(c_mktsegment) || '"}' AS value
    FROM customer
    UNION ALL
    SELECT 'DIM_SKU_INFO', CAST(p_partkey AS VARCHAR), '{"id":"' || p_partkey || '","sku_name":"' || p_name || '"}'
    FROM part WHERE p_size >= 10 AND p_size < 40
    """
)
def cdc_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    routed = dwd.route(dwd.parse_changes(star_views.change_log(spark, sf)), star_views.routes(spark))
    return dwd.latest_dimension_rows(dwd.dimensions(routed)).select("dim", "pk", F.to_json("data").alias("value"))


@query(
    """
    SELECT o_orderkey AS seq, 'order_info' AS "table",
           CASE o_orderstatus WHEN 'O' THEN 'insert' WHEN 'F' THEN 'update' ELSE 'delete' END AS type FROM orders
    UNION ALL SELECT c_custkey, 'user_info', 'bootstrap-insert' FROM customer
    UNION ALL SELECT c_custkey + 1000000000000, 'user_info', 'update' FROM customer
    UNION ALL SELECT p_partkey, 'sku_info', 'insert' FROM part WHERE p_size >= 10 AND p_size < 40
    """
)
def cdc_usable(spark: SparkSession, sf: str) -> DataFrame:
    return dwd.parse_changes(star_views.change_log(spark, sf)).select("seq", "table", "type")


@query(
    """SELECT o_orderkey AS seq, '{"id":"' || o_orderkey || '","priority":"' || o_orderpriority || '"}' AS kept FROM orders
    UNION ALL SELECT c_custkey, '{"id":"' || c_custkey || '"}' FROM customer
    UNION ALL SELECT c_custkey + 1000000000000, '{"id":"' || c_custkey || '"}' FROM customer
    UNION ALL SELECT p_partkey, '{"id":"' || p_partkey || '"}' FROM part WHERE p_size >= 10 AND p_size < 40"""
)
def keep_columns(spark: SparkSession, sf: str) -> DataFrame:
    changes = dwd.parse_changes(star_views.change_log(spark, sf))
    return changes.select("seq", F.to_json(dwd.keep_columns(F.col("data"), F.lit("id,priority"))).alias("kept"))
