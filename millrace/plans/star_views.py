"""The star-schema test tables seen as the feeds of the warehouse.

Everything is derived from the given tables by row expressions; no table is cut down. The mapping is free, but fixed:
queries and their SQL counterparts rely on it.

events   -> behaviour log: signup = start, view = entry page, click = search page, purchase = product page,
            error = list page with two displays; favourites and carts
orders   -> order_info, one order a minute from 2024-01-01; payment_info, -1 to 18 minutes after the order
lineitem -> order_detail, -7 to +5 seconds around its order; refunds and comments
customer, nation, region, part -> dimensions
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import exchange
from millrace.schemas import MONEY, ROUTE, TIME_FORMAT
from millrace.session import configure

ORDER_EPOCH = "2024-01-01 00:00:00"
PRODUCTS = 200


# Columns of the tables, so that opening one reads no file.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table that costly row work follows."""
    return exchange.spread_small(table(spark, sf_dir, name).select(*columns))


# -- behaviour ------------------------------------------------------------------------------------------------


def _text(column: Column) -> Column:
    return column.cast("string")


def app_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines with their sequence number."""
    return as_app_log(spread(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props"))


def as_app_log(events: DataFrame) -> DataFrame:
    """The same for a frame of events, which may be a stream."""
    kind, user, number = F.col("event_type"), F.col("user_id"), F.col("event_id")
    none = F.lit(None).cast("string")
    common = F.struct(
        F.concat(F.lit("ar"), _text(user % 5)).alias("ar"),
        F.concat(F.lit("ch"), _text(user % 3)).alias("ch"),
        F.when(kind.isin("signup", "view"), "1").otherwise("0").alias("is_new"),
        _text(user).alias("mid"),
        F.concat(F.lit("v"), _text(user % 2)).alias("vc"),
    )
    page = F.struct(
        F.floor(F.col("value") * 100).cast("long").alias("during_time"),
        F.when(kind == "click", F.col("props")).when(kind == "purchase", _text(number % PRODUCTS)).alias("item"),
        F.when(kind == "click", "keyword").when(kind == "purchase", "sku_id").alias("item_type"),
        F.when(kind == "purchase", "search").when(kind != "view", "home").otherwise(none).alias("last_page_id"),
        F.when(kind == "view", "home")
        .when(kind == "click", "search")
        .when(kind == "purchase", "good_detail")
        .otherwise("good_list")
        .alias("page_id"),
    )
    displays = F.array(
        F.struct(_text(number % PRODUCTS).alias("item"), F.lit("sku_id").alias("item_type")),
        F.struct(F.lit("sale").alias("item"), F.lit("activity_id").alias("item_type")),
    )
    log = F.struct(
        common.alias("common"),
        F.when(kind != "signup", page).alias("page"),
        F.when(kind == "signup", F.struct(F.lit("icon").alias("entry"))).alias("start"),
        F.when(kind == "error", displays).alias("displays"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
    )
    return events.select(number.alias("seq"), F.to_json(log).alias("value"))


def product_marks(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """Favourites (views) or carts (clicks) as records with sku_id and create_time."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == event_type)
    return events.select(
        (F.col("event_id") % PRODUCTS).alias("sku_id"), F.date_format("ts", TIME_FORMAT).alias("create_time")
    )


# -- orders ---------------------------------------------------------------------------------------------------


def _order_time(key: Column, seconds: Column) -> Column:
    start = F.unix_timestamp(F.lit(ORDER_EPOCH).cast("timestamp"))
    return F.date_format(F.timestamp_seconds(start + key * 60 + seconds), TIME_FORMAT)


def order_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    key, total = F.col("o_orderkey"), F.col("o_totalprice").cast(MONEY)
    return orders.select(
        key.alias("id"),
        (F.col("o_custkey") % 25).alias("province_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("order_status"),
        total.alias("total_amount"),
        (key % 7).cast(MONEY).alias("activity_reduce_amount"),
        (key % 5).cast(MONEY).alias("coupon_reduce_amount"),
        (total + key % 7 + key % 5).cast(MONEY).alias("original_total_amount"),
        (key % 11).cast(MONEY).alias("feight_fee"),
        _order_time(key, F.lit(0)).alias("create_time"),
    )


def order_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(
        spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
    )
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("sku_id"),
        F.col("l_quantity").cast("long").alias("sku_num"),
        F.col("l_extendedprice").cast(MONEY).alias("order_price"),
        F.col("l_extendedprice").cast(MONEY).alias("split_total_amount"),
        (F.col("l_linenumber") % 3).cast(MONEY).alias("split_activity_amount"),
        (F.col("l_linenumber") % 2).cast(MONEY).alias("split_coupon_amount"),
        _order_time(F.col("l_orderkey"), F.col("l_linenumber") * 2 - 9).alias("create_time"),
    )


def payment_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = _order_time(F.col("o_orderkey"), (F.col("o_orderkey") % 20 - 1) * 60)
    orders = spread(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        F.concat(F.lit("order "), _text(F.col("o_orderkey"))).alias("subject"),
        F.col("o_orderpriority").alias("payment_type"),
        time.alias("create_time"),
        time.alias("callback_time"),
    )


def refund_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_extendedprice", "l_returnflag")
    lines = lines.filter("l_returnflag = 'R'")
    return lines.select(
        F.col("l_partkey").alias("sku_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_extendedprice").cast(MONEY).alias("refund_amount"),
        _order_time(F.col("l_orderkey"), F.lit(3600)).alias("create_time"),
    )


def comment_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_quantity", "l_returnflag")
    lines = lines.filter("l_returnflag = 'N'")
    return lines.select(
        F.col("l_partkey").alias("sku_id"),
        F.when(F.col("l_quantity") >= 25, "1203").otherwise("1201").alias("appraise"),
        _order_time(F.col("l_orderkey"), F.lit(7200)).alias("create_time"),
    )


# -- dimensions -----------------------------------------------------------------------------------------------


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    birthday = F.date_add(F.lit("1950-01-01").cast("date"), (key % 20000).cast("int"))
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.date_format(birthday, "yyyy-MM-dd").alias("birthday"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
    )


def provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("0"), _text(F.col("n_nationkey"))).alias("area_code"),
        F.concat(F.lit("N-"), _text(F.col("n_nationkey"))).alias("iso_code"),
        F.concat_ws("-", F.col("r_name"), _text(F.col("n_nationkey"))).alias("iso_3166_2"),
    )


def skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("sku_name"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
        F.col("p_size").cast("long").alias("spu_id"),
        F.substring_index("p_brand", "#", -1).cast("long").alias("tm_id"),
        F.col("p_type").alias("category3_id"),
    )


def spus(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("id")).distinct()
    return sizes.withColumn("spu_name", F.concat(F.lit("spu "), _text(F.col("id"))))


def trademarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tm_name")).distinct()
    return brands.withColumn("id", F.substring_index("tm_name", "#", -1).cast("long"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "part").select(F.col("p_type").alias("id")).distinct()
    return kinds.withColumn("name", F.lower("id"))


# -- change feed ----------------------------------------------------------------------------------------------


def _change(seq: Column, name: Column, kind: Column, data: Column) -> list[Column]:
    """Null parts are left out of the envelope."""
    return [seq.alias("seq"), F.to_json(F.struct(name.alias("table"), kind.alias("type"), data.alias("data"))).alias("value")]


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers and parts as JSON change envelopes.

    Orders are inserted, updated or deleted by status. Customers are loaded from history, then each has its segment
    updated. Large parts name no table, the largest have no data, and small ones an empty record.
    """
    order_type = F.when(F.col("o_orderstatus") == "O", "insert").when(F.col("o_orderstatus") == "F", "update")
    orders = spread(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").select(
        *_change(
            F.col("o_orderkey"),
            F.lit("order_info"),
            order_type.otherwise("delete"),
            F.struct(
                _text(F.col("o_orderkey")).alias("id"),
                _text(F.col("o_custkey")).alias("user_id"),
                F.col("o_orderpriority").alias("priority"),
            ),
        )
    )
    customer = spread(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")

    def user(segment: Column) -> Column:
        return F.struct(
            _text(F.col("c_custkey")).alias("id"),
            F.col("c_name").alias("name"),
            segment.alias("segment"),
            _text(F.col("c_nationkey")).alias("nation"),
        )

    loaded = customer.select(
        *_change(F.col("c_custkey"), F.lit("user_info"), F.lit("bootstrap-insert"), user(F.col("c_mktsegment")))
    )
    updated = customer.select(
        *_change(F.col("c_custkey") + 10**12, F.lit("user_info"), F.lit("update"), user(F.lower("c_mktsegment")))
    )
    size = F.col("p_size")
    parts = table(spark, sf_dir, "part").select(
        *_change(
            F.col("p_partkey"),
            F.when(size < 40, "sku_info"),
            F.lit("insert"),
            F.when(
                size < 45,
                F.struct(
                    F.when(size >= 10, _text(F.col("p_partkey"))).alias("id"),
                    F.when(size >= 10, F.col("p_name")).alias("sku_name"),
                ),
            ),
        )
    )
    return orders.unionByName(loaded).unionByName(updated).unionByName(parts)


USER_VERSIONS = 5


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of customers in time: loaded before the first order, then moved to another segment again and again; the last
    change deletes every eleventh one. Half of all changes have a second one at the same instant, which counts."""
    key, step = F.col("c_custkey"), F.col("step")
    minutes = F.when(step == 0, -1).otherwise(key % 211 + step * step * 300)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(ORDER_EPOCH).cast("timestamp")) + minutes * 60)
    moved = F.concat_ws("/", F.lower("c_mktsegment"), _text(step), _text(F.col("again")))
    customers = spread(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    steps = customers.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(USER_VERSIONS))))
    both = F.sequence(F.lit(0), (key + step).cast("int") % 2)
    return steps.withColumn("again", F.explode(both)).select(
        key.alias("id"),
        at.cast("timestamp_ntz").alias("changed_at"),
        (key * 100 + step * 2 + F.col("again")).alias("seq"),
        moved.alias("segment"),
        F.when((step == USER_VERSIONS) & (key % 11 == 0), "delete").otherwise("update").alias("type"),
    )


def routes(spark: SparkSession) -> DataFrame:
    """The routing table: a handful of rules, as configuration has them."""
    return spark.createDataFrame(
        [
            ("order_info", "insert", "kafka", "dwd_order_info", "id,user_id", None, None),
            ("order_info", "update", "kafka", "dwd_order_update", "", None, None),
            ("user_info", "insert", "hbase", "dim_user_info", "id,name,segment", "id", None),
            ("user_info", "update", "hbase", "dim_user_info", "id,name,segment", "id", None),
            ("sku_info", "insert", "hbase", "dim_sku_info", "id, sku_name", None, None),
        ],
        ROUTE,
    )
