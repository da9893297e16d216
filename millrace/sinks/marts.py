"""The marts as stored tables: laid out by day, newest version per sort key, and pushed to a database over JDBC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schemas import (
    KEYWORD_MART_KEY,
    MONEY,
    PRODUCT_MART_KEY,
    PROVINCE_MART_KEY,
    VISITOR_MART_KEY,
)
from millrace.sinks.upsert import KeyedTable

# Columns of the stored marts; whatever else a frame holds is not stored.
VISITOR_MART = """
    stt string, edt string, vc string, ch string, ar string, is_new string, uv_ct long, pv_ct long, sv_ct long,
    uj_ct long, dur_sum long, ts long
"""
PRODUCT_MART = f"""
    stt string, edt string, sku_id long, sku_name string, sku_price {MONEY}, spu_id long, spu_name string, tm_id long,
    tm_name string, category3_id string, category3_name string, display_ct long, click_ct long, favor_ct long,
    cart_ct long, order_sku_num long, order_amount {MONEY}, order_ct long, payment_amount {MONEY}, paid_order_ct long,
    refund_order_ct long, refund_amount {MONEY}, comment_ct long, good_comment_ct long, ts long
"""
PROVINCE_MART = f"""
    stt string, edt string, province_id long, province_name string, province_area_code string,
    province_iso_code string, province_3166_2_code string, order_amount {MONEY}, order_count long, ts long
"""
KEYWORD_MART = "stt string, edt string, keyword string, source string, ct long, ts long"

MARTS = {
    "visitor_stats": (VISITOR_MART, VISITOR_MART_KEY),
    "product_stats": (PRODUCT_MART, PRODUCT_MART_KEY),
    "province_stats": (PROVINCE_MART, PROVINCE_MART_KEY),
    "keyword_stats": (KEYWORD_MART, KEYWORD_MART_KEY),
}


def mart(spark: SparkSession, root: str, name: str) -> KeyedTable:
    """The stored mart of that name; created when missing."""
    schema, keys = MARTS[name]
    table = KeyedTable(spark, f"{root}/{name}", f"{schema}, dt string", (*keys, "dt"), ("ts",), ("dt",))
    table.create()
    return table


def store(table: KeyedTable, rows: DataFrame, batch_id: int) -> None:
    """Store mart rows under the day their window starts on."""
    table.apply(rows.withColumn("dt", F.substring("stt", 1, 10)), batch_id)


def write_jdbc(
    df: DataFrame, url: str, table: str, columns: Sequence[str], batch_rows: int = 1000, **options: str
) -> None:
    """Insert the named columns into a database table, in batches; every task opens and closes one connection."""
    writer = df.select(*columns).write.format("jdbc").mode("append").options(**options)
    writer.option("url", url).option("dbtable", table).option("batchsize", batch_rows).save()


def print_rows(df: DataFrame, label: str, rows: int = 20) -> None:
    """Show a few rows under a label."""
    print(label)
    df.show(rows, truncate=False)
