"""Middle layer: unique visitors, bounces, wide orders and wide payments."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import times
from millrace.operators import joins, ordered, patterns
from millrace.schemas import BOUNCE_TIMEOUT_MS, HOUR_FORMAT, ORDER_DETAIL_SECONDS, PAYMENT_MINUTES


def is_entry() -> Column:
    """The first page of a visit has no page before it."""
    return patterns.is_blank(F.col("page.last_page_id"))


def unique_visits(pages: DataFrame) -> DataFrame:
    """The first entry page of every device and day."""
    flat = pages.withColumn("_mid", F.col("common.mid"))
    day = F.to_date(times.millis_to_time(F.col("ts")))
    return patterns.first_of_day(flat, ["_mid"], day, ["ts", "seq"], is_entry()).drop("_mid")


def user_jumps(
    pages: DataFrame, timeout_ms: int = BOUNCE_TIMEOUT_MS, close_open: bool = True, hot_rows: int | None = None,
    cuts: ordered.Cuts | None | str = ordered.SEARCH,
) -> DataFrame:
    """Entry pages after which a device opens no other page in time. ``cuts`` may come from ``dwd.device_cuts``."""
    flat = pages.withColumn("_mid", F.col("common.mid")).withColumn("_time", times.millis_to_time(F.col("ts")))
    return patterns.bounces(
        flat,
        ["_mid"],
        "_time",
        ["_time", "seq"],
        is_entry(),
        ~patterns.is_blank(F.col("page.page_id")),
        timedelta(milliseconds=timeout_ms),
        close_open,
        hot_rows,
        cuts,
    ).drop("_mid", "_time")


# -- orders ---------------------------------------------------------------------------------------------------


def with_create_parts(df: DataFrame) -> DataFrame:
    """create_date, create_hour (time of day as text), create_hour_number and create_ts from create_time."""
    time = times.text_to_time(F.col("create_time"))
    return (
        df.withColumn("create_ts", time)
        .withColumn("create_date", F.to_date("create_ts"))
        .withColumn("create_hour", F.date_format("create_ts", HOUR_FORMAT))
        .withColumn("create_hour_number", F.hour("create_ts"))
    )


def product_dimension(sku: DataFrame, spu: DataFrame, trademark: DataFrame, category3: DataFrame) -> DataFrame:
    """The product snowflake in one flat dimension, so that facts are enriched by one join."""
    flat = joins.lookup(sku, spu, {"spu_id": "id"}, {"spu_name": "spu_name"})
    flat = joins.lookup(flat, trademark, {"tm_id": "id"}, {"tm_name": "tm_name"})
    return joins.lookup(flat, category3, {"category3_id": "id"}, {"name": "category3_name"})


PRODUCT_COLUMNS = {
    c: c for c in ("sku_name", "spu_id", "tm_id", "category3_id", "spu_name", "tm_name", "category3_name")
}
PROVINCE_COLUMNS = {
    "name": "province_name",
    "area_code": "province_area_code",
    "iso_code": "province_iso_code",
    "iso_3166_2": "province_3166_2_code",
}


def _on_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermark on streams; it lets a join forget rows that can no longer match."""
    return df.withWatermark(ts, delay) if df.isStreaming else df


def order_details(
    orders: DataFrame, details: DataFrame, delay: str = "10 seconds", carried: Sequence[str] = ()
) -> DataFrame:
    """Orders with their lines: equal order, line within some seconds of the order (also streaming).

    ``carried`` names more columns of the lines that are kept.
    """
    left = _on_time(with_create_parts(orders), "create_ts", delay).withColumnRenamed("id", "order_key")
    lines = details.select(
        F.col("id").alias("detail_id"),
        "order_id",
        "sku_id",
        "sku_num",
        "order_price",
        "split_total_amount",
        "split_activity_amount",
        "split_coupon_amount",
        *carried,
        times.text_to_time(F.col("create_time")).alias("detail_ts"),
    )
    bound = timedelta(seconds=ORDER_DETAIL_SECONDS)
    lines = _on_time(lines, "detail_ts", delay)
    joined = joins.interval_join(left, lines, {"order_key": "order_id"}, "create_ts", "detail_ts", -bound, bound, slots=False)
    return joined.drop("order_key", "detail_ts")


def enrich_order(wide: DataFrame, users: DataFrame, provinces: DataFrame, products: DataFrame, as_of: Column) -> DataFrame:
    """Age and gender of the buyer, province names, product attributes; rows without a match stay."""
    return with_product(with_province(with_buyer(wide, users, as_of), provinces), products)


def with_buyer(wide: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    out = joins.lookup(wide, users, {"user_id": "id"}, {"birthday": "_birthday", "gender": "user_gender"})
    return out.withColumn("user_age", times.whole_years(F.to_date("_birthday"), as_of)).drop("_birthday")


def with_product(wide: DataFrame, products: DataFrame) -> DataFrame:
    return joins.lookup(wide, products, {"sku_id": "id"}, PRODUCT_COLUMNS)


def with_province(wide: DataFrame, provinces: DataFrame) -> DataFrame:
    return joins.lookup(wide, provinces, {"province_id": "id"}, PROVINCE_COLUMNS)


def order_wide(
    orders: DataFrame, details: DataFrame, users: DataFrame, provinces: DataFrame, products: DataFrame, as_of: Column
) -> DataFrame:
    """Orders with their lines and what ``enrich_order`` adds (also streaming).

    Batch frames are enriched before they meet: buyers and provinces by order, products by line. The wide rows then leave the
    join dealt by order, as payments need them, and are not shuffled again.
    """
    if orders.isStreaming or details.isStreaming:
        return enrich_order(order_details(orders, details), users, provinces, products, as_of)
    bought = with_province(with_buyer(orders, users, as_of), provinces)
    of_line = list(PRODUCT_COLUMNS.values())
    wide = order_details(bought, with_product(details, products), carried=of_line)
    added = ["user_gender", "user_age", *PROVINCE_COLUMNS.values(), *of_line]
    return wide.select(*[c for c in wide.columns if c not in added], *added)




def payment_wide(payments: DataFrame, wide: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Payments with the lines of their order, placed at most some minutes before (also streaming).

    Names both sides share take the payment's value: total_amount and user_id.
    """
    paid = payments.select(
        F.col("id").alias("payment_id"),
        F.col("order_id").alias("paid_order_id"),
        "user_id",
        "total_amount",
        "subject",
        "payment_type",
        F.col("create_time").alias("payment_create_time"),
        "callback_time",
        times.text_to_time(F.col("create_time")).alias("payment_ts"),
    )
    lines = wide.drop("user_id", "total_amount").withColumnRenamed("create_time", "order_create_time")
    lines = lines.withColumnRenamed("create_ts", "order_ts")
    paid, lines = _on_time(paid, "payment_ts", delay), _on_time(lines, "order_ts", delay)
    joined = joins.interval_join(
        paid, lines, {"paid_order_id": "order_id"}, "payment_ts", "order_ts", -timedelta(minutes=PAYMENT_MINUTES), timedelta(0),
        slots=False,
    )
    return joined.drop("paid_order_id", "payment_ts", "order_ts")
