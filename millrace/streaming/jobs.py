"""Micro-batch jobs of the warehouse: each reads topics, applies a plan and writes topics, dimensions or marts.

Jobs are coupled only through topics, so each can be stopped and restarted by itself from its checkpoint. A repeated
micro-batch replaces what it wrote before. Dimensions and the routing table are read anew in every batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace import schemas
from millrace.operators import late, patterns
from millrace.plans import dwd, dwm, dws
from millrace.session import configure_streaming
from millrace.sinks import dimensions, marts, topics as topic_sink
from millrace.sources import topics as topic_source
from millrace.streaming import in_time, stateful

Batch = Callable[[DataFrame, int], None]

# Not a topic of the blueprint: lines of the behaviour log that no plan takes.
DWD_REJECTED = "dwd_rejected_log"

RAW_FEEDS = (schemas.ODS_LOG, schemas.ODS_CHANGES)


@dataclass(frozen=True)
class Warehouse:
    """Folders of a warehouse: ``root`` holds topics, dimensions and marts; ``checkpoints`` the progress of the jobs.

    Both must be on storage every executor can reach. ``files_per_batch`` bounds a micro-batch of the raw feeds. Topics
    written by a job are read in whole batches, which appear in one rename: the files of a batch hold its rows in no
    order of time, and a watermark taken after some of them would drop rows of the others.
    """

    spark: SparkSession
    root: str
    checkpoints: str
    files_per_batch: int | None = None

    def __post_init__(self) -> None:
        configure_streaming(self.spark)

    @property
    def topic_root(self) -> str:
        return f"{self.root}/topics"

    def read(self, topic: str, streaming: bool = True) -> DataFrame:
        topic_source.ensure_folder(self.spark, self.topic_root, topic)
        limit = self.files_per_batch if topic in RAW_FEEDS else None
        return topic_source.read_folder(self.spark, self.topic_root, topic, streaming, limit)

    def write(self, df: DataFrame, topic: str, batch_id: int) -> None:
        topic_sink.append_folder(topic_sink.to_records(df, topic), self.topic_root, batch_id)

    def run(
        self, df: DataFrame, name: str, each: Batch, mode: str = "append", every: str | None = None
    ) -> StreamingQuery:
        """Process everything present, batch by batch, then stop; with ``every``, run on at that pace."""
        writer = df.writeStream.queryName(name).outputMode(mode).foreachBatch(each)
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        return writer.option("checkpointLocation", f"{self.checkpoints}/{name}").start()


# -- detail layer ---------------------------------------------------------------------------------------------


def log_job(house: Warehouse) -> StreamingQuery:
    """Split the behaviour log into start, page and display topics, with the new-visitor flag repaired.

    Lines that are neither go to a topic of their own, which counts them. (A line without a device has no key and reaches no
    processor; it is one of them only in batch.)
    """
    raw = house.read(schemas.ODS_LOG).select("seq", "value")
    keyed = dwd.parse_log(raw, ("seq", "value")).select(
        F.col("common.mid").alias("mid"), "seq", "ts", F.col("common.is_new").alias("is_new"), "value"
    )
    fixed = stateful.run_keyed(keyed, "mid", stateful.NewVisitor(), stateful.NewVisitor.SCHEMA)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        log = dwd.parse_log(batch, ("seq", "is_new"))
        log = log.withColumn("common", F.col("common").withField("is_new", F.col("is_new"))).drop("is_new")
        house.write(dwd.start_log(log), schemas.DWD_START, batch_id)
        house.write(dwd.page_log(log), schemas.DWD_PAGE, batch_id)
        house.write(dwd.display_log(log), schemas.DWD_DISPLAY, batch_id)
        house.write(dwd.rejected_log(log), DWD_REJECTED, batch_id)
        batch.unpersist()

    return house.run(fixed, "log_job", each)


def change_job(house: Warehouse, read_config: Callable[[], DataFrame]) -> StreamingQuery:
    """Route the change feed: facts to their topics, dimension rows to the dimension table."""
    table = dimensions.dimensions(house.spark, house.root)

    def each(batch: DataFrame, batch_id: int) -> None:
        routed = dwd.route(dwd.parse_changes(batch), read_config()).persist()
        topic_sink.append_folder(topic_sink.fact_records(dwd.facts(routed)), house.topic_root, batch_id)
        table.apply(dwd.dimensions(routed), batch_id)
        routed.unpersist()

    return house.run(house.read(schemas.ODS_CHANGES).select("seq", "value"), "change_job", each)


# -- middle layer ---------------------------------------------------------------------------------------------


def _pages(house: Warehouse) -> DataFrame:
    return dwd.parse_log(house.read(schemas.DWD_PAGE).select("seq", "value"), ("seq", "value"))


def _pass_on(house: Warehouse, topic: str) -> Batch:
    """Write rows that carry their JSON text to a topic unchanged."""

    def each(batch: DataFrame, batch_id: int) -> None:
        records = batch.select(F.col("mid").alias("key"), "value", "seq", F.lit(topic).alias("topic"))
        topic_sink.append_folder(records, house.topic_root, batch_id)

    return each


def unique_visit_job(house: Warehouse, delay: str = "1 day", by_clock: bool = False) -> StreamingQuery:
    """First entry page of a device and day; the state of a device expires after a day.

    ``by_clock`` lets the state store expire it and runs until stopped.
    """
    entries = _pages(house).filter(dwm.is_entry())
    keyed = entries.select(
        F.col("common.mid").alias("mid"), "seq", "ts", "value", F.timestamp_millis("ts").alias("event_time")
    )
    each = _pass_on(house, schemas.DWM_UNIQUE_VISIT)
    if by_clock:
        visit = stateful.DailyVisit(ttl_ms=stateful.DAY_MS)
        visits = stateful.run_keyed(keyed, "mid", visit, visit.SCHEMA, time_mode="ProcessingTime")
        return house.run(visits, "unique_visit_job", each, every="5 seconds")
    visit = stateful.DailyVisit()
    visits = stateful.run_keyed(keyed.withWatermark("event_time", delay), "mid", visit, visit.SCHEMA, "EventTime")
    return house.run(visits, "unique_visit_job", each)


def unique_visits_by_event_time(pages: DataFrame, delay: str = "1 day") -> DataFrame:
    """The same with event time only: the first row of a device and day within the watermark (any, not the oldest)."""
    time = F.timestamp_millis("ts")
    entries = pages.filter(dwm.is_entry()).select(
        F.col("common.mid").alias("mid"), F.to_date(time).alias("day"), time.alias("event_time")
    )
    return entries.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["mid", "day"])


def user_jump_job(house: Warehouse, timeout: timedelta | None = None, delay: str = "0 seconds") -> StreamingQuery:
    """Entry pages without another page in time."""
    timeout = timeout or timedelta(milliseconds=schemas.BOUNCE_TIMEOUT_MS)
    keyed = _pages(house).select(
        F.col("common.mid").alias("mid"),
        "seq",
        "ts",
        "value",
        dwm.is_entry().alias("entry"),
        (~patterns.is_blank(F.col("page.page_id"))).alias("shown"),
        F.timestamp_millis("ts").alias("event_time"),
    )
    jumps = stateful.run_keyed(
        keyed.withWatermark("event_time", delay),
        "mid",
        stateful.Bounce(timeout),
        stateful.Bounce.SCHEMA,
        time_mode="EventTime",
    )
    return house.run(jumps, "user_jump_job", _pass_on(house, schemas.DWM_USER_JUMP))


def order_wide_job(
    house: Warehouse, read_dims: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], as_of: Column
) -> StreamingQuery:
    """Orders joined with their lines as both arrive, then enriched from the dimensions as they are now."""
    orders = topic_source.values(house.read("dwd_order_info"), schemas.ORDER_INFO)
    details = topic_source.values(house.read("dwd_order_detail"), schemas.ORDER_DETAIL)

    def each(batch: DataFrame, batch_id: int) -> None:
        users, provinces, products = read_dims()
        wide = dwm.enrich_order(batch, users, provinces, products, as_of).drop("create_ts")
        house.write(wide, schemas.DWM_ORDER_WIDE, batch_id)

    return house.run(dwm.order_details(orders, details), "order_wide_job", each)


WIDE = f"""
    detail_id bigint, order_id bigint, sku_id bigint, sku_num bigint, order_price {schemas.MONEY},
    split_total_amount {schemas.MONEY}, split_activity_amount {schemas.MONEY}, split_coupon_amount {schemas.MONEY},
    province_id bigint, user_id bigint, order_status string, total_amount {schemas.MONEY},
    activity_reduce_amount {schemas.MONEY}, coupon_reduce_amount {schemas.MONEY}, original_total_amount {schemas.MONEY},
    feight_fee {schemas.MONEY}, create_time string, province_name string, province_area_code string,
    province_iso_code string, province_3166_2_code string, user_age int, user_gender string, sku_name string, spu_id bigint,
    spu_name string, tm_id bigint, tm_name string, category3_id string, category3_name string
"""


def payment_wide_job(house: Warehouse) -> StreamingQuery:
    """Payments joined with the wide lines of their orders."""
    payments = topic_source.values(house.read("dwd_payment_info"), schemas.PAYMENT_INFO)
    wide = topic_source.values(house.read(schemas.DWM_ORDER_WIDE), WIDE)
    wide = wide.withColumn("create_ts", F.to_timestamp("create_time", schemas.TIME_FORMAT))

    def each(batch: DataFrame, batch_id: int) -> None:
        house.write(batch, schemas.DWM_PAYMENT_WIDE, batch_id)

    return house.run(dwm.payment_wide(payments, wide), "payment_wide_job", each)


# -- service layer --------------------------------------------------------------------------------------------


def _store(house: Warehouse, name: str) -> Batch:
    table = marts.mart(house.spark, house.root, name)
    return lambda batch, batch_id: marts.store(table, batch, batch_id)


def visitor_mart_job(house: Warehouse, window: str = schemas.MART_WINDOW, delay: str = "24 seconds") -> StreamingQuery:
    """The visitor mart from pages, unique visits and bounces.

    A bounce arrives after its timeout with the time of its page, so the watermark waits for the timeout, the delay
    and a window. Changed windows are stored again with a newer version.
    """

    def read(topic: str) -> DataFrame:
        return dwd.parse_log(house.read(topic).select("seq", "value"))

    facts = dws.visitor_facts(
        read(schemas.DWD_PAGE), read(schemas.DWM_UNIQUE_VISIT), read(schemas.DWM_USER_JUMP)
    ).withWatermark(dws.TIME, delay)
    return house.run(
        dws.visitor_stats(facts, window), "visitor_mart_job", _store(house, "visitor_stats"), mode="update"
    )


def province_mart_job(house: Warehouse, window: str = schemas.MART_WINDOW) -> StreamingQuery:
    """The province mart from wide orders."""
    stats = dws.province_stats(topic_source.values(house.read(schemas.DWM_ORDER_WIDE), WIDE), window)
    return house.run(stats, "province_mart_job", _store(house, "province_stats"), mode="update")


def keyword_mart_job(house: Warehouse, window: str = schemas.MART_WINDOW) -> StreamingQuery:
    """The keyword mart from search pages."""
    stats = dws.keyword_stats(dws.search_events(_pages(house)), window)
    return house.run(stats, "keyword_mart_job", _store(house, "keyword_stats"), mode="update")


def product_mart_job(
    house: Warehouse,
    facts: DataFrame,
    read_products: Callable[[], DataFrame],
    window: str = schemas.MART_WINDOW,
    delay: str = "10 seconds",
) -> StreamingQuery:
    """The product mart from the union of its feeds; product names are looked up after the aggregation."""
    measures = dws.product_measures(facts.withWatermark(dws.TIME, delay), window)
    table = marts.mart(house.spark, house.root, "product_stats")

    def each(batch: DataFrame, batch_id: int) -> None:
        marts.store(table, dws.named_products(batch, read_products()), batch_id)

    return house.run(measures, "product_mart_job", each, mode="update")


# -- control and late rows ------------------------------------------------------------------------------------


def switch_job(
    house: Warehouse, data: DataFrame, read_control: Callable[[], DataFrame], topic: str, name: str = "mode"
) -> StreamingQuery:
    """Every row with the newest control value; the control table (ts, value) is read anew in every batch.

    What a row meets depends on when its batch ran; ``control_job`` goes by the times of the rows.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        newest = read_control().agg(F.max_by("value", "ts")).first()[0]
        house.write(batch.withColumn(name, F.lit(newest).cast("string")), topic, batch_id)

    return house.run(data, "switch_job", each)


def control_job(
    house: Warehouse, data: DataFrame, control: DataFrame, ts: str, value: str, seq: str, topic: str, name: str = "mode",
    delay: str = "0 seconds",
) -> StreamingQuery:
    """Every row with the control value of its own time, from two streams in one query.

    Control rows reach every bucket of the data; a row waits until the watermark of the slower stream has passed it. So the
    result does not depend on the batches that either stream comes in. Both have ``ts`` and ``seq``.
    """
    number = int(house.spark.conf.get("spark.sql.shuffle.partitions"))
    record = F.to_json(F.struct(*data.columns))

    def tagged(df: DataFrame, is_data: bool, content: Column) -> DataFrame:
        marked = df.withColumn("_value", content.cast("string")).withColumn("_at", F.col(ts).cast("timestamp"))
        return marked.withWatermark("_at", delay).select(
            in_time.plain_time("_at").alias("ts"), F.col(seq).cast("long").alias("seq"), F.lit(is_data).alias("is_data"),
            F.col("_value").alias("value"),
        )

    both = in_time.buckets(tagged(data, True, record), ["seq"], number).unionByName(
        in_time.to_all_buckets(tagged(control, False, F.col(value)), number)
    )
    found = stateful.run_keyed(both, "key", in_time.AsOf(), in_time.AsOf.SCHEMA, "EventTime")

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.from_json("row", data.schema).alias("row"), F.col("value").alias(name))
        house.write(rows.select("row.*", name), topic, batch_id)

    return house.run(found, "control_job", each)


def late_job(
    house: Warehouse, data: DataFrame, ts: str, width: str, delay: timedelta, lateness: timedelta, main: str, side: str
) -> StreamingQuery:
    """Rows too late for their window to a topic of their own, all others to the main topic.

    A processor tags every row by the watermark of this query: the newest time of all earlier batches less the delay. It is
    kept in the query's own checkpoint, so a repeated batch sees the same one, and nothing is written but the topics.
    """
    number = int(house.spark.conf.get("spark.sql.shuffle.partitions"))
    milliseconds = delay // timedelta(milliseconds=1)
    marked = data.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", f"{milliseconds} milliseconds")
    # Behind the mark the time is a column of its own: the state operator would drop the late rows of a marked one.
    plain = marked.withColumn("last", in_time.window_last("_at", width)).drop("_at")
    dealt = plain.withColumn("_key", F.pmod(F.xxhash64(*data.columns), F.lit(number)))
    schema = T.StructType([*data.schema.fields, T.StructField("status", T.StringType())])
    judged = stateful.run_keyed(dealt, "_key", in_time.Judge(data.columns, lateness), schema, "EventTime")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        house.write(batch.filter(F.col("status") != late.TOO_LATE), main, batch_id)
        house.write(batch.filter(F.col("status") == late.TOO_LATE), side, batch_id)
        batch.unpersist()

    return house.run(judged, "late_job", each)
