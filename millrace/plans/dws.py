"""Service layer: visitor, product, province and keyword marts.

Every mart is a windowed aggregate of one union of facts. The window and the version number are parameters; a version
left out is the time of the run in milliseconds. The functions take batch frames, and streaming frames where noted.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import keywords, times
from millrace.operators import joins, ordered, patterns, windows
from millrace.operators.rows import union_all
from millrace.plans import dwd
from millrace.plans.dwm import is_entry
from millrace.schemas import (
    APPRAISE_GOOD,
    BOUNCE_TIMEOUT_MS,
    KEYWORD_SOURCE,
    MART_WINDOW,
    MONEY,
    PRODUCT_AMOUNTS,
    PRODUCT_COUNTS,
    PRODUCT_ORDERS,
    PROVINCE_KEYS,
    VISITOR_KEYS,
    VISITOR_MEASURES,
)

TIME = "event_time"


def _versioned(df: DataFrame, version: Column | None) -> DataFrame:
    return df.withColumn("ts", times.now_millis() if version is None else version)


def _record(df: DataFrame, defaults: dict[str, Column], **values: Column) -> DataFrame:
    """Bring a feed to the common record: given values over defaults."""
    return df.select(*[c.alias(name) for name, c in (defaults | values).items()])


# -- visitors -------------------------------------------------------------------------------------------------


def _visitor_defaults() -> dict[str, Column]:
    dims = {k: F.col(f"common.{k}") for k in VISITOR_KEYS}
    return {TIME: times.millis_to_time(F.col("ts"))} | dims | {m: F.lit(0).cast("long") for m in VISITOR_MEASURES}


def visitor_facts(pages: DataFrame, unique_visits: DataFrame, jumps: DataFrame) -> DataFrame:
    """One record per page (a page view, and a session when it is an entry), unique visit and bounce."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    page = _record(
        pages,
        _visitor_defaults(),
        pv_ct=one,
        sv_ct=F.when(is_entry(), one).otherwise(none),
        dur_sum=F.coalesce(F.col("page.during_time"), none),
    )
    visits = _record(unique_visits, _visitor_defaults(), uv_ct=one)
    bounced = _record(jumps, _visitor_defaults(), uj_ct=one)
    return union_all([page, visits, bounced])


def visitor_facts_from_log(
    log: DataFrame,
    timeout_ms: int = BOUNCE_TIMEOUT_MS,
    cuts: ordered.Cuts | None | str = ordered.SEARCH,
) -> DataFrame:
    """The same facts straight from the parsed log, for batch runs: one sort per device serves all of them.

    Repairing the new flag, finding the first entry of a day and the next page all look along the rows of a device,
    so they share one shuffle; the layered form writes each of them to a topic of its own. ``cuts`` may come from
    ``dwd.device_cuts``, which spares parsing the log to find its hot devices.
    """
    entry, page = is_entry(), dwd.is_page()
    time = times.millis_to_time(F.col("ts"))
    shown = page & ~patterns.is_blank(F.col("page.page_id"))
    rows = log.select(
        F.col("common.mid").alias("_mid"),
        "ts",
        "seq",
        time.alias(TIME),
        *[F.col(f"common.{k}").alias(k) for k in VISITOR_KEYS],
        page.alias("_page"),
        (page & entry).alias("_entry"),
        F.when(page & entry, F.to_date(time)).alias("_entry_day"),
        F.when(shown, F.col("ts")).alias("_shown_at"),
        F.coalesce(F.col("page.during_time"), F.lit(0)).alias("during_time"),
    )
    seen = ordered.scan(
        rows,
        ["_mid"],
        ["ts", "seq"],
        {
            "_news": ordered.total(F.when(F.col("is_new") == "1", 1).otherwise(0)),
            "_last_day": ordered.largest(F.col("_entry_day"), before=True),
            "_next_at": ordered.following_known("_shown_at"),
        },
        cuts=cuts,
    ).filter("_page")
    entry = F.col("_entry")
    unseen = F.col("_last_day").isNull() | (F.col("_last_day") < F.col("_entry_day"))
    bounced = F.col("_next_at").isNull() | (F.col("_next_at") >= F.col("ts") + timeout_ms)
    keys = {k: F.col(k) for k in VISITOR_KEYS}
    keys["is_new"] = F.when((F.col("is_new") == "1") & (F.col("_news") > 1), "0").otherwise(F.col("is_new"))
    return _record(
        seen,
        {TIME: F.col(TIME)} | keys,
        uv_ct=(entry & unseen).cast("long"),
        pv_ct=F.lit(1).cast("long"),
        sv_ct=entry.cast("long"),
        uj_ct=(entry & bounced).cast("long"),
        dur_sum=F.col("during_time"),
    )


def visitor_stats(facts: DataFrame, window: str = MART_WINDOW, version: Column | None = None) -> DataFrame:
    """Unique visitors, views, sessions, bounces and duration per window and visitor group (also streaming)."""
    sums = {m: F.sum(m) for m in VISITOR_MEASURES}
    return _versioned(windows.with_bounds(windows.time_window(facts, TIME, window, VISITOR_KEYS, sums)), version)


# -- products -------------------------------------------------------------------------------------------------


def _product_defaults(time: Column) -> dict[str, Column]:
    return (
        {"sku_id": F.lit(None).cast("long"), TIME: time}
        | {m: F.lit(0).cast("long") for m in PRODUCT_COUNTS}
        | {m: F.lit(0).cast(MONEY) for m in PRODUCT_AMOUNTS}
        | {"order_kind": F.lit(None).cast("string"), "order_id": F.lit(None).cast("long")}
    )


def product_facts(
    pages: DataFrame,
    favors: DataFrame,
    carts: DataFrame,
    orders: DataFrame,
    payments: DataFrame,
    refunds: DataFrame,
    comments: DataFrame,
) -> DataFrame:
    """Seven feeds as one record: clicks and displays, favourites, carts, orders, payments, refunds, comments."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    logged = _product_defaults(times.millis_to_time(F.col("ts")))
    created = _product_defaults(times.text_to_time(F.col("create_time")))
    paid = _product_defaults(times.text_to_time(F.col("payment_create_time")))
    sku = F.col("sku_id").cast("long")
    # Clicks and displays of a page leave one pass over the log.
    of_sku = F.filter("displays", lambda display: display["item_type"] == "sku_id")
    marks = F.transform(of_sku, lambda display: F.struct(display["item"].alias("item"), none.alias("click"), one.alias("display")))
    click = F.array(F.struct(F.col("page.item").alias("item"), one.alias("click"), none.alias("display")))
    opened = F.when(F.col("page.page_id") == "good_detail", click)
    empty = F.array().cast("array<struct<item:string,click:bigint,display:bigint>>")
    seen = pages.select("ts", F.explode(F.concat(F.coalesce(opened, empty), F.coalesce(marks, empty))).alias("mark"))
    good = F.when(F.col("appraise") == APPRAISE_GOOD, 1).otherwise(0).cast("long")
    return union_all(
        [
            _record(
                seen,
                logged,
                sku_id=F.col("mark.item").try_cast("long"),
                click_ct=F.col("mark.click"),
                display_ct=F.col("mark.display"),
            ),
            _record(favors, created, sku_id=sku, favor_ct=one),
            _record(carts, created, sku_id=sku, cart_ct=one),
            _record(
                orders,
                # Wide orders still have the time that their text was made from.
                created | ({TIME: F.col("create_ts")} if "create_ts" in orders.columns else {}),
                sku_id=sku,
                order_sku_num=F.col("sku_num").cast("long"),
                order_amount=F.col("split_total_amount").cast(MONEY),
                order_kind=F.lit("order"),
                order_id=F.col("order_id").cast("long"),
            ),
            _record(
                payments,
                paid,
                sku_id=sku,
                payment_amount=F.col("split_total_amount").cast(MONEY),
                order_kind=F.lit("payment"),
                order_id=F.col("order_id").cast("long"),
            ),
            _record(
                refunds,
                created,
                sku_id=sku,
                refund_amount=F.col("refund_amount").cast(MONEY),
                order_kind=F.lit("refund"),
                order_id=F.col("order_id").cast("long"),
            ),
            _record(comments, created, sku_id=sku, comment_ct=one, good_comment_ct=good),
        ]
    )


def _product_sums() -> dict[str, Column]:
    return {m: F.sum(m) for m in PRODUCT_COUNTS} | {m: F.sum(m).cast(MONEY) for m in PRODUCT_AMOUNTS}


def product_measures(facts: DataFrame, window: str = MART_WINDOW) -> DataFrame:
    """Thirteen measures per window and product.

    Of batch frames, the feeds with orders are first grouped by order as well, each by itself: that spreads a hot product over
    its orders, feeds without orders skip that step, and the second step counts orders without holding any set. Streaming frames allow one aggregation, so they hold the orders of an
    open window as a set.
    """
    if facts.isStreaming:
        orders = {
            name: F.size(F.collect_set(F.when(F.col("order_kind") == kind, F.col("order_id")))).cast("long")
            for name, kind in PRODUCT_ORDERS.items()
        }
        return windows.time_window(facts, TIME, window, ["sku_id"], _product_sums() | orders)
    # Amounts are added up as whole cents: a sum of decimals is kept as a number of any length, which costs several times as much.
    cents = {m: (F.col(m) * 100).cast("long") for m in PRODUCT_AMOUNTS}
    facts = facts.withColumns(cents)
    measures = [*PRODUCT_COUNTS, *PRODUCT_AMOUNTS]
    sums = {m: F.sum(m) for m in measures}
    known = F.coalesce(F.col("order_kind").isin(*PRODUCT_ORDERS.values()), F.lit(False))
    none = F.lit(0).cast("long")
    plain = facts.filter(~known).withColumn("_window", F.window(TIME, window))
    bounds = [F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end")]
    parts = [plain.select("sku_id", *bounds, *measures, *[none.alias(name) for name in PRODUCT_ORDERS])]
    for kind in PRODUCT_ORDERS.values():
        by_order = windows.time_window(facts.filter(F.col("order_kind") == kind), TIME, window, ["sku_id", "order_id"], sums)
        counted = F.col("order_id").isNotNull().cast("long")
        numbers = [(counted if kind == other else none).alias(name) for name, other in PRODUCT_ORDERS.items()]
        parts.append(by_order.select("sku_id", "window_start", "window_end", *measures, *numbers))
    grouped = union_all(parts).groupBy("sku_id", "window_start", "window_end")
    grouped = grouped.agg(*[F.sum(m).alias(m) for m in [*measures, *PRODUCT_ORDERS]])
    return grouped.withColumns({m: (F.col(m).cast("decimal(19,0)") * F.lit(Decimal("0.01"))).cast(MONEY) for m in PRODUCT_AMOUNTS})


def named_products(measures: DataFrame, products: DataFrame, version: Column | None = None) -> DataFrame:
    """Aggregated measures with window bounds as text, product attributes and a version."""
    columns = {c: c for c in ("sku_name", "spu_id", "spu_name", "tm_id", "tm_name", "category3_id", "category3_name")}
    bounded = windows.with_bounds(measures)
    return _versioned(joins.lookup(bounded, products, {"sku_id": "id"}, {"price": "sku_price"} | columns), version)


def product_stats(
    facts: DataFrame, products: DataFrame, window: str = MART_WINDOW, version: Column | None = None
) -> DataFrame:
    """The product mart: aggregated first, enriched afterwards."""
    return named_products(product_measures(facts, window), products, version)


# -- provinces and keywords (SQL) -----------------------------------------------------------------------------


def order_wide_rows(wide: DataFrame) -> DataFrame:
    """Wide orders with their row time, ready for SQL."""
    rows = wide.withColumn("rowtime", times.text_to_time(F.col("create_time")))
    if wide.isStreaming:
        rows = rows.withWatermark("rowtime", "0 seconds")
    return rows


def province_stats(wide: DataFrame, window: str = MART_WINDOW, version: Column | None = None) -> DataFrame:
    """Order amount and number of order lines per window and province (also streaming)."""
    dims = ", ".join(PROVINCE_KEYS)
    stats = wide.sparkSession.sql(
        f"""
        SELECT date_format(window.start, 'yyyy-MM-dd HH:mm:ss') AS stt,
               date_format(window.end, 'yyyy-MM-dd HH:mm:ss') AS edt,
               {dims}, order_amount, order_count
        FROM (SELECT window(rowtime, '{window}') AS window, {dims},
                     cast(sum(split_total_amount) AS {MONEY}) AS order_amount, count(*) AS order_count
              FROM {{order_wide}}
              GROUP BY window(rowtime, '{window}'), {dims})
        """,
        order_wide=order_wide_rows(wide),
    )
    return _versioned(stats, version)


def _as_map(rows: DataFrame, record: str) -> Column:
    """A record as a map of texts, without the fields that are null."""
    names = rows.schema[record].dataType.names
    pairs = [part for name in names for part in (F.lit(name), F.col(record)[name].cast("string"))]
    return F.when(F.col(record).isNotNull(), F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull()))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as maps with their row time, ready for SQL."""
    rows = pages.select(
        _as_map(pages, "common").alias("common"),
        _as_map(pages, "page").alias("page"),
        "ts",
        times.text_to_time(times.millis_to_text(F.col("ts"))).alias("rowtime"),
    )
    if pages.isStreaming:
        rows = rows.withWatermark("rowtime", "2 seconds")
    return rows


def search_events(pages: DataFrame) -> DataFrame:
    """The words people searched for, with their time."""
    return pages.sparkSession.sql(
        "SELECT page['item'] AS fullWord, rowtime FROM {page_view} "
        "WHERE page['item_type'] = 'keyword' AND page['item'] IS NOT NULL",
        page_view=page_rows(pages),
    )


def keyword_stats(
    searches: DataFrame,
    window: str = MART_WINDOW,
    version: Column | None = None,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Searches per window and keyword (also streaming, without a dictionary)."""
    split = keywords.keywords(searches, "fullWord", "keyword", dictionary)
    counted = windows.time_window(split, "rowtime", window, ["keyword"], {"ct": F.count(F.lit(1))})
    return _versioned(windows.with_bounds(counted).withColumn("source", F.lit(KEYWORD_SOURCE)), version)
