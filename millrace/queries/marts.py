"""Marts and the queries over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import keywords
from millrace.operators import windows
from millrace.plans import dwd, dwm, dws, serving, star_views
from millrace.plans.star_views import table
from millrace.queries import query
from millrace.queries.joined import ORDER_SQL, order_details, products
from millrace.queries.ordered_rows import BOUNCE_HOURS_MS, PAGES
from millrace.queries.per_row import repaired_log
from millrace.schemas import VISITOR_KEYS
from millrace.session import checkpoint_root
from millrace.sinks import upsert

# Version of the mart rows in these queries.
VERSION = 1_700_000_000_000


def version():
    return F.lit(VERSION).cast("long")


# -- visitors -------------------------------------------------------------------------------------------------

VISITORS = f"""
    {PAGES},
    facts AS (
        SELECT *, last_page_id IS NULL AS entry,
               last_page_id IS NULL AND row_number() OVER (PARTITION BY mid, last_page_id IS NULL, date_trunc('day', ts)
                                                           ORDER BY ms, seq) = 1 AS visit,
               last_page_id IS NULL AND (next_ms IS NULL OR next_ms >= ms + {BOUNCE_HOURS_MS}) AS bounce
        FROM followed),
    mart AS (
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS stt,
               strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS edt,
               vc, ch, ar, is_new, count(*) FILTER (WHERE visit) AS uv_ct, count(*) AS pv_ct,
               count(*) FILTER (WHERE entry) AS sv_ct, count(*) FILTER (WHERE bounce) AS uj_ct,
               CAST(sum(during_time) AS BIGINT) AS dur_sum, {VERSION}::BIGINT AS ts
        FROM facts GROUP BY date_trunc('day', facts.ts), vc, ch, ar, is_new)
"""


@query(f"WITH {VISITORS} SELECT * FROM mart")
def visitor_stats(spark: SparkSession, sf: str) -> DataFrame:
    raw = star_views.app_log(spark, sf)
    facts = dws.visitor_facts_from_log(dwd.parse_log(raw), BOUNCE_HOURS_MS, dwd.device_cuts(raw))
    return dws.visitor_stats(facts, "1 day", version())


@query(f"WITH {VISITORS} SELECT * FROM mart")
def visitor_stats_layered(spark: SparkSession, sf: str) -> DataFrame:
    pages = dwd.page_log(repaired_log(spark, sf))
    facts = dws.visitor_facts(pages, dwm.unique_visits(pages), dwm.user_jumps(pages, BOUNCE_HOURS_MS))
    return dws.visitor_stats(facts, "1 day", version())


@query(
    f"""
    WITH {VISITORS}
    SELECT vc, ch, ar, is_new, CAST(sum(uj_ct) AS BIGINT) AS uj_ct, CAST(sum(sv_ct) AS BIGINT) AS sv_ct,
           CASE WHEN sum(sv_ct) > 0 THEN CAST(sum(uj_ct) AS DOUBLE) / CAST(sum(sv_ct) AS DOUBLE) END AS bounce_rate
    FROM mart GROUP BY ALL
    """
)
def bounce_rate(spark: SparkSession, sf: str) -> DataFrame:
    return serving.bounce_rate(visitor_stats(spark, sf), VISITOR_KEYS)


# -- products -------------------------------------------------------------------------------------------------

PRODUCTS = f"""
    {ORDER_SQL},
    paid AS (SELECT id AS payment_id, created + to_minutes(id % 20 - 1) AS paid_at FROM info),
    facts AS (
        SELECT event_id % 200 AS sku_id, ts AS event_ts, 'click' AS kind, 0 AS num, 0::DECIMAL(18,2) AS money, NULL::BIGINT AS oid
        FROM events WHERE event_type = 'purchase'
        UNION ALL SELECT event_id % 200, ts, 'display', 0, 0, NULL FROM events WHERE event_type = 'error'
        UNION ALL SELECT event_id % 200, ts, 'favor', 0, 0, NULL FROM events WHERE event_type = 'view'
        UNION ALL SELECT event_id % 200, ts, 'cart', 0, 0, NULL FROM events WHERE event_type = 'click'
        UNION ALL SELECT sku_id, created, 'order', sku_num, amount, order_id FROM wide
        UNION ALL SELECT sku_id, paid_at, 'payment', 0, amount, order_id
                  FROM paid JOIN wide ON payment_id = order_id AND created BETWEEN paid_at - INTERVAL 15 MINUTE AND paid_at
        UNION ALL SELECT l_partkey, TIMESTAMP '2024-01-01' + to_minutes(l_orderkey) + INTERVAL 1 HOUR, 'refund', 0,
                         CAST(l_extendedprice AS DECIMAL(18,2)), l_orderkey FROM lineitem WHERE l_returnflag = 'R'
        UNION ALL SELECT l_partkey, TIMESTAMP '2024-01-01' + to_minutes(l_orderkey) + INTERVAL 2 HOUR,
                         CASE WHEN l_quantity >= 25 THEN 'good' ELSE 'comment' END, 0, 0, NULL
                  FROM lineitem WHERE l_returnflag = 'N'),
    measures AS (
        SELECT sku_id, date_trunc('day', event_ts) AS day,
               count(*) FILTER (WHERE kind = 'display') AS display_ct, count(*) FILTER (WHERE kind = 'click') AS click_ct,
               count(*) FILTER (WHERE kind = 'favor') AS favor_ct, count(*) FILTER (WHERE kind = 'cart') AS cart_ct,
               CAST(sum(num) AS BIGINT) AS order_sku_num,
               CAST(coalesce(sum(money) FILTER (WHERE kind = 'order'), 0) AS DECIMAL(18,2)) AS order_amount,
               count(DISTINCT oid) FILTER (WHERE kind = 'order') AS order_ct,
               CAST(coalesce(sum(money) FILTER (WHERE kind = 'payment'), 0) AS DECIMAL(18,2)) AS payment_amount,
               count(DISTINCT oid) FILTER (WHERE kind = 'payment') AS paid_order_ct,
               CAST(coalesce(sum(money) FILTER (WHERE kind = 'refund'), 0) AS DECIMAL(18,2)) AS refund_amount,
               count(DISTINCT oid) FILTER (WHERE kind = 'refund') AS refund_order_ct,
               count(*) FILTER (WHERE kind IN ('comment', 'good')) AS comment_ct,
               count(*) FILTER (WHERE kind = 'good') AS good_comment_ct
        FROM facts GROUP BY ALL)
"""


def product_facts(spark: SparkSession, sf: str) -> DataFrame:
    wide = order_details(spark, sf)
    return dws.product_facts(
        dwd.page_log(dwd.parse_log(star_views.app_log(spark, sf))),
        star_views.product_marks(spark, sf, "view"),
        star_views.product_marks(spark, sf, "click"),
        wide,
        dwm.payment_wide(star_views.payment_info(spark, sf), wide),
        star_views.refund_info(spark, sf),
        star_views.comment_info(spark, sf),
    )


def product_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """The mart without product names, which a sum of amounts has no use for."""
    return windows.with_bounds(dws.product_measures(product_facts(spark, sf), "1 day"))


@query(
    f"""
    WITH {PRODUCTS}
    SELECT measures.* EXCLUDE (day), strftime(day, '%Y-%m-%d %H:%M:%S') AS stt,
           strftime(day + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS edt, CAST(p_retailprice AS DECIMAL(18,2)) AS sku_price,
           p_name AS sku_name, CAST(p_size AS BIGINT) AS spu_id, 'spu ' || p_size AS spu_name,
           CAST(split_part(p_brand, '#', 2) AS BIGINT) AS tm_id, p_brand AS tm_name, p_type AS category3_id,
           lower(p_type) AS category3_name, {VERSION}::BIGINT AS ts
    FROM measures LEFT JOIN part ON sku_id = p_partkey
    """
)
def product_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dws.product_stats(product_facts(spark, sf), products(spark, sf), "1 day", version())


@query(
    f"""
    WITH {PRODUCTS}
    SELECT CAST(strftime(day, '%Y%m%d') AS INTEGER) AS day, CAST(sum(order_amount) AS DECIMAL(18,2)) AS order_amount
    FROM measures GROUP BY day
    """
)
def gmv_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return serving.gmv_by_day(product_amounts(spark, sf))


@query(
    f"""
    WITH {PRODUCTS}
    SELECT 0 AS status, CAST(sum(order_amount) AS DECIMAL(18,2)) AS data FROM measures WHERE day = DATE '2024-01-03'
    """
)
def gmv_of_day(spark: SparkSession, sf: str) -> DataFrame:
    return serving.gmv(product_amounts(spark, sf), 20240103)


# -- provinces and keywords -----------------------------------------------------------------------------------


@query(
    f"""
    WITH {ORDER_SQL}
    SELECT strftime(date_trunc('day', created), '%Y-%m-%d %H:%M:%S') AS stt,
           strftime(date_trunc('day', created) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS edt,
           province_id, n_name AS province_name, '0' || n_nationkey AS province_area_code,
           'N-' || n_nationkey AS province_iso_code, r_name || '-' || n_nationkey AS province_3166_2_code,
           CAST(sum(amount) AS DECIMAL(18,2)) AS order_amount, count(*) AS order_count, {VERSION}::BIGINT AS ts
    FROM wide LEFT JOIN nation ON province_id = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    GROUP BY ALL
    """
)
def province_stats(spark: SparkSession, sf: str) -> DataFrame:
    wide = dwm.with_province(order_details(spark, sf), star_views.provinces(spark, sf))
    return dws.province_stats(wide, "1 day", version())


@query(
    f"""
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS stt,
           strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS edt,
           keyword, 'SEARCH' AS source, count(*) AS ct, {VERSION}::BIGINT AS version
    FROM (SELECT ts, unnest(regexp_extract_all(lower(props), '[\\p{{L}}\\p{{N}}]+')) AS keyword
          FROM events WHERE event_type = 'click')
    GROUP BY date_trunc('hour', ts), keyword
    """
)
def search_keyword_stats(spark: SparkSession, sf: str) -> DataFrame:
    pages = dwd.page_log(dwd.parse_log(star_views.app_log(spark, sf)))
    mart = dws.keyword_stats(dws.search_events(pages), "1 hour", version())
    return mart.withColumnRenamed("ts", "version")


@query(
    """
    SELECT keyword, source, count(*) AS ct
    FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS keyword FROM documents)
    GROUP BY keyword, source
    """
)
def keyword_stats(spark: SparkSession, sf: str) -> DataFrame:
    documents = star_views.spread(spark, sf, "documents", "source", "text")
    words = keywords.keywords(documents, "text")
    return words.groupBy("keyword", "source").agg(F.count("*").alias("ct"))


# -- stored marts ---------------------------------------------------------------------------------------------


@query(
    """
    SELECT o_custkey, o_orderkey AS version, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1
    """
)
def mart_latest(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("version"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount")
    )
    return serving.latest(orders, ["o_custkey"], "version")


@query(
    """
    SELECT user_id, event_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """
)
def keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return upsert.latest_per_key(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    """
    SELECT CAST(user_id AS VARCHAR) AS _id,
           '{"user_id":' || user_id || ',"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS document
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """
)
def document_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.as_documents(keyed_upsert(spark, sf), "user_id")


STORED_BATCHES = 10


@query(
    """
    SELECT user_id, event_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """
)
def stored_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The newest event of every user from a stored table that came in batches and was folded meanwhile."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    path = f"{checkpoint_root(spark)}/keyed/{uuid.uuid4()}"
    stored = upsert.KeyedTable(
        spark, path, "user_id long, event_id long, event_type string, ts timestamp_ntz", ("user_id",), ("ts", "event_id"), fan=3
    )
    stored.create()
    for batch in range(STORED_BATCHES):
        stored.apply(rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(STORED_BATCHES)) == batch), batch)
    return stored.read().drop("ts")


# -- keywords by a dictionary ---------------------------------------------------------------------------------

# Names in Han characters: a character for each letter and for the blank, so that a name is one token.
LETTERS, HAN = "abcdefghijklmnopqrstuvwxyz ", "一丁七万丈三上下不与丑专且世丘丙业丛东丝丢两严丧个中丰"


def han_names(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Product names as Han tokens, and a dictionary of their words and of the beginnings of these, which overlap."""
    names = table(spark, sf, "part").select("p_partkey", F.translate(F.lower("p_name"), LETTERS, HAN).alias("name"))
    words = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    cuts = words.select(F.explode(F.array("word", F.substring("word", 1, 2), F.concat(F.substring("word", 2, 2), F.lit(" ")))).alias("word"))
    return names, cuts.select(F.translate("word", LETTERS, HAN).alias("word")).distinct()


HAN_WORDS = f"""
    WITH RECURSIVE names AS (SELECT p_partkey, translate(lower(p_name), '{LETTERS}', '{HAN}') AS name FROM part),
    plain AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part),
    dictionary AS (
        SELECT DISTINCT translate(unnest([w, substr(w, 1, 2), substr(w, 2, 2) || ' ']), '{LETTERS}', '{HAN}') AS word FROM plain),
    longest AS (
        SELECT name, place, max(length(word)) AS size
        FROM (SELECT DISTINCT name, unnest(range(1, length(name) + 1)) AS place FROM names) JOIN dictionary
          ON starts_with(substr(name, place), word) GROUP BY name, place),
    steps(name, place, size) AS (
        SELECT name, 1, 0 FROM (SELECT DISTINCT name FROM names)
        UNION ALL
        SELECT s.name, s.place + s.size, coalesce(l.size, 1)
        FROM steps s LEFT JOIN longest l ON s.name = l.name AND s.place + s.size = l.place WHERE s.place + s.size <= length(s.name)),
    words AS (SELECT name, substr(name, place, size) AS word FROM steps WHERE size > 0)
    SELECT p_partkey, word FROM names JOIN words USING (name)
"""


@query(HAN_WORDS)
def dictionary_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords with a dictionary of any size: substrings of each distinct token joined with it."""
    names, dictionary = han_names(spark, sf)
    return keywords.keywords(names, "name", "word", dictionary).select("p_partkey", "word")


@query(HAN_WORDS)
def lateral_dictionary_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """The same in SQL: a table function whose dictionary every task holds."""
    names, dictionary = han_names(spark, sf)
    names.createOrReplaceTempView("han_names")
    keywords.register(spark, dictionary)
    return spark.sql("SELECT p_partkey, word FROM han_names, LATERAL ik_analyze(name)")
