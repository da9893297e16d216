"""Record schemas and the fixed names and codes shared by readers, plans and sinks."""

from __future__ import annotations

# -- fixed values ---------------------------------------------------------------------------------------------
DATE_FORMAT = "yyyy-MM-dd"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
HOUR_FORMAT = "HH:mm:ss"
DAY_NUMBER_FORMAT = "yyyyMMdd"
MONEY = "decimal(18,2)"

APPRAISE_GOOD = "1203"
KEYWORD_SOURCE = "SEARCH"

INSERT, BOOTSTRAP_INSERT = "insert", "bootstrap-insert"
SINK_DIMENSION, SINK_FACT = "hbase", "kafka"

BOUNCE_TIMEOUT_MS = 10_000
ORDER_DETAIL_SECONDS = 5
PAYMENT_MINUTES = 15
MART_WINDOW = "2 seconds"

# -- topics (fixed values) ------------------------------------------------------------------------------------
ODS_LOG = "ods_base_log"
ODS_CHANGES = "ods_base_db"
DWD_START, DWD_PAGE, DWD_DISPLAY = "dwd_start_log", "dwd_page_log", "dwd_display_log"
DWM_UNIQUE_VISIT, DWM_USER_JUMP = "dwm_unique_visit", "dwm_user_jump_detail"
DWM_ORDER_WIDE, DWM_PAYMENT_WIDE = "dwm_order_wide", "dwm_payment_wide"

# -- records (fixed values: names and types of fields) --------------------------------------------------------
WATER_SENSOR = "id string, ts long, vc int"
USER_BEHAVIOR = "user_id long, item_id long, category_id int, behavior string, ts long"
MARKETING_BEHAVIOR = "user_id long, behavior string, channel string, ts long"
AD_CLICK = "user_id long, ad_id long, province string, city string, ts long"
ORDER_EVENT = "order_id long, event_type string, tx_id string, event_time long"
RECEIPT_EVENT = "tx_id string, pay_channel string, event_time long"

APP_LOG = """
    common struct<ar: string, ba: string, ch: string, is_new: string, md: string, mid: string, os: string,
                  uid: string, vc: string>,
    page struct<during_time: bigint, item: string, item_type: string, last_page_id: string, page_id: string>,
    start map<string, string>,
    displays array<struct<item: string, item_type: string>>,
    ts bigint
"""

# The data of a change is kept as text until its columns are known.
CHANGE = "`table` string, `type` string, data string"

ROUTE = """
    source_table string, operate_type string, sink_type string, sink_table string, sink_columns string,
    sink_pk string, sink_extend string
"""

ORDER_INFO = f"""
    id bigint, province_id bigint, user_id bigint, order_status string, total_amount {MONEY},
    activity_reduce_amount {MONEY}, coupon_reduce_amount {MONEY}, original_total_amount {MONEY}, feight_fee {MONEY},
    expire_time string, create_time string, operate_time string
"""
ORDER_DETAIL = f"""
    id bigint, order_id bigint, sku_id bigint, sku_num bigint, order_price {MONEY}, split_total_amount {MONEY},
    split_activity_amount {MONEY}, split_coupon_amount {MONEY}, sku_name string, create_time string
"""
PAYMENT_INFO = f"""
    id bigint, order_id bigint, user_id bigint, total_amount {MONEY}, subject string, payment_type string,
    create_time string, callback_time string
"""

# -- marts (fixed values) -------------------------------------------------------------------------------------
VISITOR_KEYS = ["vc", "ch", "ar", "is_new"]
VISITOR_MEASURES = ["uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"]
VISITOR_MART_KEY = ["stt", "edt", "is_new", "vc", "ch", "ar"]

PRODUCT_COUNTS = ["display_ct", "click_ct", "favor_ct", "cart_ct", "order_sku_num", "comment_ct", "good_comment_ct"]
PRODUCT_AMOUNTS = ["order_amount", "payment_amount", "refund_amount"]
PRODUCT_ORDERS = {"order_ct": "order", "paid_order_ct": "payment", "refund_order_ct": "refund"}
PRODUCT_MART_KEY = ["stt", "edt", "sku_id"]

PROVINCE_KEYS = ["province_id", "province_name", "province_area_code", "province_iso_code", "province_3166_2_code"]
PROVINCE_MART_KEY = ["stt", "edt", "province_id"]

KEYWORD_MART_KEY = ["stt", "edt", "keyword", "source"]
