"""Detail layer: behaviour logs split by kind, change feeds routed to facts and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import exchange, ordered, patterns
from millrace.schemas import APP_LOG, BOOTSTRAP_INSERT, CHANGE, INSERT, SINK_DIMENSION, SINK_FACT

# Routing tables up to this many rows are broadcast.
MOST_ROUTES = 10_000

# -- behaviour log --------------------------------------------------------------------------------------------


def parse_log(raw: DataFrame, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """JSON lines in ``value`` as nested columns; ``keep`` names columns to carry along."""
    return raw.select(*keep, parsed_once(F.from_json("value", APP_LOG)))


def parsed_once(record: Column) -> Column:
    """The fields of a parsed record as columns.

    Behind a generator the text is parsed once per row; filters on plain fields would each parse it again.
    """
    return F.inline(F.array(record))


# Devices of a log larger than this are counted on a sample of its rows.
SAMPLE_BYTES = 10 * 1024**3
SAMPLE_SHARE = 0.01


def device_cuts(raw: DataFrame, hot_rows: int | None = None) -> ordered.Cuts | None:
    """Cuts for the hot devices of a raw log, found without parsing it.

    Only two fields are read from the text. The sample of a large log only steers where devices are cut; all rows are
    processed, and results do not depend on the cuts.
    """
    share = SAMPLE_SHARE if ordered.estimated_bytes(raw) > SAMPLE_BYTES else 1.0
    rows = raw.sample(share, seed=7) if share < 1 else raw
    light = rows.select(
        F.get_json_object("value", "$.common.mid").alias("_mid"),
        F.get_json_object("value", "$.ts").try_cast("long").alias("ts"),
    )
    most = hot_rows or ordered.session_hot_rows(raw.sparkSession)
    return ordered.find_cuts(light, ["_mid"], ["ts"], max(1, int(most * share)))


def repair_new_visitors(log: DataFrame, cuts: ordered.Cuts | None | str = ordered.SEARCH) -> DataFrame:
    """A visitor is new once: later rows of a device that still say so are corrected.

    ``cuts`` may come from ``device_cuts``.
    """
    flat = log.withColumn("_mid", F.col("common.mid"))
    fixed = patterns.repair_new_flag(flat, "_mid", ["ts", "seq"], F.col("common.is_new"), "_is_new", cuts=cuts)
    return fixed.withColumn("common", F.col("common").withField("is_new", F.col("_is_new"))).drop("_mid", "_is_new")


def has_start() -> Column:
    return F.col("start").isNotNull() & (F.size("start") > 0)


def start_log(log: DataFrame) -> DataFrame:
    return log.filter(has_start()).drop("page", "displays")


def is_page() -> Column:
    """A line that shows a page; all plans and jobs go by this. Start lines are none, whatever else they hold."""
    return F.col("page").isNotNull() & ~has_start()


def page_log(log: DataFrame) -> DataFrame:
    return log.filter(is_page()).drop("start")


def rejected_log(log: DataFrame) -> DataFrame:
    """Lines that neither start a visit nor show a page, unreadable ones included: ``seq``, and whether there is any field."""
    return log.filter(~is_page() & ~has_start()).select("seq", F.coalesce("common.mid", F.col("ts").cast("string")).isNotNull().alias("readable"))


def display_log(log: DataFrame) -> DataFrame:
    """One row per display of a page: its own fields and the page it was on."""
    pages = log.filter(is_page())
    return pages.select(
        *[c for c in ("seq",) if c in log.columns],
        F.explode("displays").alias("display"),
        F.col("page.page_id").alias("page_id"),
    ).select("*", "display.*").drop("display")


# -- change feed ----------------------------------------------------------------------------------------------


def parse_changes(raw: DataFrame, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """JSON envelopes in ``value``; changes without a table or without data are dropped."""
    parsed = raw.select(*keep, parsed_once(F.from_json("value", CHANGE)))
    usable = F.col("table").isNotNull() & F.col("data").isNotNull() & (F.length("data") > 3)
    return parsed.filter(usable).withColumn("data", F.from_json("data", "map<string,string>"))


def keep_columns(data: Column, columns: Column) -> Column:
    """The entries of a record named in a comma list; an empty list keeps all."""
    wanted = F.transform(F.split(columns, ","), lambda name: F.trim(name))
    pruned = F.map_filter(data, lambda name, _: F.array_contains(wanted, name))
    return F.when(patterns.is_blank(columns), data).otherwise(pruned)


def route(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Match changes with the routing table on table and operation; changes without a route are dropped.

    A history load counts as inserts. The routing table is read anew for every batch.
    """
    operation = F.when(F.col("type") == BOOTSTRAP_INSERT, INSERT).otherwise(F.col("type"))
    normal = changes.withColumn("type", operation)
    rules = config.withColumnRenamed("source_table", "table").withColumnRenamed("operate_type", "type")
    routed = normal.join(exchange.to_all(rules, MOST_ROUTES), ["table", "type"])
    return routed.withColumn("data", keep_columns(F.col("data"), F.col("sink_columns")))


def facts(routed: DataFrame) -> DataFrame:
    """Rows for topics: the topic and the record."""
    return routed.filter(F.col("sink_type") == SINK_FACT).select(
        *[c for c in ("seq",) if c in routed.columns], F.col("sink_table").alias("topic"), "data"
    )


def dimensions(routed: DataFrame) -> DataFrame:
    """Rows for dimension tables: table, key and record. The key column defaults to id."""
    pk = F.when(patterns.is_blank(F.col("sink_pk")), "id").otherwise(F.col("sink_pk"))
    return routed.filter(F.col("sink_type") == SINK_DIMENSION).select(
        *[c for c in ("seq",) if c in routed.columns],
        F.upper("sink_table").alias("dim"),
        F.col("data")[pk].alias("pk"),
        "data",
    )


def latest_dimension_rows(dims: DataFrame) -> DataFrame:
    """The newest record of every dimension key; combined before the shuffle."""
    return dims.groupBy("dim", "pk").agg(F.max_by("data", "seq").alias("data"))


