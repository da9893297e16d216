"""Every registered query against its SQL; ordered ones also with every key cut into small chunks."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from millrace import queries as registry
from millrace.operators import ordered
from oracle import connect, difference

QUERIES, SQL = registry.QUERIES, registry.SQL

ORDERED = [
    "running_sum", "running_min_max", "running_avg", "reduce_keep_first", "running_maxby_last", "running_maxby_first",
    "running_minby_first", "running_top3", "running_pv", "running_uv", "running_row_count", "session_static",
    "session_dynamic", "global_window_triggered", "count_tumbling_3", "count_sliding_3_2", "level_jump_alert",
    "level_rise_alert", "rising_alert", "bounce_detail", "bounce_detail_open", "new_user_fix", "watermark_trace",
    "late_classify", "broadcast_switch", "visitor_stats", "visitor_stats_layered",
    "dimension_versions", "lookup_as_of", "match_in_order", "global_window_count_or_time",
]


@pytest.fixture(scope="module")
def con(tables):
    return connect(tables)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, con, name):
    assert difference(QUERIES[name](spark, tables), con, SQL[name]) is None


@pytest.mark.parametrize("name", ORDERED)
def test_cut_query_equals_sql(spark, tables, con, name):
    spark.conf.set(ordered.HOT_ROWS_SETTING, "5")
    try:
        df = QUERIES[name](spark, tables)
        assert "_chunk" in df._jdf.queryExecution().toString()
        assert difference(df, con, SQL[name]) is None
    finally:
        spark.conf.unset(ordered.HOT_ROWS_SETTING)


def test_no_query_compares_all_pairs(spark, tables):
    for name, query in QUERIES.items():
        if name.startswith("stream_"):
            continue
        plan = query(spark, tables)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["stt", "edt"]
