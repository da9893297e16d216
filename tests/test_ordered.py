"""Running values: the plain plan and the cut plan give the same rows."""

from __future__ import annotations

import heapq
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frames import EVENT, collected, skewed
from millrace.operators import ordered, patterns, rolling, topk, windows
from millrace.plans import dwd

HOUR = timedelta(hours=1)
ORDER = ["ts", "seq"]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(skewed(), EVENT).cache()


def test_cuts_only_where_a_key_is_hot(events):
    assert ordered.find_cuts(events, ["key"], ORDER) is None
    cuts = ordered.find_cuts(events, ["key"], ORDER, hot_rows=100)
    assert len(cuts.hot) == 1 and cuts.chunks >= 4
    spread = cuts.assign(events).filter("key = 'hot'").groupBy("_chunk").count().collect()
    assert len(spread) >= 4 and max(r["count"] for r in spread) <= 100


def values():
    level = F.col("level")
    return {
        "total": ordered.total(level),
        "total_before": ordered.total(level, before=True),
        "n": ordered.row_count(),
        "low": ordered.smallest(level),
        "high": ordered.largest(level),
        "high_before": ordered.largest(level, before=True),
        "first": ordered.first_value(level),
        "known": ordered.last_known(level),
        "prev": ordered.previous(level),
        "next": ordered.following(level),
        "next_known": ordered.following_known("level"),
    }


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    out = []
    for members in groups.values():
        members.sort(key=lambda r: (r[1], r[2]))
        levels = [m[3] for m in members]
        for i, m in enumerate(members):
            upto, before = [v for v in levels[: i + 1] if v is not None], [v for v in levels[:i] if v is not None]
            later = [v for v in levels[i + 1 :] if v is not None]
            out.append(
                (
                    *m,
                    sum(upto) if upto else None,
                    sum(before) if before else None,
                    i + 1,
                    min(upto, default=None),
                    max(upto, default=None),
                    max(before, default=None),
                    levels[0],
                    upto[-1] if upto else None,
                    levels[i - 1] if i else None,
                    levels[i + 1] if i + 1 < len(levels) else None,
                    later[0] if later else None,
                )
            )
    return out


def by_seq(rows):
    return sorted(rows, key=lambda r: r[2])


@pytest.mark.parametrize("hot_rows", [ordered.HOT_ROWS, 40, 3])
def test_scan_matches_brute_force(events, hot_rows):
    out = ordered.scan(events, ["key"], ORDER, values(), hot_rows=hot_rows)
    assert by_seq(map(tuple, out.collect())) == by_seq(brute(skewed()))


def test_scan_over_all_rows_is_always_cut(events):
    out = ordered.scan(events, [], ORDER, values(), hot_rows=50)
    expected = brute([(0, *r[1:]) for r in skewed()])
    got = [(0, *tuple(r)[1:]) for r in out.collect()]
    assert by_seq(got) == by_seq(expected)


def test_carries_are_shuffled_when_there_are_too_many(events, monkeypatch):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
    out = ordered.scan(events, ["key"], ORDER, values(), hot_rows=40)
    assert by_seq(map(tuple, out.collect())) == by_seq(brute(skewed()))


@pytest.mark.parametrize("hot_rows", [ordered.HOT_ROWS, 30])
def test_rolling_top3(events, hot_rows):
    out = topk.rolling_top3(events, ["key"], ORDER, "level", "best", hot_rows=hot_rows)
    expected, held = [], {}
    for r in sorted(skewed(), key=lambda r: (r[1], r[2])):
        held.setdefault(r[0], []).extend([] if r[3] is None else [r[3]])
        expected.append((*r, heapq.nlargest(3, held[r[0]])))
    assert by_seq(map(tuple, out.collect())) == by_seq(expected)


@pytest.mark.parametrize("highest", [True, False])
@pytest.mark.parametrize("last", [True, False])
@pytest.mark.parametrize("hot_rows", [ordered.HOT_ROWS, 30])
def test_rolling_extreme(events, highest, last, hot_rows):
    out = rolling.rolling_extreme(
        events, ["key"], ORDER, "level", ["seq"], highest=highest, last_on_ties=last, hot_rows=hot_rows
    )
    best, expected = {}, []
    for r in sorted(skewed(), key=lambda r: (r[1], r[2])):
        held = best.get(r[0])
        if r[3] is not None:
            better = held is None or (r[3] > held[3] if highest else r[3] < held[3]) or (r[3] == held[3] and last)
            if better:
                best[r[0]] = r
        held = best.get(r[0])
        expected.append((*r, held and held[2]))
    assert by_seq(map(tuple, out.collect())) == by_seq(expected)


def test_rolling_distinct(events):
    out = rolling.rolling_distinct(events, "key", ORDER, "seen", hot_rows=50)
    seen, expected = set(), []
    for r in sorted(skewed(), key=lambda r: (r[1], r[2])):
        seen |= {r[0]} - {None}
        expected.append((*r, len(seen)))
    got = [tuple(r) for r in out.select("key", "ts", "seq", "level", F.coalesce("seen", F.lit(0))).collect()]
    assert by_seq(got) == by_seq(expected)


PLAIN_AND_CUT = [
    lambda e, h: windows.session_window(e, "ts", "10 minutes", ["key"], {"n": F.count("*")}, ORDER, h),
    lambda e, h: windows.session_window(
        e,
        "ts",
        F.when(F.col("seq") % 2 == 0, "15 minutes").otherwise("5 minutes"),
        ["key"],
        {"n": F.count("*"), "top": F.max("level")},
        ORDER,
        h,
    ),
    lambda e, h: windows.count_tumbling(e, ["key"], ORDER, 3, {"n": F.count("*"), "s": F.sum("seq")}, h),
    lambda e, h: windows.count_sliding(e, ["key"], ORDER, 3, 2, {"n": F.count(F.lit(1)), "s": F.sum("seq")}, h),
    lambda e, h: windows.count_sliding(e, ["key"], ORDER, 2, 5, {"n": F.count(F.lit(1)), "s": F.sum("seq")}, h),
    lambda e, h: patterns.level_jumps(e, ["key"], ORDER, "level", 10, hot_rows=h),
    lambda e, h: patterns.rising_alerts(e, ["key"], "ts", ORDER, "level", timedelta(minutes=30), h),
    lambda e, h: patterns.bounces(
        e, ["key"], "ts", ORDER, F.col("seq") % 3 == 0, F.col("seq") % 2 == 0, timedelta(minutes=20), hot_rows=h
    ),
    lambda e, h: patterns.repair_new_flag(e, "key", ORDER, F.when(F.col("seq") % 2 == 0, "1").otherwise("0"), "f", h),
]


@pytest.mark.parametrize("case", range(len(PLAIN_AND_CUT)))
def test_cut_plan_equals_plain_plan(events, case):
    run = PLAIN_AND_CUT[case]
    plain, cut = run(events, ordered.HOT_ROWS), run(events, 30)
    assert "_chunk" in cut._jdf.queryExecution().toString()
    assert plain.columns == cut.columns
    assert collected(plain) == collected(cut) and plain.count() > 0


def test_cuts_of_a_sample_fit_all_rows(events, monkeypatch):
    """An extent measured on some rows leaves others outside of it, in chunks below and above."""
    some = events.filter("seq between 100 and 200")
    cuts = ordered.find_cuts(some, ["key"], ORDER, hot_rows=20)
    assert cuts is not None
    out = ordered.scan(events, ["key"], ORDER, values(), cuts=cuts)
    assert by_seq(map(tuple, out.collect())) == by_seq(brute(skewed()))


def test_device_cuts_from_a_sample(spark, monkeypatch):
    line = '{"common":{"mid":"%s"},"ts":%d}'
    rows = [(i, line % ("hot" if i % 2 else i, i)) for i in range(20_000)] + [(-1, "no json")]
    raw = spark.createDataFrame(rows, "seq long, value string")
    monkeypatch.setattr(dwd, "SAMPLE_BYTES", 0)
    cuts = dwd.device_cuts(raw, hot_rows=1000)
    assert len(cuts.hot) == 1 and 20 <= cuts.chunks <= 60


def test_rows_without_a_time_come_first(spark):
    rows = [("k", None, 0, 7), ("k", None, 1, 8), *[("k", i, i, i) for i in range(2, 60)]]
    df = spark.createDataFrame(rows, "key string, place long, seq long, level int")
    out = ordered.scan(df, ["key"], ["place", "seq"], {"n": ordered.row_count()}, hot_rows=4)
    assert [r.n for r in out.orderBy("seq").collect()] == list(range(1, 61))


@pytest.mark.parametrize("keys", [["key"], []])
def test_crowded_times_are_cut_again(spark, keys):
    """A third of the rows within a second of a year, another third at one instant."""
    year = 365 * 24 * 3600 * 1_000_000
    places = [i * year // 300 for i in range(300)] + [year // 2 + i for i in range(300)] + [year // 3] * 300
    rows = [("k", place, seq, seq % 7) for seq, place in enumerate(places)]
    df = spark.createDataFrame(rows, "key string, place long, seq long, level int").repartition(4)
    cuts = ordered.find_cuts(df, keys, ["place", "seq"], hot_rows=50)
    sizes = [r["count"] for r in cuts.assign(df).groupBy("_chunk").count().collect()]
    assert max(sizes) <= 50 and sum(sizes) == 900 and {c.at for level in cuts.levels for c in level} == {None, year // 3}
    out = ordered.scan(df, keys, ["place", "seq"], values(), cuts=cuts)
    assert by_seq(map(tuple, out.collect())) == by_seq(brute(rows))


def test_a_hot_key_without_times_is_cut_along_the_second_column(spark):
    rows = [("hot", None, i, 1) for i in range(300)] + [("hot", datetime(2024, 1, 1), i, 1) for i in range(20)] + [("k", None, 0, 1)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq long, level int").repartition(3)
    cuts = ordered.find_cuts(df, ["key"], ["ts", "seq"], 25)
    sizes = cuts.assign(df).filter("key = 'hot'").groupBy(ordered.CHUNK).count()
    assert sizes.agg({"count": "max"}).first()[0] <= 25
    found = ordered.scan(df, ["key"], ["ts", "seq"], {"n": ordered.row_count()}, cuts=cuts)
    place = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[2]))
    want, counts = {}, {}
    for key, ts, seq, _ in place:
        counts[key] = counts.get(key, 0) + 1
        want[key, ts, seq] = counts[key]
    assert {(r.key, r.ts, r.seq): r.n for r in found.collect()} == want


def test_a_densely_packed_file_is_counted(spark, tmp_path):
    """A constant column packs into next to nothing: rows count, not bytes."""
    path = str(tmp_path / "dense")
    spark.range(60_000).selectExpr("'k' AS key", "id AS seq").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    hot = ordered.estimated_bytes(df) // ordered.ROW_BYTES + 1
    assert hot < 60_000 and ordered.find_cuts(df, ["key"], ["seq"], hot) is not None
    assert ordered.find_cuts(df, ["key"], ["seq"], 60_000) is None
