from __future__ import annotations

import re

from pyspark.sql import functions as F

from llm_frames import documents, rows_of
from millrace.llm import decontaminate, queries
from oracle import connect, difference

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        found = words(text)
        n = min(10, len(found))
        for i in range(len(found) - n + 1 if found else 0):
            windows.setdefault(tuple(found[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in rows:
        found, hit, named = words(text), set(), set()
        for i in range(len(found)):
            for n in range(1, 11):
                if i + n <= len(found) and tuple(found[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    named |= windows[tuple(found[i : i + n])]
        out.append((doc_id, len(found), len(hit), sorted(str(n) for n in named if n is not None)))
    return sorted(out, key=str)


def check(spark, rows, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated_words(documents(spark, rows, extra=True).repartition(3), benchmark)
    got = found.select("doc_id", "n_words", decontaminate.covered(F.col("spans")), "items").collect()
    assert sorted(((a, b, c, list(d)) for a, b, c, d in got), key=str) == brute(rows, items)


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [
    (1, LONG), (2, "W3, w4 w5-w6 w7 w8 w9 w10 w11 w12"), (3, "short item"), (4, None), (5, "!!"), (6, LONG), (None, "null id here"),
    (7, "Été ÉTÉ été"), (8, "a a a a a a a a a a a a"), (10, "one"),
]


def test_equals_brute_force(spark):
    rows = [
        (0, None), (1, ""), (2, "...!"), (3, LONG), (3, LONG), (None, "x " + LONG.upper() + " y"), (5, " ".join(LONG.split()[:9])),
        (6, " ".join(LONG.split()[5:15])), (7, "the Short, item short"), (8, "été ÉTÉ été and Été ÉTÉ été"), (9, "a " * 30 + "b"),
        (10, "null id here"), (11, ("w1 " + LONG + " ") * 200), (12, "W3 w4 w5 w6 w7 w8 w9 w10 w11 w13"), (13, "One two"),
    ]
    check(spark, rows, ITEMS)


def test_only_long_items(spark):
    check(spark, [(1, LONG), (2, "a b c")], [(1, LONG)])


def test_empty_tables(spark):
    check(spark, [(1, LONG), (2, None)], [])
    check(spark, [], ITEMS)


def test_large_benchmark_is_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST_ROWS", 0)
    check(spark, [(1, LONG), (2, "x y short item")], ITEMS)


def test_query_equals_sql(spark, tables):
    name = "op4_decontaminate"
    df = queries.QUERIES[name](spark, tables)
    assert difference(df, connect(tables), queries.SQL[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval", "MapInArrow"))
