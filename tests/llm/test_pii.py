from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from llm_frames import documents, rows_of
from millrace.llm import pii, queries

# The texts of the contract.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, part):
    digits = re.sub("[^0-9]", "", part)
    if kind == "ip":
        return all(int(n) <= 255 for n in part.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [
        (kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(kind, m.group())
    ]


def base_spans(df):
    found = pii.find(df)
    base = F.transform(F.filter("spans", lambda s: s["base"]), lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return sorted(((r[0], [tuple(s) for s in r[1]]) for r in found.select("doc_id", base).collect()), key=str)


def odd_texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("ab1234.@ -_+()é🙂%:") for _ in range(rng.randrange(70))) for _ in range(1500)]
    made += ["".join(rng.choice(["a", "@", ".", "b.c", "_", "d@e.f", " "]) for _ in range(12)) for _ in range(800)]
    made += ["".join(rng.choice(["1", "25", "256", "0007", ".", " ", "-", "+", "4111 1111 1111 1111", "("]) for _ in range(14)) for _ in range(800)]
    return made + [
        "mail me: x.y@z.example.com, or 10.0.0.1 and 4111-1111-1111-1111 or +49 (30) 1234-5678",
        "é🙂 a@b.c.@d.e _x@y.z", "1.2.3.4.5.6.7.8 999.1.1.1 000255.0.0.0", "+1 2345678 +1 23456789012345678",
    ]


def test_base_spans_equal_the_contract(spark):
    rows = list(enumerate(odd_texts()))
    assert base_spans(documents(spark, rows, extra=True).repartition(4)) == sorted(((i, brute(t)) for i, t in rows), key=str)


def test_long_runs_and_many_matches(spark):
    rows = [
        (1, "a" * 2000), (2, "1" * 2000), (3, "1 " * 1000), (4, "1." * 700), (5, "+1" + "(" * 2000), (6, "x@y.zz " * 700),
        (7, "a@" * 900), (8, "+1 234 567 8901, 10.1.2.3; " * 300),
    ]
    assert base_spans(documents(spark, rows)) == sorted(((i, brute(t)) for i, t in rows), key=str)


def test_very_long_runs_take_time_of_their_length(spark):
    """The patterns as the contract writes them would need the square of it, so nothing is compared here."""
    rows = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "1 " * 100_000), (5, "+1" + "(" * 100_000), (7, "a@" * 50_000)]
    assert base_spans(documents(spark, rows)) == [(i, []) for i, _ in rows]


def test_nulls_repeated_rows_and_empty_table(spark):
    rows = [(None, "a@b.cd"), (1, None), (1, ""), (2, "a@b.cd"), (2, "a@b.cd"), (2, "no")]
    assert base_spans(documents(spark, rows)) == sorted(((i, brute(t)) for i, t in rows), key=str)
    assert rows_of(pii.find(documents(spark, []))) == []


def test_added_spans_do_not_touch_base_ones_and_clean_texts_stay(spark):
    rows = [(i, f"Some text, password = k{i:04d}a9b8c7d6e5f4 and call +49 30 1234567{i % 10}0 now") for i in range(60)]
    rows += [(100 + i, f"Plain words without anything, number {i} of year 2020 in 3 parts") for i in range(60)]
    found = {r.doc_id: r.spans for r in pii.find(documents(spark, rows)).collect()}
    assert all("phone" in {s.kind for s in found[i] if s.base} for i in range(60))
    assert all("secret" in {s.kind for s in found[i]} for i in range(60))
    assert all(not found[100 + i] for i in range(60))


def test_reliabilities_tell_the_two_classes_apart(spark):
    votes = [("card", [2, 2, 1, 2, 2])] * 80 + [("card", [0, 1, 1, 0, 0])] * 150 + [("card", [1, 2, 1, 2, 2])] * 10
    found = pii.reliabilities(spark.createDataFrame(votes, "kind string, votes array<int>")).collect()
    chance = {tuple(r.votes): r.chance for r in found}
    assert chance[2, 2, 1, 2, 2] > 0.95 and chance[0, 1, 1, 0, 0] < 0.05 and chance[1, 2, 1, 2, 2] > 0.5


def test_mask(spark):
    df = documents(spark, [(1, "🙂 a@b.cd and 10.0.0.1!"), (2, "none"), (3, None)])
    found = pii.find(df).select("doc_id", "spans").withColumnRenamed("doc_id", "found")
    joined = df.join(found, F.col("doc_id") == F.col("found"))
    got = {r[0]: r[1] for r in joined.select("doc_id", pii.mask(F.col("text"), F.col("spans"))).collect()}
    assert got == {1: "🙂 <EMAIL> and <IP>!", 2: "none", 3: None}


def test_query_equals_brute_force(spark, tables):
    import hashlib

    text = {r[0]: r[1] for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()}
    for row in queries.QUERIES["op6_pii"](spark, tables).collect():
        spans = brute(text[row.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(row.spans.split(","))
        assert [row[f"n_{kind}"] for kind in pii.BASE_KINDS] == [sum(k == kind for k, _, _ in spans) for kind in pii.BASE_KINDS]


def test_added_spans_on_the_tables_are_the_secrets_after_their_cue(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    secrets = {(i, m.start(1), m.end(1)) for i, text in texts.items() for m in re.finditer(r'(?i:token) = "([0-9A-Za-z]{20,})"', text)}
    added = set()
    for row in pii.find(spark.read.parquet(f"{folder}/documents.parquet")).collect():
        added |= {(row.doc_id, s.start, s.end) for s in row.spans if not s.base}
    assert len(secrets) > 5
    assert secrets <= added and len(added - secrets) <= len(secrets) // 10


def test_plan_is_native(spark, tables):
    plan = queries.QUERIES["op6_pii"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
