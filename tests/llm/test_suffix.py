from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from llm_frames import documents, rows_of
from millrace.llm import queries, suffix


def brute(rows, length=suffix.LENGTH):
    """(doc_id, n_bytes, spans, kept) by comparing every window; rows equal in id and text are one."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        plain = (text or "").encode()
        gone = bytearray(len(plain))
        for p in range(len(plain) - length + 1):
            window = plain[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        spans = []
        for p, flag in enumerate(gone):
            if flag and p and gone[p - 1]:
                spans[-1][1] += 1
            elif flag:
                spans.append([p, p + 1])
        out[doc_id, text] = (len(plain), [tuple(s) for s in spans], bytes(c for c, flag in zip(plain, gone) if not flag))
    return out


def found(df, rows):
    got = sorted(
        ((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix.remove_repeats(df).collect()), key=str
    )
    want = brute(rows)
    return got, sorted(((i, *want[i, t]) for i, t in rows), key=str)


def samples():
    rng = random.Random(3)
    words = ["the", "of", "und", "là", "é", "x", "漢字", "<b>"]
    make = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", str(rng.randrange(99))]) for _ in range(n))
    shared, passage = make(120), make(60)
    rows = [(None, shared), (0, None), (1, ""), (2, "a" * 99), (3, "a" * 1000), (4, "ab" * 700 + "c" + "ab" * 300), (5, shared)]
    rows += [(5, shared), (6, shared[:300] + "!" + shared[301:]), (7, "z" * 100), (8, "z" * 100), (9, make(4000))]
    rows += [(10 + i, make(rng.randrange(1, 90)) + passage + make(rng.randrange(1, 90))) for i in range(40)]
    rows += [(100 + i, passage[i:] + passage) for i in range(15)]
    return rows


@pytest.mark.parametrize("crowds", [False, True])
def test_equals_brute_force(spark, monkeypatch, crowds):
    if crowds:
        monkeypatch.setattr(suffix, "CROWD", 3)
        monkeypatch.setattr(suffix, "CROWD_IN_TASK", 2)
    rows = samples()
    got, want = found(documents(spark, rows, extra=True).repartition(5), rows)
    assert got == want


def test_small_pieces_and_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE_BYTES", 2000)
    monkeypatch.setattr(suffix, "TASK_RUNS", 40)
    rows = samples()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got, want = found(documents(spark, rows).repartition(3), rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


@pytest.mark.parametrize("crowds", [False, True])
@pytest.mark.parametrize("task_runs", [suffix.TASK_RUNS, 40])
def test_copies_of_a_row_in_other_tasks_are_one_text(spark, monkeypatch, crowds, task_runs):
    monkeypatch.setattr(suffix, "TASK_RUNS", task_runs)
    monkeypatch.setattr(suffix, "PIECE_BYTES", 2000)
    if crowds:
        monkeypatch.setattr(suffix, "CROWD", 3)
        monkeypatch.setattr(suffix, "CROWD_IN_TASK", 2)
    rng = random.Random(5)
    alone = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    passage = "".join(rng.choice("ijklmnop ") for _ in range(70))
    near = [(20 + i, f"{i:05d}" * 30 + passage + f"{i:05d}" * 30) for i in range(12)]
    rows = [(7, alone)] * 5 + near * 4 + [(50, "x" + alone[:400]), (60, passage)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got, want = found(spark.createDataFrame(spark.sparkContext.parallelize(rows, 9), "doc_id long, text string"), rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert [g for g in got if g[0] == 7] == [(7, 3000, [], alone.encode())] * 5


def test_many_texts_of_one_id_are_told_apart(spark):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    early = make(300)
    rows = [(-5, early)]
    # 15 bits of hash tell 1 500 texts of one id apart with a chance of e-15.
    for doc_id in (None, 7):
        for i in range(1500):
            rows.append((doc_id, make(150) + (early[:150] if doc_id and i % 2 else "") + make(150)))
    df = documents(spark, rows).repartition(6)
    got = sorted(((r.doc_id, bytes(r.kept)) for r in suffix.remove_repeats(df).collect()), key=str)
    ordered = [(r.doc_id, r.text) for r in df.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text")).collect()]
    want = brute([(place, text) for place, (_, text) in enumerate(ordered)])
    assert got == sorted(((i, want[place, text][2]) for place, (i, text) in enumerate(ordered)), key=str)


def test_empty_table(spark):
    assert rows_of(suffix.remove_repeats(documents(spark, []))) == []


def test_query_equals_brute_force(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    got = {r.doc_id: r for r in queries.QUERIES["op2_suffix_repeats"](spark, tables).collect()}
    for doc_id, text in rows:
        n_bytes, spans, _ = want[doc_id, text]
        assert (got[doc_id].n_bytes, got[doc_id].n_spans, got[doc_id].n_removed) == (n_bytes, len(spans), sum(b - a for a, b in spans))
        data, left, end = (text or "").encode(), b"", 0
        for a, b in sorted(spans):
            left, end = left + data[end:a], b
        assert got[doc_id].kept_sha256 == hashlib.sha256(left + data[end:]).hexdigest()
