from __future__ import annotations

import re
from itertools import permutations

import pyarrow as pa
import pytest

from llm_frames import CLASHING, DOCUMENTS, rows_of
from millrace.llm import filter_audit, queries
from oracle import connect, difference

LONG = " ".join(f"w{i}" for i in range(120))
FEW = "a b " * 60


def failures(rows):
    """Letters that each row fails, by the definition."""
    found = []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        letters = {"A"} if len(words) < 100 else set()
        letters |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        letters |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        letters |= {"D"} if re.search("[#$%&*|]", text) else set()
        letters |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows) else set()
        found.append(letters)
    return found


def brute(rows, labels):
    good = {i for i, quality, _ in labels if quality == 1}
    toxic = {i for i, _, bad in labels if bad == 1}
    failed = failures(rows)
    out = []
    for part in {lang or "" for *_, lang in rows}:
        members = [(i, f) for (i, _, lang), f in zip(rows, failed) if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            alive = members
            for step, letter in enumerate(order, 1):
                removed = [i for i, f in alive if letter in f]
                alive = [(i, f) for i, f in alive if letter not in f]
                fails = sum(letter in f for _, f in members)
                earlier = set(order[: step - 1])
                redundant = sum(letter in f and bool(f & earlier) for _, f in members)
                assert fails == redundant + len(removed)
                shapley[letter] += len(removed)
                steps.append((part, "".join(order), step, len(alive), len(removed), redundant, sum(f == {letter} for _, f in members),
                              sum(i in good for i in removed if i is not None), sum(i in toxic for i in removed if i is not None), letter))
        out += [(*step[:-1], shapley[step[-1]]) for step in steps]
    return sorted(out)


ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "fr"), (3, LONG, None), (4, FEW, ""), (5, FEW + "#", "en"), (6, None, "en"), (7, "", None),
    (8, "", "en"), (9, "SHOUT " * 200, "en"), (10, LONG + " 100% $", "fr"), (11, LONG + "é" * 9 + "ABCDEFGHIJ" * 9, "fr"),
    (12, " ".join(map(str, range(300))), "de"), (13, "\x0b".join(map(str, range(300))), "de"), (None, LONG, "en"), (None, LONG, "en"),
    (None, None, None), (2, "other text of an id", "en"), (2, LONG, "en"), (14, "x" * 100_000, "de"), (-3, FEW, "de"), (15, "|" + LONG, "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, 0, 1), (5, None, 1), (9, 1, None), (12, 1, 1), (None, 1, 1), (99, 1, 1), (15, 1, 0)]


def frames(spark, rows, labels=LABELS):
    schema = DOCUMENTS + CLASHING + ", digest string, part string, mask string, good string, first string"
    more = (7, "tag", "spans", "kept", "score", "ids", "row", "_id", "d", "p", "m", "g", "f")
    docs = spark.createDataFrame([(i, t, lang, "s", 0, *more) for i, t, lang in rows], schema)
    known = spark.createDataFrame([(*row, "x", "y") for row in labels], "doc_id long, quality int, toxic int, good string, id string")
    return docs, known


@pytest.mark.parametrize("partitions", [1, 5])
def test_equals_brute_force(spark, partitions):
    docs, labels = frames(spark, ROWS)
    assert sorted(rows_of(filter_audit.audit(docs.repartition(partitions), labels))) == brute(ROWS, LABELS)


def test_one_text_with_very_many_copies_and_many_parts(spark):
    rows = [(i, LONG if i % 3 else f"text {i}", f"part {i % 600}") for i in range(3000)]
    docs, labels = frames(spark, rows)
    found = filter_audit.audit(docs.repartition(7), labels).filter("filter_order = 'EABCD' AND step = 1")
    sums = rows_of(found.selectExpr("count(*)", "sum(kept)", "sum(removed)", "sum(redundant)"))
    assert sums == [(600, 1001, 1999, 0)]


def test_empty_tables(spark):
    docs, labels = frames(spark, [], [])
    assert rows_of(filter_audit.audit(docs, labels)) == []
    docs, labels = frames(spark, ROWS[:3], [])
    assert sorted(rows_of(filter_audit.audit(docs, labels))) == brute(ROWS[:3], [])


def test_fields_do_not_run_over():
    of_key = filter_audit._wide_integers()
    most = filter_audit.MOST_ROWS - 1
    fields = filter_audit.unpacked(filter_audit._content(most * of_key[4 * 0b11111 + 3]))
    assert set(fields.tolist()) == {0, most}
    several = filter_audit.unpacked(filter_audit._content(most // 2 * of_key[0] + 5 * of_key[4 * 2]))
    place = filter_audit.field(0, 0, "kept")
    assert several[place] == most // 2 + 5 and several[filter_audit.field(0, 1, "removed")] == 5
    assert len(filter_audit.ORDERS) * 5 == 600


def test_filters_at_their_limits():
    hundred = " ".join(f"w{i}" for i in range(100))
    eighty = " ".join([f"w{i}" for i in range(80)] + ["w0"] * 20)
    columns = pa.array([hundred, hundred.rsplit(" ", 1)[0], eighty, eighty.replace("w79", "w0"), "A" + "é" * 9, "A" + "é" * 8, "&", None])
    assert filter_audit.failed_alone(columns).tolist() == [0, 1, 0, 2, 1, 1 + 4, 1 + 8, 1]


def test_query_equals_sql(spark, tables):
    name = "op12_filter_audit"
    assert difference(queries.QUERIES[name](spark, tables), connect(tables), queries.SQL[name]) is None
