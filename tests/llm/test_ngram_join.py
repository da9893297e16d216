from __future__ import annotations

import random
from collections import defaultdict

import pytest

from llm_frames import documents, rows_of
from millrace.llm import graph, ngram_join, queries
from oracle import connect, difference


def ngrams(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) if len(words) >= 4 else frozenset([tuple(words)])


def brute(rows):
    sets = [ngrams(text) for _, text in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    smallest = defaultdict(lambda: None)
    for place, (doc_id, _) in enumerate(rows):
        known = smallest[root(place)]
        smallest[root(place)] = doc_id if known is None else known if doc_id is None else min(known, doc_id)
    return sorted(((i, len(s), smallest[root(p)] if s else i) for p, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def samples():
    rng = random.Random(5)
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One Two"), (4, "one  two"), (5, "one two three four"), (None, "one two")]
    common = make(60)
    for group in range(12):  # chains: every step changes a little, so ends are unlike but connected
        words = make(rng.choice([8, 40, 90, 200]))
        for step in range(rng.randrange(1, 9)):
            rows.append((100 * (group + 1) - step, " ".join(words)))
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
    rows += [(5000 + i, " ".join(common + make(rng.randrange(3, 80)))) for i in range(60)]
    rows += [(6000 + i % 3, " ".join(common)) for i in range(9)]
    rows += [(None, " ".join(common)), (7000, "É é " * 50), (7001, "é é " * 50), (7002, "A " * 20000)]
    return rows


def test_equals_brute_force(spark):
    rows = samples()
    found = ngram_join.near_duplicates(documents(spark, rows, extra=True).repartition(4))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)
    assert got == brute(rows)


def test_one_document_of_each_component_is_kept(spark):
    found = ngram_join.near_duplicates(documents(spark, samples()).repartition(4)).filter("n_shingles > 0").collect()
    kept = defaultdict(int)
    for row in found:
        kept[row.component_id] += row.kept
    assert set(kept.values()) == {1}


def test_query_equals_brute_force(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(rows_of(queries.QUERIES["op3_ngram_join"](spark, tables)), key=str) == brute(rows)


def test_query_equals_sql(spark, tables):
    name = "op3_ngram_join"
    assert difference(queries.QUERIES[name](spark, tables), connect(tables), queries.SQL[name]) is None


def test_empty_table(spark):
    assert rows_of(ngram_join.near_duplicates(documents(spark, []))) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(None, 3), (7, 7)]
    rng.shuffle(links)
    label = {}
    for a, b in links:
        if a is not None and a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)
    for _ in range(100):
        for a, b in links:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.vertex: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label


def test_copies_that_differ_too_much_are_not_tried(spark, monkeypatch):
    chance = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for place in range(5 + 20 * (i % 2), 120, 30 if i % 3 else 60):
            words[place] = f"x{chance.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [rows[7], (60, rows[7][1]), (61, rows[8][1] + " more")]
    kept = {}
    keep = ngram_join.tables.keep

    def counted(df, name):
        out = keep(df, name)
        kept[name] = kept.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join.tables, "keep", counted)
    monkeypatch.setattr(ngram_join, "AT_ONCE", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
    assert kept["ngram-tried"] < 40


def test_copies_meet_at_what_they_were_copied_from(spark, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # any two of them are too unlike
        words = list(base)
        words[10 + i % 40] = f"x{i}"
        words[60 + i % 45] = f"y{i}"
        rows.append((i, " ".join(words)))
    rows.append((60, " ".join(base)))
    pairs = []
    keep = ngram_join.tables.keep

    def counted(df, name):
        out = keep(df, name)
        if name == "ngram-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(ngram_join.tables, "keep", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = ngram_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
    assert sum(pairs) < 2 * len(rows)
