from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest

from llm_frames import documents, rows_of
from millrace.llm import queries, toxicity


def slow_kernel(left, right):
    """Common subsequences of three characters by definition, units between two marks."""
    from itertools import combinations

    def counted(word):
        symbols = [0, *(toxicity._SYMBOL[c] for c in word), 0]
        found = {}
        for places in combinations(range(len(symbols)), 3):
            span = places[2] - places[0] + 1
            if span <= toxicity.MOST_SPAN:
                code = tuple(symbols[p] for p in places)
                found[code] = found.get(code, 0) + toxicity.DECAY ** (span - 3)
        return found

    a, b = counted(left), counted(right)
    norm = np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b.get(k, 0) for k, v in a.items()) / norm


def test_kernel_equals_its_definition():
    words = ["idiot", "i.d.i.o.t", "idixot", "aaaaaa", "grüße", "x", "lo", "banana", "123abc!"]
    got = toxicity.kernel(words, words)
    want = [[slow_kernel(a, b) for b in words] for a in words]
    assert np.allclose(got, want, atol=1e-6)


def test_units():
    assert toxicity.units("You i d i o t !") == {"you", "i", "d", "o", "t", "!", "idiot!"}
    assert toxicity.units("b.a.d b_ad ***") == {"b.a.d", "b_ad", "bad", "***"}
    assert toxicity.units("") == set() and toxicity.units(" \n") == set()
    long = "".join(chr(97 + i % 26) for i in range(100))
    parts = toxicity.units(long)
    assert all(len(p) <= toxicity.UNIT_CHARS for p in parts) and {c for p in parts for c in p} == set(long)


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(1)
    syllables = ["ta", "mo", "ri", "ne", "ko", "su", "le", "va"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    rows = []
    for i in range(500):
        words = [word() for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for insult in rng.sample(["blockhead", "dimwit", "scumbag", "nitwit"], 2):
                words[rng.randrange(40)] = insult
        rows.append((i, " ".join(words), int(toxic)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    return model, word


def predicted(spark, model, many):
    scored = toxicity.score(documents(spark, list(enumerate(many)), extra=True), model)
    return [r.predicted for r in scored.orderBy("doc_id").collect()]


def test_insults_with_gaps_and_inserted_characters(spark, learned):
    model, word = learned
    clean = [" ".join(word() for _ in range(60)) for _ in range(50)]
    toxic = [f"{word()} {insult} {word()} {other}" for insult, other in [
        ("blockhead", "dimwit"), ("b.l.o.c.k.h.e.a.d", "dimwit!"), ("block-head", "dim*wit"), ("Scumbag", "NITWIT"),
        ("b l o c k h e a d", "nitwit,"),
    ]]
    assert sum(predicted(spark, model, clean)) <= 1
    assert predicted(spark, model, toxic) == [1] * 5


def test_insults_of_ordinary_words_are_learned_from_labelled_spans(spark):
    rng = random.Random(4)
    syllables = ["ta", "mo", "ri", "ne", "ko", "su", "le", "va"]
    harmless = ["empty", "waste", "space", "brick"]

    def text(toxic):
        lines = [["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(10)] for _ in range(4)]
        if toxic:  # all in one sentence
            for place, word in zip(rng.sample(range(10), 4), harmless):
                lines[1][place] = word
        else:  # one of them alone: as many in clean texts as in toxic ones
            lines[2][rng.randrange(10)] = rng.choice(harmless)
        return " ".join(" ".join(line) + "." for line in lines)

    rows = [(text(i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    model = toxicity.train(spark.createDataFrame(rows, "text string, toxic int"))
    assert sum(predicted(spark, model, [text(True) for _ in range(50)])) >= 45
    assert sum(predicted(spark, model, [text(False) for _ in range(50)])) <= 2


def test_spans_are_made_of_units():
    for many in ["You i d i o t ! Go. away", "b.a.d b_ad *** x" * 40, "", "ab" * 300, "one two\nthree? four"]:
        assert {word for words in toxicity.spans(many) for word in words} <= toxicity.units(many)
    assert toxicity.spans("One, two. Three") == [["one", "two"], ["three"]]


def test_nulls_empty_and_long_texts(spark, learned):
    model, word = learned
    many = [None, "", "   ", "x", " ".join(word() for _ in range(30_000)), "ta" * 50_000]
    scores = toxicity.score(documents(spark, list(enumerate(many))), model).orderBy("doc_id").collect()
    assert all(0 <= r.score <= 1 for r in scores) and [r.predicted for r in scores[:4]] == [0] * 4


def test_without_labels_nothing_is_toxic(spark):
    labelled = "text string, toxic int"
    for rows in ([], [("a b", 0)], [("a b", 1)], [(None, 1), ("a", None)]):
        assert toxicity.train(spark.createDataFrame(rows, labelled)) is None
    assert predicted(spark, None, ["x", None]) == [0, 0]
    assert rows_of(toxicity.score(documents(spark, []), None)) == []


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op7_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 50 and sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows) >= 0.95
    assert sum(r.predicted for r in rows if not labels[r.doc_id]) <= 1


def test_scorer_takes_little_memory_and_finds_the_worst_of_units_and_spans():
    rng = np.random.default_rng(1)
    model = toxicity.ToxicityModel(rng.random(toxicity.SYMBOLS**3) - 0.5, rng.random(toxicity.SYMBOLS**3) - 0.5, [])
    odd = ["", "a b c d", "x.y! " + "z" * 60 + " " + "-" * 40 + " ok. a a a a", "... !!! ?", "w " * 100 + "end. w", "İx ß. " + "q-" * 30]
    many = [" ".join(f"{rng.integers(1 << 40):x}." for _ in range(6000)) for _ in range(20)]
    scorer = toxicity.TextScorer(model)
    tracemalloc.start()
    found = [scorer.worst(part) for part in (odd, *([text] * 3 for text in many), odd)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scorer.units) <= toxicity.MOST_KNOWN + 3 * 12000 and most < 60e6
    assert np.array_equal(found[0], found[-1])
    for text, told in zip([*odd, many[0]], [*found[0], found[1][1]]):
        held = sorted(toxicity.units(text))
        of_units = sorted(toxicity.margins(model, held)[0], reverse=True)
        of_spans = sorted(
            (toxicity.BIAS + toxicity.margins(model, words)[1].sum() / max(len(words), toxicity.LEAST_SPAN_WORDS) for words in toxicity.spans(text)),
            reverse=True,
        )
        missing = [toxicity.BIAS] * 3
        assert np.allclose(told, [*(of_units + missing)[:3], *(of_spans + missing)[:2]], atol=1e-12)
