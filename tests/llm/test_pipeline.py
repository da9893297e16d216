from __future__ import annotations

import re

import pytest
import tiktoken
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from llm_frames import documents
from millrace.llm import bpe, pii, queries, toxicity
from millrace.llm import tables as kept
from test_decontaminate import brute as leaks
from test_ngram_join import brute as components
from test_pii import brute as personal


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark, tables):
    more = [(None, "no id here but words enough for a shingle"), (900_000, None), (900_001, ""), (900_002, "a@b.cd 10.0.0.1"), (900_003, "same words again and again here")]
    extra = documents(spark, [*more, *[(900_004, "same words again and again here")] * 2, (900_005, "x" * 5000)])
    return spark.read.parquet(f"{tables}/documents.parquet").unionByName(extra).cache()


def test_toxic_documents_go(spark, tables, docs):
    left = rows(corpus_pipeline.drop_toxic(spark, docs, tables))
    model = queries.toxicity_model(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    assert left == rows(toxicity.score(docs, model).filter("predicted = 0"))


def test_one_of_each_group_stays(spark, tables, docs):
    out = corpus_pipeline.drop_near_duplicates(spark, docs, tables)
    assert out.columns == docs.columns
    left, all_rows = rows(out), rows(docs)
    by_row = {}
    for (i, n, c), (j, text) in zip(components(all_rows), sorted(all_rows, key=str)):
        by_row.setdefault(i, set()).add(c)
    assert set(left) <= set(all_rows) and len(set(left)) == len(left)
    kept_ids = {i for i, _ in left}
    for doc_id, found in by_row.items():
        for c in found:
            assert (c in kept_ids) if c is not None else True
            if c != doc_id:
                assert doc_id not in kept_ids


def test_documents_with_leaks_go(spark, tables, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {i for i, _, hit, _ in leaks(rows(docs), items) if not hit}
    out = corpus_pipeline.drop_contaminated(spark, docs, tables)
    assert out.columns == docs.columns and {i for i, _ in rows(out)} == clean


def test_personal_data_is_masked(spark, tables, docs):
    out = corpus_pipeline.mask_personal_data(spark, docs, tables)
    assert out.columns == docs.columns
    before, after = dict(rows(docs)), {r.doc_id: r for r in out.collect()}
    assert after[900_002].text == "<EMAIL> <IP>" and after[900_002].n_chars == 12 and after[900_000].text is None
    for doc_id, text in before.items():
        if not personal(text) and not re.search("[0-9]", text or ""):
            assert after[doc_id].text == text
        assert not personal(after[doc_id].text)


def test_tokens_decode_to_the_text(spark, tables, docs):
    vocabulary = bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    ids = {r.doc_id: list(r.ids) for r in corpus_pipeline.tokenize(spark, docs, tables).collect()}
    assert all(ids[i] == library.encode_ordinary(t or "") for i, t in rows(docs))


CLASHES = (
    "_id string, _tag int, _found_id string, _found_tag string, _spans string, margins string, Score string, predicted string, "
    "kept int, tag string, spans int, ids string, row string, n int, _aside_score int, text_sha256 int, part string"
)


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES[:-1]])
def test_columns_of_the_documents_stay_as_they_are(spark, tables, docs, stage):
    names = [field.split()[0] for field in CLASHES.split(", ")]
    kinds = [field.split()[1] for field in CLASHES.split(", ")]
    values = {n: F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")) if k == "string" else F.col("doc_id").cast("int") for n, k in zip(names, kinds)}
    wide = docs.select("*", *[value.alias(n) for n, value in values.items()])
    out = stage(spark, wide, tables)
    assert out.columns == wide.columns and out.dtypes == wide.dtypes
    plain = stage(spark, docs, tables)
    assert rows(out) == rows(plain)
    assert out.filter(~F.equal_null(F.col("predicted"), values["predicted"]) | ~F.equal_null(F.col("_tag"), values["_tag"])).isEmpty()
    before = {(r.doc_id, *r[5:]) for r in wide.collect()}
    assert {(r.doc_id, *r[5:]) for r in out.collect()} <= before


def test_every_stage_takes_an_empty_table(spark, tables):
    none = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, tables).count() == 0


def test_run_is_the_stages_in_turn(spark, tables):
    found = corpus_pipeline.run(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    digest = lambda df: sorted((r.doc_id, r.n_tokens, r.text_sha256) for r in df.collect())
    assert digest(found) == digest(docs) and len(digest(found)) > 100


def test_no_task_needs_two_workers(spark, tables, docs):
    plan = corpus_pipeline.tokenize(spark, docs, tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_workers_give_memory_back_after_a_task(monkeypatch):
    seen, taken = [], []

    def each(batches):
        for batch in batches:
            seen.append(batch)
            yield batch

    monkeypatch.setattr(kept, "give_back", lambda: seen.append("back"))
    frame = type("Frame", (), {"mapInArrow": lambda self, function, schema: taken.append(function)})()
    kept.map_batches(frame, each, "id long")
    assert list(taken[0]([1, 2])) == [1, 2] and seen == [1, 2, "back"]
