from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_frames import documents, rows_of
from millrace.llm import queries, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")

TEXTS = [
    None, "", " ", "\n\t", "plain words", "Upper CASE, it's we'll don't 'sand", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>",
    "<|ENDOFTEXT|>", "<|endof text|>", "<| endoftext |>", "café café ́ alone", "x y z\u0085w\x1cv\x0bu",
    "中文字 123 45,6", "İΣσς ẞ", "emoji \U0001f600\U0001f468‍\U0001f469", "\x00\x01", "a" * 5000,
    "word " * 20000, "''s 's 'S 'T", "...!!! ?!", "กำ क्ष", "tab\tline\r\nend ", "à b ̧́",
]


def definition(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def expected(path: str, texts) -> list[int]:
    tokenizer = Tokenizer.from_file(path)
    return [len(tokenizer.encode(text or "", add_special_tokens=False).ids) for text in texts]


@pytest.mark.parametrize("path, words", [(WORDS, 1 << 16), (WORDS, 3), (BYTES, 100)])
def test_equals_the_library(spark, path, words):
    rows = list(enumerate(TEXTS)) + [(5, TEXTS[5]), (None, "null id"), (7, "other text of an id")]
    df = documents(spark, rows, extra=True).repartition(3)
    counted = token_counts.count_tokens(df, definition(path), limit=10, words=words)
    assert set(df.columns) | {"n_bytes", "n_tokens", "over_limit"} == set(counted.columns)
    lengths = expected(path, [text for _, text in rows])
    want = [(i, len((text or "").encode()), n, n > 10, "kept") for (i, text), n in zip(rows, lengths)]
    got = counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "kept")
    assert sorted(rows_of(got), key=str) == sorted(want, key=str)


def test_columns_of_the_result_are_replaced(spark):
    df = spark.createDataFrame([("a b", "x", 1)], "text string, n_tokens string, over_limit int")
    assert rows_of(token_counts.count_tokens(df, definition(WORDS), limit=1).select("n_tokens", "over_limit")) == [(2, True)]


def test_empty_table(spark):
    df = documents(spark, [])
    assert rows_of(token_counts.count_tokens(df, definition(WORDS))) == []


def test_tiers_and_a_small_cache():
    tokenizer = token_counts.open_tokenizer(definition(WORDS))
    asked: list[str] = []

    def encode(parts):
        asked.extend(parts)
        return token_counts.encoded_lengths(tokenizer)(parts)

    lengths = token_counts.Lengths({"the": 1}, encode, cached=2)
    for text in ("the the cat", "the cat sat", "on the mat today", "cat"):
        assert lengths.totals(pa.array([text, "the"])).tolist() == expected(WORDS, [text, "the"])
    assert "the" not in asked
    assert asked.count("cat") == 2  # forgotten with the full cache, asked once before that
    packed = token_counts.FrequentLengths.packed({"a": 1, "éb": 70000})
    assert packed.table() == {"a": 1, "éb": 70000}


@pytest.mark.parametrize("size", [1, 7, 64])
def test_long_texts_are_cut_at_blanks(size):
    text = "some été words,\nwith\tblanks  " + "x" * 200 + " end"
    data = np.frombuffer(text.encode(), np.uint8)
    parts = [part.tobytes().decode() for part in token_counts.long_parts(data, size)]
    assert "".join(parts) == text
    assert sum(expected(WORDS, parts)) == expected(WORDS, [text])[0]


def test_texts_are_cut_only_where_blanks_are_dropped():
    assert token_counts.drops_blanks(definition(WORDS))
    assert not token_counts.drops_blanks(definition(BYTES))


def test_query_equals_the_library(spark, tables):
    texts = {row.doc_id: row.text for row in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    want = dict(zip(texts, expected(WORDS, texts.values())))
    got = rows_of(queries.QUERIES["op13_token_counts"](spark, tables).select("doc_id", "n_tokens", "n_bytes", "over_limit"))
    assert sorted(got) == sorted((i, n, len((texts[i] or "").encode()), n > 2048) for i, n in want.items())
