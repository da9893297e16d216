from __future__ import annotations

import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyarrow import fs
from tokenizers import Tokenizer

from llm_frames import documents, rows_of
from millrace.llm import bpe, queries, texts, token_files

ALPHABET = "ab thethe ing\n \t!'s’é\x85\xa0 　.1\x1c<|endoftext|>_漢🙂"


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def tokenizer(definition):
    made = Tokenizer.from_str(definition)
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def odd_texts(count=3000):
    rng = random.Random(2)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(50))) for _ in range(count)]
    return made + ["", "a" * 3000, " " * 500 + "x", "=-" * 800, "the" * 900, "\n\n\n", "x \n y", "<|endoftext|>", "don't we'll"]


def test_chunks_make_the_text_again():
    for text in odd_texts():
        head, tail = texts.chunks(text)
        assert "".join([head, *(" " + part for part in tail)]) == text


def test_encoder_equals_whole_texts(definition, tokenizer):
    encode = token_files.encoder(definition, 2)
    many = odd_texts()
    for text, plain in zip(many, encode(pa.array(many))):
        assert np.frombuffer(plain, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_encoder_forgets_and_cuts_at_marks_and_breaks(definition, tokenizer):
    of = token_files.WordIds(token_files.chunk_encoder(tokenizer), most_chars=40).of
    many = ["One, two.\nThree? four", "\nbreak first", "break last\n", "mark.", "été, über.\nØre", "a,b ,c, d ,", "zero\0mark.\0 end", " ", "\n", ","]
    for _ in range(3):
        for start in range(0, len(many), 2):
            part = many[start : start + 2]
            for text, plain in zip(part, of(pa.array(part, pa.large_string()))):
                assert np.frombuffer(plain, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_one_id_and_rows_without_id_fill_several_shards(spark, definition, tmp_path):
    rows = [(None, f"text {i}") for i in range(3000)] + [(7, f"other {i % 900}") for i in range(1500)] + [(8, "end")]
    shards = token_files.write(documents(spark, rows), f"file://{tmp_path}", definition, 2, shards=6)
    held = sorted(shards.collect())
    assert max(s.n_docs for s in held) < 2000 and sum(s.n_docs for s in held) == len(rows)
    assert [s.start for s in held] == [sum(s.n_tokens for s in held[:i]) for i in range(len(held))]
    found = token_files.read(spark, shards, f"file://{tmp_path}").orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert ids == [None] * 3000 + [7] * 1500 + [8]
    assert len(token_files.read(spark, shards, f"file://{tmp_path}", only=[7]).collect()) == 1500


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_merge_replay_equals_the_library(name):
    vocabulary = bpe.Vocabulary.from_file(public_tokenizers.path(name))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    many = odd_texts()
    cache = texts.ChunkCache(bpe.word_encoder(vocabulary, public_tokenizers.PATTERN))
    for text, plain in zip(many, cache.joined(many)):
        assert np.frombuffer(plain, "<i4").tolist() == library.encode_ordinary(text)


def test_merges_out_of_rank_order():
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"ab": 300, b"abc": 299, b"cd": 301, b"bc": 302, b"aa": 303, b"aaa": 5}
    vocabulary = bpe.Vocabulary(ranks)
    words = [b"abcd", b"abab", b"aaaa", b"aaaaa", b"bcd", b"abcabc", b"", b"xyz", b"aabcaa"]
    got = [np.frombuffer(plain, "<i4").tolist() for plain in bpe.MergeReplay(vocabulary, words).run()]
    assert got == [vocabulary.merge_alone(word) for word in words]


def test_encode_and_decode(spark, vocabulary):
    rows = [(1, None), (2, ""), (2, ""), (None, "Grüße, the 漢字"), (4, "x y " * 30_000)]
    encoded = bpe.encode(documents(spark, rows, extra=True), vocabulary, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, vocabulary).select("doc_id", "ids", "decoded", "tag").collect()
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert all((len(r.ids) == 0) == (len(r.decoded) == 0) and r.tag == "tag" for r in back)


def test_decode_keeps_nulls(spark, vocabulary):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [464])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(rows, vocabulary).collect()}
    assert got == {1: None, 2: b"", 3: b"The"}


def test_token_files_round_trip(spark, definition, tokenizer, tmp_path):
    rows = [(5, "five"), (1, None), (3, ""), (3, "three"), (None, "no id"), (2, "word " * 40_000), (5, "five")]
    path = str(tmp_path / "tokens")
    shards = token_files.write(documents(spark, rows, extra=True), path, definition, 2, shards=3)
    got = token_files.read(spark, shards, path).orderBy("start").collect()
    start = 0
    for row, (doc_id, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, start, len(ids))
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        start += len(ids)
    assert sorted(r.doc_id for r in token_files.read(spark, shards, path, only=[5, 2, 99]).collect()) == [2, 5, 5]


def test_reader_takes_one_frame_and_finds_damage(spark, definition, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write(documents(spark, [(i, f"text {i} " * 50) for i in range(20)]), path, definition, 2, shards=1)
    (file,) = glob.glob(f"{path}/shard-*")
    with fs.LocalFileSystem().open_input_file(file) as source:
        reader = token_files.ShardReader(source)
        assert len(reader) == 20 and list(reader.places(7)) == [7] and list(reader.places(50)) == []
        plain, (first, last) = reader.plain(7), (int(reader.starts[7]), int(reader.starts[8]))
    with open(file, "rb") as whole:
        content = bytearray(whole.read())
    import zstandard

    assert zstandard.ZstdDecompressor().decompress(bytes(content[first:last])) == plain
    content[first:last] = zstandard.ZstdCompressor(level=3).compress(plain[::-1])[: last - first].ljust(last - first, b"\0")
    broken = str(tmp_path / "broken")
    with open(broken, "wb") as out:
        out.write(content)
    with fs.LocalFileSystem().open_input_file(broken) as source:
        with pytest.raises((token_files.ChecksumError, zstandard.ZstdError)):
            token_files.ShardReader(source).plain(7)


def test_empty_tables(spark, definition, vocabulary, tmp_path):
    none = documents(spark, [])
    path = str(tmp_path / "tokens")
    assert rows_of(token_files.read(spark, token_files.write(none, path, definition, 2), path)) == []
    assert rows_of(bpe.decode(bpe.encode(none, vocabulary, public_tokenizers.PATTERN), vocabulary)) == []


def test_queries_equal_the_libraries(spark, tables, tokenizer, vocabulary):
    import hashlib

    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    files = {r.doc_id: r for r in queries.QUERIES["op5_token_files"](spark, tables).collect()}
    merged = {r.doc_id: r for r in queries.QUERIES["op8_byte_bpe"](spark, tables).collect()}
    start = 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (files[doc_id].start, files[doc_id].n_tokens, files[doc_id].ids_crc32) == (start, len(ids), crc)
        start += len(ids)
        ids = library.encode_ordinary(text or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (merged[doc_id].n_tokens, merged[doc_id].ids_sha256) == (len(ids), digest)
        assert merged[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
