from __future__ import annotations

import re
import zlib

import zstandard
from pyspark.sql import functions as F

from llm_frames import documents, rows_of
from millrace.llm import language, queries

SAMPLES = {
    "en": "the weather was nice and they went with their friends to the river where the water is clear",
    "de": "das wetter war schön und sie gingen mit ihren freunden zum fluss wo das wasser klar ist",
    "fr": "le temps était beau et ils sont allés avec leurs amis à la rivière où l'eau est claire",
}


def model(spark, rows=None):
    rows = [(i, text, lang, "s", 1) for i, (lang, text) in enumerate(SAMPLES.items())] if rows is None else rows
    return language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def told(spark, learned, many):
    found = language.predict(documents(spark, list(enumerate(many)), extra=True), learned)
    return [(r.lang_pred, r.score, r.accepted) for r in found.orderBy("doc_id").collect()]


def test_languages_and_rejection(spark):
    many = ["They went to the river with friends", "Sie gingen mit Freunden zum Fluss", "ils sont allés à la rivière", "zzz qqq"]
    got = told(spark, model(spark), many)
    assert [g[0] for g in got[:3]] == ["en", "de", "fr"] and all(g[2] and 0 < g[1] <= 1 for g in got[:3])
    assert got[3][0] in SAMPLES and not got[3][2]


def test_nulls_letters_and_long_texts(spark):
    got = told(spark, model(spark), [None, "", " \n", "123 ½² !?", "漢", SAMPLES["de"] * 3000, "x" * 300_000])
    assert [g[0] for g in got[:4]] == ["und"] * 4 and not any(g[2] for g in got[:4])
    assert got[4][0] in SAMPLES and got[5][0] == "de" and got[6][0] in SAMPLES


def test_rows_that_teach_nothing(spark):
    rows = [(1, None, "en", "s", 1), (2, "abc def", None, "s", 1), (3, "123", "de", "s", 1), (4, "the river", "en", "s", 1)]
    assert {g[0] for g in told(spark, model(spark, rows), ["the river", "zum fluss"])} <= {"en", "de"}
    assert [g[0] for g in told(spark, model(spark, []), ["the river"])] == ["und"]
    assert rows_of(language.predict(documents(spark, []), model(spark))) == []


def test_sample_is_bounded_and_repeatable(spark):
    rows = [(i, f"word{i % 50} text", "en", "s", 1) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    small = language.train(frame, rows=5)
    assert small == language.train(frame.repartition(7), rows=5)
    assert small.dictionaries["en"].count(b"word") == 5


def brute(rows):
    """Language and margin of (doc_id, text, lang, place): dictionaries and sizes by their definition."""
    letters = lambda text: re.sub(r"[\W\d_]+", " ", text.lower())
    usable = lambda plain: any(c.isalpha() for c in plain)
    contents = {}
    for lang in sorted({r[2] for r in rows if r[2] is not None}):
        learn = sorted((r for r in rows if r[2] == lang and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2), key=lambda r: r[3])
        plain = [p for p in (letters(r[1]) for r in learn) if usable(p)]
        snippets, size = [], 0
        for start in range(0, max(map(len, plain), default=0), language.SNIPPET_CHARS):
            for text in plain:
                part = text[start : start + language.SNIPPET_CHARS].encode()
                if part and size < language.DICTIONARY_BYTES:
                    snippets.append(part)
                    size += len(part) + 1
        contents[lang] = b" ".join(snippets[::-1])[-language.DICTIONARY_BYTES :]
    out = {}
    for doc_id, text, _, _ in rows:
        plain = letters(text or "")
        if not usable(plain):
            out[doc_id] = ("und", 0.0)
            continue
        data, sizes = plain.encode(), []
        for lang, content in contents.items():
            given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given.precompute_compress(level=language.LEVEL)
            one = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=given, write_content_size=False, write_checksum=False, write_dict_id=False)
            total = 0
            for start in range(0, len(data), language.PIECE_BYTES):
                total += len(one.compress(data[start : start + language.PIECE_BYTES]))
            sizes.append((total, lang))
        (best, lang), (second, _) = sorted(sizes)[:2]
        out[doc_id] = (lang, (second - best) / second)
    return out


def test_query_equals_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumn("place", F.xxhash64("doc_id"))
    want = brute([tuple(r) for r in docs.select("doc_id", "text", "lang", "place").collect()])
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.QUERIES["op9_language"](spark, tables).collect()}
    assert got == want


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.QUERIES["op9_language"](spark, folder).collect() if r.held_out and lang[r.doc_id]]
    assert len(rows) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) >= 0.95
