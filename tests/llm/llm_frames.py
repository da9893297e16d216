"""Literal tables for the tests of the training-data operators."""

from __future__ import annotations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", id long, tag string, spans string, kept string, score string, ids string, row string, _id string"


def documents(spark, rows, extra: bool = False):
    """Documents from (doc_id, text); with more columns whose names operators use too."""
    schema = DOCUMENTS + (CLASHING if extra else "")
    more = (7, "tag", "spans", "kept", "score", "ids", "row", "_id") if extra else ()
    full = [(i, t, "en", "s", len(t or ""), *more) for i, t in rows]
    return spark.createDataFrame(full, schema)


def rows_of(df) -> list[tuple]:
    return [tuple(row) for row in df.collect()]
