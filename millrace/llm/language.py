"""Language by compression: the language whose text helps most to compress a text.

For every language the texts of some labelled rows become a raw-content dictionary of zstandard. A text is cut into
pieces, every piece is compressed with each dictionary, and the language with the smallest total wins. The margin to the
second one says how sure that is.

The model is a bounded sample: at most ``rows`` labelled rows of a language, those with the lowest hash of their id, and a
dictionary of at most ``dictionary_bytes``. Texts to be told are compressed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import tables, texts

UNKNOWN = "und"
ROWS = 1000
DICTIONARY_BYTES = 512 << 10
SNIPPET_CHARS = 800
PIECE_BYTES = 4 << 10
LEVEL = 5
READ_BYTES = 4 << 20

_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass
class LanguageModel:
    """A raw-content dictionary for each language."""

    dictionaries: dict[str, bytes]


def letters_only(text: str) -> str:
    """Lower case, a blank for everything that is no letter."""
    return _NOT_LETTERS.sub(" ", text.lower())


def has_letter(plain: str) -> bool:
    return any(map(str.isalpha, plain))


def _dictionary(samples: list[str], most_bytes: int) -> bytes:
    """Snippets of all samples in turn, so that a long text does not fill it; the end of a dictionary is cheapest to point at."""
    plain = [text for text in map(letters_only, samples) if has_letter(text)]
    snippets: list[bytes] = []
    size, place = 0, 0
    while size < most_bytes and any(len(text) > place for text in plain):
        for text in plain:
            snippet = text[place : place + SNIPPET_CHARS].encode()
            if snippet and size < most_bytes:
                snippets.append(snippet)
                size += len(snippet) + 1
        place += SNIPPET_CHARS
    return b" ".join(reversed(snippets))[-most_bytes:]


def train(
    labelled: DataFrame, language_column: str = "lang", text_column: str = "text", order: Column | None = None,
    rows: int = ROWS, dictionary_bytes: int = DICTIONARY_BYTES,
) -> LanguageModel:
    """Learn from at most ``rows`` rows of every language, the first by ``order`` (by default the hash of the text).

    Rows without language or text are left out, and texts without letters teach nothing. Without any row the model knows no language.
    """
    order = F.xxhash64(text_column) if order is None else order
    usable = labelled.select(
        F.col(language_column).cast("string").alias("language"), F.col(text_column).cast("string").alias("text"),
        order.alias("place"),
    ).filter("text IS NOT NULL")
    chosen = tables.first_rows(usable, "language", "place", rows)
    samples: dict[str, list] = {}
    for row in chosen.collect():  # at most ``rows`` rows a language
        samples.setdefault(row.language, []).append((row.place, row.text))
    return LanguageModel(
        {
            language: _dictionary([text for _, text in sorted(found)], dictionary_bytes)
            for language, found in sorted(samples.items())
        }
    )


def classifier(model: LanguageModel, level: int = LEVEL):
    """A function from a text to (language, margin)."""
    compress = {
        language: _compressor(content, level).compress for language, content in model.dictionaries.items()
    }

    def tell(text: str) -> tuple[str, float]:
        plain = letters_only(text)
        if not compress or not has_letter(plain):
            return UNKNOWN, 0.0
        content = plain.encode()
        pieces = [content[start : start + PIECE_BYTES] for start in range(0, len(content), PIECE_BYTES)]
        sizes = sorted((sum(len(each(piece)) for piece in pieces), language) for language, each in compress.items())
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        (best, language), (second, _) = sizes[:2]
        return language, (second - best) / second

    return tell


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        level=level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def predict(
    df: DataFrame, model: LanguageModel, text_column: str = "text", least_margin: float = 0.02
) -> DataFrame:
    """Add ``lang_pred``, ``score`` (the margin: 0 to 1) and ``accepted``; columns of these names are replaced.

    ``accepted`` is false where the margin is below ``least_margin`` or the text is null or has no letter; then
    ``lang_pred`` is the nearest language all the same, or ``und`` without letters.
    """
    shared = tables.share(df.sparkSession, model)  # bounded by the languages' dictionaries

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        tell = classifier(shared())
        for batch in texts.in_pieces(batches, text_column, READ_BYTES):
            told = [tell(text) for text in texts.strings(batch.column(text_column))]
            yield batch, [
                pa.array([language for language, _ in told], pa.string()),
                pa.array([margin for _, margin in told], pa.float64()),
                pa.array([language != UNKNOWN and margin >= least_margin for language, margin in told], pa.bool_()),
            ]

    return tables.append(df, "lang_pred string, score double, accepted boolean", each)
