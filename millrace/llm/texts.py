"""Texts of an Arrow batch as one byte buffer, and cutting texts where byte-level tokenizers cut them too."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space as the tokenizers' pattern sees it (the Unicode property White_Space). Fixed values.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_RARE_BEFORE_BLANK = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
_COMMON_BEFORE_BLANK = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")

_SPACE = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# For Arrow: two white-space characters in a row, or a zero character, which marks cuts.
SPACES_MEET = rf"{_SPACE}{_SPACE}|\x00"


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each text in them; a null is an empty text."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def in_pieces(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``most_bytes``; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def strings(column: pa.Array) -> list[str]:
    return ["" if text is None else text for text in column.to_pylist()]


def chunks(text: str) -> tuple[str, list[str]]:
    """(head, tail): the text is the head and then every element of the tail with a blank before it.

    Cuts stand only before white space that follows other text. A pattern that takes white space alone, or one blank and
    the word after it, never matches across such a place, so the chunks can be encoded one by one.
    """
    irregular = any(pair in text for pair in _COMMON_BEFORE_BLANK) or (
        not text.isascii() and _RARE_BEFORE_BLANK.search(text)
    )
    if not irregular:
        head, *tail = text.split(" ")
        return head, tail
    head, tail = "", []
    for chunk in _CHUNK.findall(text):
        if not head and not tail:
            head = chunk
        elif chunk[0] == " ":
            tail.append(chunk[1:])
        elif tail:
            tail[-1] += chunk
        else:
            head += chunk
    return head, tail


class ChunkCache:
    """The bytes that ``encode`` gives for each distinct chunk of the texts seen so far; emptied when it holds too much."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most_chars: int = 8_000_000):
        self.encode, self.most_chars = encode, most_chars
        self.heads: dict[str, bytes] = {"": b""}
        self.tails: dict[str, bytes] = {}
        self.chars = 0

    def joined(self, texts: list[str]) -> Iterator[bytes]:
        """For each text the values of its chunks, end to end."""
        if self.chars > self.most_chars:
            self.heads, self.tails, self.chars = {"": b""}, {}, 0
        cut = [chunks(text) for text in texts]
        heads = list({head for head, _ in cut} - self.heads.keys())
        tails = list(set().union(*(tail for _, tail in cut)) - self.tails.keys())
        missing = heads + [" " + tail for tail in tails]
        values = self.encode(missing)
        self.heads.update(zip(heads, values))
        self.tails.update(zip(tails, values[len(heads) :]))
        self.chars += sum(map(len, missing))
        of_tail = self.tails.__getitem__
        for head, tail in cut:
            yield self.heads[head] + b"".join(map(of_tail, tail))
