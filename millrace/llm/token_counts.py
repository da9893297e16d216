"""Numbers of tokens without token ids: a word's length is looked up, not its tokens.

A pre-token is a run of characters between ASCII white space. For tokenizers that drop white space, its number of tokens
does not depend on what stands around it, so a text has the sum of the lengths of its pre-tokens. Two tiers know them:

* a table of frequent pre-tokens with their lengths, sent to every executor: at most ``words`` entries, drawn from at most
  about ``rows`` texts. It only decides which tier answers, never a count.
* a cache in every worker for all others. What it misses is encoded by the tokenizer, each distinct pre-token once, and
  kept until the cache holds ``CACHED`` of them; then it starts anew.

All texts are read in one pass, within their own tasks; no pre-token is ever shuffled.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import tables, texts

TABLE_ROWS = 2048
TABLE_WORDS = 1 << 16
TABLE_TASKS = 8
MOST_WORD_BYTES = 64
CACHED = 400_000
PIECE_BYTES = 4 << 20

_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class FrequentLengths:
    """Frequent pre-tokens and their numbers of tokens, packed: words end to end by line breaks, and a number for each."""

    words: bytes
    lengths: bytes

    @classmethod
    def packed(cls, known: dict[str, int]) -> FrequentLengths:
        return cls(zlib.compress("\n".join(known).encode()), np.array(list(known.values()), "<u4").tobytes())

    def table(self) -> dict[str, int]:
        words = zlib.decompress(self.words).decode().split("\n")
        return dict(zip(words, np.frombuffer(self.lengths, "<u4").tolist()))


def open_tokenizer(definition: str):
    """A tokenizer as its library opens it, so special strings in a text are special tokens; no truncation or padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def drops_blanks(definition: str) -> bool:
    """Whether a text can be cut at white space: every step looks at single characters or at runs without white space."""
    parsed = json.loads(definition)

    def steps(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]

    normal = steps(parsed.get("normalizer"), "normalizers")
    before = steps(parsed.get("pre_tokenizer"), "pretokenizers")
    plain = all(
        step["type"] in ("NFC", "NFD", "Lowercase") or step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"}
        for step in normal
    )
    first = before[0] if before else {"type": None}
    removed = first["type"] in ("Whitespace", "WhitespaceSplit") or (
        first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"]
        and first["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    )
    inner = all(step["type"] == "ByteLevel" and not step["add_prefix_space"] for step in before[1:])
    whole = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not set(t["content"]) & set(" \t\n\r\v\f")
                for t in parsed.get("added_tokens") or [])
    return plain and removed and inner and whole


def encoded_lengths(tokenizer) -> Callable[[list[str]], list[int]]:
    def lengths(parts: list[str]) -> list[int]:
        return [len(each.ids) for each in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    return lengths


def pre_tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of an array of texts and the offset of each text in them; some are empty."""
    split = pc.ascii_split_whitespace(column.cast(pa.large_string()))
    offsets = split.offsets.to_numpy().astype(np.int64)
    return split.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def long_parts(data: np.ndarray, most_bytes: int) -> Iterator[np.ndarray]:
    """A long text in parts of about ``most_bytes`` that begin at white space; a longer word is not cut."""
    start = 0
    while len(data) - start > most_bytes:
        stop = start + most_bytes
        while stop < len(data):
            blank = np.flatnonzero(_BLANKS[data[stop : stop + most_bytes]])
            if len(blank):
                stop += int(blank[0])
                break
            stop += most_bytes
        yield data[start : min(stop, len(data))]
        start = min(stop, len(data))
    yield data[start:]


class Lengths:
    """Both tiers."""

    def __init__(self, frequent: dict[str, int], encode: Callable[[list[str]], list[int]], cached: int = CACHED):
        self.frequent, self.encode, self.most = frequent, encode, cached
        self.cache: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        """The length of each word, all unlike."""
        found = list(map(self.frequent.get, words))
        if len(self.cache) > self.most:
            self.cache.clear()
        missed = [place for place, length in enumerate(found) if length is None]
        fresh = [words[place] for place in missed if words[place] not in self.cache]
        known = dict(zip(fresh, self.encode(fresh))) if fresh else {}
        for place in missed:
            word = words[place]
            found[place] = known[word] if word in known else self.cache[word]
        self.cache.update((word, length) for word, length in known.items() if len(word) <= MOST_WORD_BYTES)
        return np.array(found, np.int64)

    def totals(self, column: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        words, offsets = pre_tokens(column)
        encoded = words.dictionary_encode()
        each = self.of(encoded.dictionary.to_pylist())[encoded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(each)])
        return ends[offsets[1:]] - ends[offsets[:-1]]

    def total_of_long(self, data: np.ndarray) -> int:
        return sum(int(self.totals(pa.array([part.tobytes().decode()]))[0]) for part in long_parts(data, PIECE_BYTES))


def frequent_lengths(
    df: DataFrame, definition: str, text_column: str = "text", rows: int = TABLE_ROWS, words: int = TABLE_WORDS
) -> FrequentLengths:
    """The most frequent pre-tokens of about ``rows`` texts drawn at random; counted in a few tasks, merged by the driver.

    Each task returns at most ``words`` of them, so what is gathered is bounded by the parameters.
    """
    share = min(1.0, rows / max(1, df.count()))
    drawn = df.select(F.col(text_column).cast("string").alias("text")).sample(share, seed=13).filter("text IS NOT NULL")
    shared = tables.share(df.sparkSession, definition)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoded_lengths(open_tokenizer(shared()))
        seen: Counter[str] = Counter()
        for batch in texts.in_pieces(batches, "text", PIECE_BYTES):
            data, offsets = texts.utf8(batch.column("text"))
            for part in long_parts(data, PIECE_BYTES):
                counted = pre_tokens(pa.array([part.tobytes().decode()]))[0].value_counts()
                seen.update(dict(zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist())))
            if len(seen) > 8 * words:
                seen = Counter(dict(seen.most_common(4 * words)))
        top = [(word, n) for word, n in seen.most_common(words) if word and len(word) <= MOST_WORD_BYTES]
        lengths = encode([word for word, _ in top])
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()), pa.array(lengths, pa.int64())],
            names=["word", "n", "length"],
        )

    # A blank goes between texts of a batch, as their bytes are counted end to end.
    spaced = drawn.withColumn("text", F.concat("text", F.lit(" "))).repartition(TABLE_TASKS)
    total: Counter[str] = Counter()
    length_of: dict[str, int] = {}
    for row in spaced.mapInArrow(count, "word string, n long, length long").collect():
        total[row.word] += row.n
        length_of[row.word] = row.length
    return FrequentLengths.packed({word: length_of[word] for word, _ in total.most_common(words)})


def count_tokens(
    df: DataFrame, definition: str, text_column: str = "text", limit: int | None = None, rows: int = TABLE_ROWS,
    words: int = TABLE_WORDS,
) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and, with a ``limit``, ``over_limit``; columns of these names are replaced.

    ``definition`` is the JSON of a tokenizer. Special strings in a text count as the tokenizer's own special tokens. A null
    text is empty; an empty text has no tokens. A tokenizer that keeps white space encodes whole texts. Repeated rows stay,
    and an empty table gives an empty one.
    """
    cut = drops_blanks(definition)
    frequent = frequent_lengths(df, definition, text_column, rows, words) if cut else FrequentLengths.packed({})
    shared = tables.share(df.sparkSession, (definition, frequent))  # of bounded size

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        lengths = _worker_lengths(*shared())
        for batch in texts.in_pieces(batches, text_column, PIECE_BYTES):
            column = pc.fill_null(batch.column(text_column).cast(pa.large_string()), "")
            n_bytes = pc.binary_length(column).cast(pa.int64())
            if not cut:
                totals = np.array(lengths.encode(column.to_pylist()), np.int64)
            elif batch.num_rows == 1:  # a text above the size of a batch comes alone
                totals = np.array([lengths.total_of_long(texts.utf8(column)[0])], np.int64)
            else:
                totals = lengths.totals(column)
            yield batch, [n_bytes, pa.array(totals)]

    counted = tables.append(df.drop("over_limit"), "n_bytes long, n_tokens long", each)
    return counted if limit is None else counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _worker_lengths(definition: str, frequent: FrequentLengths) -> Lengths:
    """The tiers of this worker, kept from task to task: those of the latest tokenizer and table only."""
    held, key = tables.worker_cache(), (definition, frequent.words, frequent.lengths)
    if held.get("lengths", (None,))[0] != key:
        held["lengths"] = key, Lengths(frequent.table(), encoded_lengths(open_tokenizer(definition)))
    return held["lengths"][1]
