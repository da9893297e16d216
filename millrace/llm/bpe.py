"""Byte-level BPE by replaying the merges over all words of a block of texts at once.

The words of a block lie end to end in one array of tokens. An inverted index maps a merge, that is a token pair by its
rank, to the positions where the pair stands. Merges are applied in rank order, each at all of its positions, and only the
pairs next to a merged position are looked up and indexed again.

A merge may make a pair whose rank is lower than its own. The order between words never matters, but within a word the
lowest rank must come first, and then the leftmost place; such words are rare and are merged one by one instead.

A block is some megabytes of texts within a task, and each distinct word of a block is merged once. A table of all words
of the corpus would have to be joined to every word of every text again, a shuffle many times as large as the texts.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import tables, texts

BLOCK_BYTES = 4 << 20
_SHIFT = 32


class Vocabulary:
    """Ranks of byte strings, and the rank of every pair of tokens that makes a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        made = {
            (ranks[token[:cut]] << _SHIFT) | ranks[token[cut:]]: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }
        self.pair_keys = np.array(sorted(made), np.int64)
        self.pair_ranks = np.array([made[key] for key in self.pair_keys.tolist()], np.int64)

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        """A rank file: a line per token, its bytes in base 64 and its rank."""
        with open(path, "rb") as file:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the two make no token."""
        if not len(self.pair_keys):
            return np.full(len(left), -1, np.int64)
        keys = (left.astype(np.int64) << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge_alone(self, word: bytes) -> list[int]:
        """Tokens of one word: the lowest rank first, then the leftmost."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranked = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not ranked:
                break
            at = min(ranked)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[part] for part in parts]


class MergeReplay:
    """The merges over many words."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]):
        self.vocabulary, self.words = vocabulary, words
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.tokens = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        size = len(self.tokens)
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        self.following = np.arange(1, size + 1, dtype=np.int32)
        self.previous = np.arange(-1, size - 1, dtype=np.int32)
        full = lengths > 0
        ends = np.cumsum(lengths)[full]
        self.following[ends - 1] = -1
        self.previous[ends - lengths[full]] = -1
        self.alive = np.ones(size, bool)
        self.alone = np.zeros(len(words), bool)
        self.index: dict[int, list[np.ndarray]] = {}
        self.waiting: list[int] = []

    def enter(self, places: np.ndarray, ranks: np.ndarray) -> None:
        """Index the pairs that begin at these places."""
        known = ranks >= 0
        places, ranks = places[known], ranks[known]
        if not len(places):
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        firsts = np.concatenate([[0], cuts])
        for rank, first, last in zip(ranks[firsts].tolist(), firsts.tolist(), [*cuts.tolist(), len(places)]):
            if rank not in self.index:
                self.index[rank] = []
                heapq.heappush(self.waiting, rank)
            self.index[rank].append(places[first:last])

    def merge(self, rank: int) -> None:
        """Apply one merge wherever its pair still stands, and index the pairs it makes."""
        tokens, following, previous = self.tokens, self.following, self.previous
        found = self.index.pop(rank)
        places = np.unique(np.concatenate(found))
        places = places[self.alive[places] & (following[places] >= 0) & ~self.alone[self.word[places]]]
        places = places[self.vocabulary.rank(tokens[places], tokens[following[places]]) == rank]
        if not len(places):
            return
        # In a row of equal tokens every second pair overlaps the one before; the leftmost ones count.
        overlaps = np.concatenate([[False], following[places[:-1]] == places[1:]])
        if overlaps.any():
            at = np.arange(len(places))
            run_start = np.maximum.accumulate(np.where(overlaps, 0, at))
            places = places[(at - run_start) % 2 == 0]
        right = following[places]
        after = following[right]
        before_merge = tokens[after]
        tokens[places] = rank
        self.alive[right] = False
        following[places] = after
        has_after = after >= 0
        previous[after[has_after]] = places[has_after]

        before = previous[places]
        has_before = before >= 0
        left_ranks = self.vocabulary.rank(tokens[before[has_before]], tokens[places[has_before]])
        right_ranks = self.vocabulary.rank(tokens[places[has_after]], tokens[after[has_after]])
        between = self.vocabulary.rank(tokens[places[has_after]], before_merge[has_after])
        for ranks, where in ((left_ranks, has_before), (right_ranks, has_after), (between, has_after)):
            out_of_order = (ranks >= 0) & (ranks < rank)
            if out_of_order.any():
                self.alone[self.word[places[where][out_of_order]]] = True
        self.enter(
            np.concatenate([before[has_before], places[has_after]]), np.concatenate([left_ranks, right_ranks])
        )

    def run(self) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        if not len(self.tokens):
            return [b""] * len(self.words)
        starts = np.flatnonzero(self.following >= 0).astype(np.int32)
        self.enter(starts, self.vocabulary.rank(self.tokens[starts], self.tokens[self.following[starts]]))
        while self.waiting:
            self.merge(heapq.heappop(self.waiting))
        ids = self.tokens[self.alive].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(self.word[self.alive], minlength=len(self.words)))).tolist()
        merged = [ids[start:end] for start, end in zip([0, *ends], ends)]
        for place in np.flatnonzero(self.alone).tolist():
            merged[place] = np.array(self.vocabulary.merge_alone(self.words[place]), "<i4").tobytes()
        return merged


def word_encoder(vocabulary: Vocabulary, pattern: str):
    """A function from chunks of text to the id bytes of each. The pattern keeps letters and a blank before them whole."""
    import regex

    split = regex.compile(pattern).findall

    def encode(parts: list[str]) -> list[bytes]:
        # Letters with at most a blank before them are one word by the pattern.
        pieces = [[part] if part.isalpha() or part[:1] == " " and part[1:].isalpha() else split(part) for part in parts]
        distinct = list({piece for cut in pieces for piece in cut})
        known, merged = {}, []
        for piece in distinct:
            plain = piece.encode()
            whole = vocabulary.ranks.get(plain)
            if whole is None:
                merged.append(piece)
            else:
                known[piece] = whole.to_bytes(4, "little")
        known.update(zip(merged, MergeReplay(vocabulary, [piece.encode() for piece in merged]).run()))
        return [known[cut[0]] if len(cut) == 1 else b"".join([known[piece] for piece in cut]) for cut in pieces]

    return encode


def encode(
    df: DataFrame, vocabulary: Vocabulary, pattern: str, text_column: str = "text", ids_column: str = "ids"
) -> DataFrame:
    """Add the token ids (array<int>) of every text; a null or empty text has none. A column of that name is replaced.

    ``pattern`` splits a text before the merges; it must match white space alone, or one blank with what follows it, as the
    patterns of byte-level vocabularies do. No special tokens are looked for.
    """
    shared = tables.share(df.sparkSession, vocabulary)  # a vocabulary file: does not grow with the data

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        cache = texts.ChunkCache(word_encoder(shared(), pattern))
        for batch in texts.in_pieces(batches, text_column, BLOCK_BYTES):
            plains = list(cache.joined(texts.strings(batch.column(text_column))))
            ends = np.cumsum([0, *(len(plain) // 4 for plain in plains)])
            ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(plains))])
            yield batch, [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)]

    return tables.append(df, f"`{ids_column}` array<int>", each)


def decode(df: DataFrame, vocabulary: Vocabulary, ids_column: str = "ids", bytes_column: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; null for null. An id outside the vocabulary is an error."""
    shared = tables.share(df.sparkSession, vocabulary.bytes_of)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        token = shared().__getitem__
        for batch in batches:
            rows = batch.column(ids_column)
            ids, ends = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
            plains = [
                b"".join(map(token, ids[start:end].tolist())) if present else None
                for start, end, present in zip(ends, ends[1:], rows.is_valid().to_pylist())
            ]
            yield batch, [pa.array(plains, pa.binary())]

    return tables.append(df, f"`{bytes_column}` binary", each)
