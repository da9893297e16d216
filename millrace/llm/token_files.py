"""Token-id files: one zstandard frame per document, a trailing seek table, a checksum per frame.

A shard holds the documents of one range of doc_id, ascending:

    frame of document 0 | frame of document 1 | ... | document index | seek table

Each frame is an independent zstandard frame of little-endian unsigned 32-bit ids. The document index is a skippable
frame with the ids and token counts of the documents. The seek table is the public seekable format of zstandard: a
skippable frame with compressed size, plain size and checksum of every frame, then the number of frames, a flag byte and a
magic number. A reader takes the end of the file first and then only the bytes of the documents that it wants.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import tables, texts

# Of the zstandard formats. Fixed values.
SKIPPABLE_MAGIC = 0x184D2A50
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

PIECE_BYTES = 6 << 20
SHARD_BYTES = 48 << 20
LEVEL = 3
MARKS = ".,;:!?"
MOST_KNOWN_CHARS = 4_000_000
CUT = "\x00"

# How byte-level tokenizers write a byte: printable ones as themselves, the others from U+0100 on. A fixed rule.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
VISIBLE_BYTES = {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


class ChecksumError(ValueError):
    """A frame does not hold what was written."""


def checksum(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class ShardWriter:
    """Writes one shard; only the index is held in memory."""

    def __init__(self, out, level: int = LEVEL):
        self.out, self.compressor = out, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []

    def add(self, doc_id: int | None, plain: bytes) -> None:
        frame = self.compressor.compress(plain)
        self.out.write(frame)
        self.frames.append((len(frame), len(plain), checksum(plain)))
        self.ids.append(doc_id)

    def finish(self) -> None:
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        index = self.compressor.compress(known.tobytes() + ids.tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(index)) + index)
        table = np.array(self.frames, "<u4").reshape(-1, 3).tobytes()
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(table) + len(footer)) + table + footer)


class ShardReader:
    """Random access to the documents of a shard."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a token file")
        table_start = size - 9 - 12 * count
        source.seek(table_start)
        self.frames = np.frombuffer(source.read(12 * count), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        index_start = int(self.starts[-1]) + 8
        source.seek(index_start)
        index = zstandard.ZstdDecompressor().decompress(source.read(table_start - 8 - index_start))
        self.known = np.frombuffer(index, np.uint8, count).astype(bool)
        self.ids = np.frombuffer(index, "<i8", count, offset=count)
        self.counts = self.frames[:, 1] // 4
        self.decompressor = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.frames)

    def doc_id(self, place: int) -> int | None:
        return int(self.ids[place]) if self.known[place] else None

    def plain(self, place: int) -> bytes:
        """The id bytes of the document at a place; reads and decompresses its frame alone."""
        self.source.seek(int(self.starts[place]))
        frame = self.source.read(int(self.frames[place, 0]))
        plain = self.decompressor.decompress(frame, max_output_size=max(1, int(self.frames[place, 1])))
        if len(plain) != self.frames[place, 1] or checksum(plain) != self.frames[place, 2]:
            raise ChecksumError(f"document {place}")
        return plain

    def places(self, doc_id: int) -> range:
        """Where documents with this id stand; documents without id come first."""
        first = int((~self.known).sum())
        ids = self.ids[first:]
        return range(first + int(np.searchsorted(ids, doc_id)), first + int(np.searchsorted(ids, doc_id, "right")))


def open_tokenizer(definition: str):
    """A tokenizer whose special tokens are ordinary text, and whether white space cuts its texts."""
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = True
    parsed = json.loads(definition)
    before = parsed.get("pre_tokenizer") or {}
    plain_bytes = (
        before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and not parsed.get("normalizer")
    )
    return tokenizer, plain_bytes


class WordIds:
    """The id bytes of whole texts, put together from those of their parts.

    Where no two white-space characters meet, the pattern of byte-level tokenizers always cuts before a blank, before and
    after a line break, and between a letter and a mark that white space follows. Texts are cut there as one Arrow array;
    each distinct part is looked up once a batch and encoded once a worker, and the ids of all places are gathered in one step.
    Other texts go through ``texts.ChunkCache``. What is known is forgotten when it holds too many characters.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most_chars: int = MOST_KNOWN_CHARS):
        self.encode, self.most_chars = encode, most_chars
        self.rest = texts.ChunkCache(encode, most_chars // 8)
        self.chars, self.known, self.older = 0, {"": b""}, {}

    def forget(self) -> None:
        """Keep what was looked up since the last time; older parts go."""
        self.older = self.known
        self.chars, self.known = 0, {"": b""}

    def of(self, column: pa.Array) -> list[bytes]:
        """For each text of an array without nulls."""
        odd = pc.match_substring_regex(column, texts.SPACES_MEET).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._regular(column)
        out: list[bytes] = [b""] * len(column)
        regular = np.flatnonzero(~odd)
        for place, plain in zip(regular.tolist(), self._regular(column.take(pa.array(regular)))):
            out[place] = plain
        places = np.flatnonzero(odd)
        for place, plain in zip(places.tolist(), self.rest.joined(column.take(pa.array(places)).to_pylist())):
            out[place] = plain
        return out

    def _regular(self, column: pa.Array) -> list[bytes]:
        if not len(column):
            return []
        if self.chars > self.most_chars // 2:
            self.forget()
        cut = pc.replace_substring_regex(column, rf"(\pL)([{MARKS}])([ \n]|$)", f"\\1{CUT}\\2\\3")
        cut = pc.replace_substring(pc.replace_substring(cut, " ", f"{CUT} "), "\n", f"{CUT}\n{CUT}")
        split = pc.split_pattern(cut, CUT)
        offsets = split.offsets.to_numpy().astype(np.int64)
        parts = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        values = self._values(parts.dictionary.to_pylist())
        code = parts.indices.to_numpy()
        flat = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        starts = np.cumsum(sizes) - sizes
        size = sizes[code]
        ends = np.cumsum(size)
        ids = flat[np.repeat(starts[code] - (ends - size), size) + np.arange(int(ends[-1]))]
        cuts = np.concatenate([[0], ends])[offsets - offsets[0]].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _values(self, parts: list[str]) -> list[bytes]:
        known = self.known
        missing = [part for part in parts if part not in known]
        known.update((part, self.older[part]) for part in missing if part in self.older)
        fresh = [part for part in missing if part not in known]
        known.update(zip(fresh, self.encode(fresh)))
        self.chars += sum(map(len, missing))
        return list(map(known.__getitem__, parts))


def chunk_encoder(tokenizer) -> Callable[[list[str]], list[bytes]]:
    """A function from chunks to the id bytes of each, for a byte-level tokenizer."""
    pieces_of, blank = tokenizer.model.tokenize, VISIBLE_BYTES[32]

    def word(text: str) -> bytes:
        """A word of letters, with or without a blank before, which the pattern never cuts: the merges alone."""
        visible = text.replace(" ", blank) if text.isascii() else text.encode().decode("latin-1").translate(VISIBLE_BYTES)
        return array("I", [piece.id for piece in pieces_of(visible)]).tobytes()

    def ids(parts: list[str]) -> list[bytes]:
        """Letters and a mark after them are never one token, so they are encoded apart and put together."""
        found: list[bytes | None] = []
        rest: list[str] = []
        for part in parts:
            if part.isalpha() or part[0] == " " and part[1:].isalpha():
                found.append(word(part))
                continue
            body = part[:-1]
            if part[-1] in marks and (body.isalpha() or body[:1] == " " and body[1:].isalpha()):
                found.append(word(body) + marks[part[-1]])
                continue
            rest.append(part)
            found.append(None)
        others = iter(plain_ids(tokenizer, rest))
        return [next(others) if plain is None else plain for plain in found]

    marks = dict(zip(MARKS, plain_ids(tokenizer, list(MARKS))))
    return ids


def plain_ids(tokenizer, parts: list[str]) -> list[bytes]:
    encoded = tokenizer.encode_batch_fast(parts, add_special_tokens=False) if parts else []
    return [array("I", e.ids).tobytes() for e in encoded]


def encoder(definition: str, end_id: int) -> Callable[[pa.Array], list[bytes]]:
    """A function from an array of texts to the id bytes of each, with the end id; a null is empty."""
    tokenizer, cut = open_tokenizer(definition)
    end = struct.pack("<I", end_id)
    of = WordIds(chunk_encoder(tokenizer)).of if cut else lambda column: plain_ids(tokenizer, column.to_pylist())
    return lambda column: [plain + end for plain in of(pc.fill_null(column.cast(pa.large_string()), ""))]


def _worker_encoder(definition: str, end_id: int) -> Callable[[pa.Array], list[bytes]]:
    """The encoder of this worker, kept from task to task: the latest one only."""
    held = tables.worker_cache()
    if held.get("encoder", (None,))[0] != (definition, end_id):
        held["encoder"] = (definition, end_id), encoder(definition, end_id)
    return held["encoder"][1]


def write(
    df: DataFrame, path: str, definition: str, end_id: int, id_column: str = "doc_id", text_column: str = "text",
    shards: int | None = None, level: int = LEVEL,
) -> DataFrame:
    """Encode all texts and write them as shards below ``path``, in ascending order of ids over all shards.

    ``definition`` is the JSON of a tokenizer. A shard holds about SHARD_BYTES of text unless ``shards`` is given; a word is
    encoded once in a worker. Returns (shard, file, n_docs, n_tokens, start), a written table: ``start`` is the number of ids
    in all shards before. A null text is empty, a null id comes first, rows of one id stand together in the order of a hash
    of their texts, in as many shards as they need. Other columns are left out. A shard appears in one rename, so a task
    that is run again leaves the same files.
    """
    spark = df.sparkSession
    shared = tables.share(spark, definition)  # a vocabulary file: does not grow with the data
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    if shards is None:
        shards = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES
    file_system, folder = fs.FileSystem.from_uri(path)
    file_system.create_dir(folder, recursive=True)

    def shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (batch.drop_columns(["hash"]) for batch in batches)
        number = TaskContext.get().partitionId()
        target, folder = fs.FileSystem.from_uri(path)
        name = f"{folder}/shard-{number:06d}.ids.zst"
        draft = f"{folder}/_draft-{number:06d}-{uuid.uuid4().hex}"
        encode = _worker_encoder(shared(), end_id)
        n_tokens = 0
        with target.open_output_stream(draft) as out:
            writer = ShardWriter(out, level)
            for batch in texts.in_pieces(batches, "text", PIECE_BYTES):
                plains = encode(batch.column("text"))
                for doc_id, plain in zip(batch.column("id").to_pylist(), plains):
                    writer.add(doc_id, plain)
                    n_tokens += len(plain) // 4
            writer.finish()
        target.move(draft, name)
        yield pa.RecordBatch.from_pydict(
            {"shard": [number], "file": [name], "n_docs": [len(writer.ids)], "n_tokens": [n_tokens]}
        )

    written = (
        rows.withColumn("hash", F.xxhash64("text"))
        .repartitionByRange(shards, "id", "hash")
        .sortWithinPartitions("id", "hash", "text")
        .mapInArrow(shard, "shard long, file string, n_docs long, n_tokens long")
    )
    listed = tables.keep(written, "token-shards")  # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(spark: SparkSession, shards: DataFrame, path: str, only: list[int] | None = None) -> DataFrame:
    """Documents of the shards that ``write`` listed: doc_id, start, n_tokens, ids (binary).

    ``only``: decompress just the documents with these ids.
    """
    wanted = None if only is None else sorted(only)

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with target.open_input_file(file) as source:
                    reader = ShardReader(source)
                    starts = base + np.concatenate([[0], np.cumsum(reader.counts, dtype=np.int64)])
                    places = range(len(reader)) if wanted is None else [p for i in wanted for p in reader.places(i)]
                    held: list[tuple] = []
                    size = 0
                    for place in places:
                        plain = reader.plain(place)
                        held.append((reader.doc_id(place), int(starts[place]), len(plain) // 4, plain))
                        size += len(plain)
                        if size > PIECE_BYTES:
                            yield _batch(held)
                            held, size = [], 0
                    if held:
                        yield _batch(held)

    schema = "doc_id long, start long, n_tokens long, ids binary"
    # One file to a task: the list has one row per shard, dealt round.
    return shards.select("file", "start").repartition(max(1, shards.count())).mapInArrow(documents, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, starts, counts, plains = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(plains, pa.binary())],
        names=["doc_id", "start", "n_tokens", "ids"],
    )
