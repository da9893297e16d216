"""What five document filters do in every order, from one pass of packed counters.

A document fails some of the filters A to E: a mask of five bits. What an order of the filters does to it follows from the
mask alone, so for each mask (and whether the document is labelled good or toxic) one big integer holds a field for every
outcome at each of the 600 steps of the 120 orders. Adding up these integers counts all outcomes of all orders at once. A
field has FIELD_BYTES bytes; a sum over fewer than 2 ** 48 documents cannot run over into the next one.

Tasks add up their own documents by part, the sums are merged in groups of tasks and then by part, and the fields are
unpacked at the end. No group of documents is ever gathered: copies are found by the smallest id of each text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import tables, texts

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT = 80
MOST_CAPITALS = 10
SYMBOLS = b"#$%&*|"

ORDERS = ["".join(order) for order in permutations(FILTERS)]
COPY_BIT = 1 << FILTERS.index("E")
OUTCOMES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
FIELD_BYTES = 6
FIELDS = len(ORDERS) * len(FILTERS) * len(OUTCOMES) + len(FILTERS)
MOST_ROWS = 1 << (8 * FIELD_BYTES)

# Parts whose sums a task holds at a time (18 KB each), and groups that the sums of one part are merged in.
HELD_PARTS = 512
MERGE_GROUPS = 64
PIECE_BYTES = 8 << 20

# -- the filters ----------------------------------------------------------------------------------------------


def _per_text(offsets: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Sums of a per-byte array over each text."""
    ends = np.concatenate([[0], np.cumsum(counted, dtype=np.int64)])
    return ends[offsets[1:]] - ends[offsets[:-1]]


def _word_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and of distinct words of every text."""
    split = pc.ascii_split_whitespace(column)
    offsets = split.offsets.to_numpy().astype(np.int64)
    words = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    row = np.repeat(np.arange(len(column), dtype=np.int64), np.diff(offsets))
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[real]
    row = row[real]
    distinct = np.unique(row * (int(codes.max(initial=0)) + 1) + codes) // (int(codes.max(initial=0)) + 1)
    return np.bincount(row, minlength=len(column)), np.bincount(distinct, minlength=len(column))


def failed_alone(column: pa.Array) -> np.ndarray:
    """Bits of the filters that look at one text: A to D."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    data, offsets = texts.utf8(column)
    words, distinct = _word_numbers(column)
    points = _per_text(offsets, (data & 0xC0) != 0x80)
    capitals = _per_text(offsets, (data >= 65) & (data <= 90))
    symbols = _per_text(offsets, np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))
    failures = (
        words < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT * words,
        100 * capitals > MOST_CAPITALS * points,
        symbols > 0,
    )
    return sum(failed.astype(np.int64) << bit for bit, failed in enumerate(failures))


def judged(documents: DataFrame, id_column: str, text_column: str, part_column: str) -> DataFrame:
    """(id, part, mask, digest) of every document: bits A to D and the SHA-256 of its text. Written, as it is read twice."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    source = documents.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.in_pieces(batches, "text", PIECE_BYTES):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), pa.array(failed_alone(batch.column("text")), pa.int32()), batch.column("digest")],
                names=["id", "part", "mask", "digest"],
            )

    return tables.keep(source.mapInArrow(each, "id long, part string, mask int, digest binary"), "judged")


def with_copies(rows: DataFrame) -> DataFrame:
    """The rows with bit E where a smaller id has the same text.

    The smallest id of every text is combined before the shuffle. Rows are joined with it by text and id together, so the
    copies of one text are spread by their ids; a row that finds itself is the first of its text. A row without id is
    no copy.
    """
    firsts = rows.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    with_id = rows.filter("id IS NOT NULL").join(firsts, ["digest", "id"], "left")
    mask = F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(COPY_BIT)))
    return with_id.withColumn("mask", mask).select("id", "part", "mask").unionByName(
        rows.filter("id IS NULL").select("id", "part", "mask")
    )


def with_labels(rows: DataFrame, labels: DataFrame, id_column: str) -> DataFrame:
    """(part, mask, good, toxic); a document with several labels is good or toxic if one of them says so."""

    def says(name: str):
        return F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias("good" if name == "quality" else name)

    known = labels.select(F.col(id_column).cast("long").alias("id"), "quality", "toxic").filter("id IS NOT NULL")
    known = known.groupBy("id").agg(says("quality"), says("toxic"))
    joined = rows.filter("id IS NOT NULL").join(known, "id", "left")
    flags = [F.coalesce(F.col(name), F.lit(False)).alias(name) for name in ("good", "toxic")]
    bare = rows.filter("id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return joined.select("part", "mask", *flags).unionByName(bare)


# -- packed counters ------------------------------------------------------------------------------------------


def field(order: int, step: int, outcome: str) -> int:
    """Number of a field; steps count from 0."""
    return (order * len(FILTERS) + step) * len(OUTCOMES) + OUTCOMES.index(outcome)


def wide(mask: int, good: bool, toxic: bool) -> int:
    """The integer of a document: 1 in the field of everything that happens to it."""
    packed = bytearray(FIELDS * FIELD_BYTES)

    def count(number: int) -> None:
        packed[number * FIELD_BYTES] = 1

    for order, letters in enumerate(ORDERS):
        gone = False
        for step, letter in enumerate(letters):
            fails = mask >> FILTERS.index(letter) & 1
            if fails and gone:
                count(field(order, step, "redundant"))
            elif fails:
                gone = True
                count(field(order, step, "removed"))
                if good:
                    count(field(order, step, "good_lost"))
                if toxic:
                    count(field(order, step, "toxic_lost"))
            if not gone:
                count(field(order, step, "kept"))
    for bit in range(len(FILTERS)):
        if mask == 1 << bit:
            count(FIELDS - len(FILTERS) + bit)
    return int.from_bytes(packed, "little")


def _wide_integers() -> list[int]:
    """By 4 * mask + 2 * good + toxic."""
    return [wide(key >> 2, bool(key & 2), bool(key & 1)) for key in range(4 << len(FILTERS))]


def _content(sum_: int) -> bytes:
    return sum_.to_bytes(FIELDS * FIELD_BYTES, "little")


def unpacked(content: bytes) -> np.ndarray:
    """The fields of a sum."""
    fields = np.zeros((FIELDS, 8), np.uint8)
    fields[:, :FIELD_BYTES] = np.frombuffer(content, np.uint8).reshape(FIELDS, FIELD_BYTES)
    return fields.view("<u8").ravel().astype(np.int64)


_SUMS = "part string, merge_group int, n long, content binary"


def _batch(held: dict[str, tuple[int, int]], group: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(held), pa.string()),
            pa.array([group] * len(held), pa.int32()),
            pa.array([n for n, _ in held.values()], pa.int64()),
            pa.array([_content(sum_) for _, sum_ in held.values()], pa.binary()),
        ],
        names=["part", "merge_group", "n", "content"],
    )


def wide_sums(rows: DataFrame) -> DataFrame:
    """(part, merge_group, n, content): the integers of the documents of a task, added up by part."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_key = _wide_integers()
        group = TaskContext.get().partitionId() % MERGE_GROUPS
        held: dict[str, tuple[int, int]] = {}
        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            names = parts.dictionary.to_pylist()
            key = 4 * batch.column("mask").to_numpy().astype(np.int64)
            key += 2 * batch.column("good").to_numpy(zero_copy_only=False) + batch.column("toxic").to_numpy(zero_copy_only=False)
            both, counts = np.unique(parts.indices.to_numpy() * len(of_key) + key, return_counts=True)
            for place, n in zip(both.tolist(), counts.tolist()):
                name = names[place // len(of_key)]
                if name not in held and len(held) >= HELD_PARTS:
                    yield _batch(held, group)
                    held = {}
                before, sum_ = held.get(name, (0, 0))
                held[name] = before + n, sum_ + n * of_key[place % len(of_key)]
        if held:
            yield _batch(held, group)

    return rows.select("part", "mask", "good", "toxic").mapInArrow(add, _SUMS)


def _merged(sums: DataFrame, *keys: str) -> DataFrame:
    """Sums added up by these columns; rows of one part stand together, so a task holds one sum at a time."""

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, sum_ = None, 0, 0
        for batch in batches:
            for part, rows, content in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "content"))):
                if part != name:
                    if name is not None:
                        yield _batch({name: (n, sum_)}, 0)
                    name, n, sum_ = part, 0, 0
                n += rows
                if n >= MOST_ROWS:
                    raise OverflowError(f"more documents than a field of {FIELD_BYTES} bytes can count")
                sum_ += int.from_bytes(content, "little")
        if name is not None:
            yield _batch({name: (n, sum_)}, 0)

    return sums.repartition(*keys).sortWithinPartitions("part").mapInArrow(merge, _SUMS)


RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
    "toxic_lost long, shapley long"
)


def unpack(sums: DataFrame) -> DataFrame:
    """600 rows for each part."""
    steps = len(FILTERS)
    letters = [FILTERS.index(letter) for order in ORDERS for letter in order]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content").to_pylist()):
                fields = unpacked(content)
                outcomes = fields[: -len(FILTERS)].reshape(len(ORDERS) * steps, len(OUTCOMES))
                count = dict(zip(OUTCOMES, outcomes.T))
                shapley = np.zeros(len(FILTERS), np.int64)
                np.add.at(shapley, letters, count["removed"])
                columns = {
                    "part": pa.array([part] * len(outcomes), pa.string()),
                    "filter_order": pa.array([order for order in ORDERS for _ in FILTERS]),
                    "step": pa.array(np.tile(np.arange(1, steps + 1), len(ORDERS)), pa.int32()),
                    "kept": pa.array(count["kept"]),
                    "removed": pa.array(count["removed"]),
                    "redundant": pa.array(count["redundant"]),
                    "unique_fails": pa.array(fields[-len(FILTERS) :][letters]),
                    "good_lost": pa.array(count["good_lost"]),
                    "toxic_lost": pa.array(count["toxic_lost"]),
                    "shapley": pa.array(shapley[letters]),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return sums.select("part", "content").mapInArrow(each, RESULT)


def audit(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> DataFrame:
    """A row for every part, order and step, zeros included: what is kept, removed there, failing but gone already, failing
    nothing else, lost of good and of toxic documents, and the filter's removals over all orders.

    A part is a value of ``part_column``; null is the empty string. A null text is empty: it has no words, so it fails A
    alone, and E with an empty text of a smaller id. A document without id is no copy and has no labels, though it is counted. Rows that
    share id and text are no copies of each other. Rows of ``labels`` without id say nothing. An empty table has no parts.
    Other columns are left out.
    """
    rows = with_labels(with_copies(judged(documents, id_column, text_column, part_column)), labels, id_column)
    return unpack(_merged(_merged(wide_sums(rows), "part", "merge_group"), "part"))
