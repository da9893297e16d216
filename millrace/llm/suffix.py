"""Removal of long repeated byte strings, by prefix doubling over the positions of all texts.

The name of a position stands for the bytes from there on. Names of 8 bytes are the bytes themselves; names of twice the
length are made from a pair of names, that of the position and that of the position an offset later: 8, 16 and 32 bytes,
and then 64 and 100. Rows are only made for positions that can still be equal to others:

1. Every window of LENGTH bytes has a lowest 32-byte name, its mark. Neighbouring windows with one mark are a run, which
   is a single row: its mark and the name of all its bytes. Runs are sorted by mark. A run whose mark stands nowhere else
   is unique, and so are all its windows: most rows end here. A run that is equal to an earlier one is removed as a whole.
2. Runs that share a mark but not all their bytes are ranked again, window by window, by the names of LENGTH bytes.
   The first place of each name stays.

A task drops what repeats within it before anything is shuffled, so a string that half of all texts hold comes as one row
from each task. Marks with very many different runs are ranked window by window across tasks instead of in one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import tables, texts

LENGTH = 100
MARK = 32
PIECE_BYTES = 2 << 20
# Marks with more runs than this are ranked across tasks: within one map task, and over all.
CROWD_IN_TASK = 16
CROWD = 1000
TASK_RUNS = 600_000

_COUNT_BITS = 8
# Stands for a null id, which comes before all others.
_NO_ID = -(1 << 63)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIXER = np.uint64(0xD6E8FEB86659FD93)


# -- names ----------------------------------------------------------------------------------------------------


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name that a pair of names has."""
    name = left * _MULTIPLIER
    name += right
    name ^= name >> np.uint64(32)
    name *= _MIXER
    name ^= name >> np.uint64(29)
    name *= _MULTIPLIER
    name ^= name >> np.uint64(32)
    return name


def names_of_8(data: np.ndarray) -> np.ndarray:
    """For each position the next 8 bytes as a number; zeros follow the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    names = np.empty(len(data), np.uint64)
    for shift in range(min(8, len(data))):
        part = names[shift::8]
        part[:] = np.frombuffer(padded[shift : shift + 8 * len(part)].tobytes(), "<u8")
    return names


def doubled(names: np.ndarray, offset: int) -> np.ndarray:
    return pair(names[:-offset], names[offset:]) if len(names) > offset else names[:0]


def names_of_mark(data: np.ndarray) -> np.ndarray:
    return doubled(doubled(names_of_8(data), 8), 16)


def names_of_window(names: np.ndarray, length: int) -> np.ndarray:
    """Names of ``length`` bytes from those of MARK bytes, 64 at most doubling the next offset."""
    known = MARK
    while known < length:
        offset = min(known, length - known)
        names, known = doubled(names, offset), known + offset
    return names


def lowest(names: np.ndarray, count: int) -> np.ndarray:
    """The lowest of each ``count`` neighbouring names."""
    known = 1
    while known < count:
        offset = min(known, count - known)
        if len(names) <= offset:
            return names[:0]
        names, known = np.minimum(names[:-offset], names[offset:]), known + offset
    return names


# -- places ---------------------------------------------------------------------------------------------------


def pack(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """First window and number of windows in one number that sorts like them."""
    return (start << _COUNT_BITS) | count


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> _COUNT_BITS, place & ((1 << _COUNT_BITS) - 1)


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one mark at one place: text, first window within the text, number of windows, mark, name of all bytes."""
    grams = names_of_mark(data)
    marks = lowest(grams, length - MARK + 1)
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(marks)]
    at = np.arange(len(marks))
    whole = at + length <= offsets[1:][text]
    if not len(marks):
        return (at, at, at, marks, marks)
    begins = np.ones(len(marks), bool)
    begins[1:] = (marks[1:] != marks[:-1]) | (whole[1:] != whole[:-1]) | (text[1:] != text[:-1])
    # Also where a window begins with its mark and the next one holds another copy of it, as in short periods: windows of
    # one run hold their mark at different places, so no two of them are equal.
    begins[1:] |= grams[: len(marks) - 1] == marks[:-1]
    firsts = np.flatnonzero(begins)
    counts = np.diff(np.append(firsts, len(marks)))
    kept = whole[firsts]
    firsts, counts = firsts[kept], counts[kept]
    view = memoryview(np.ascontiguousarray(data))
    name = xxhash.xxh3_64_intdigest
    named = [name(view[first : first + count + length - 1]) for first, count in zip(firsts.tolist(), counts.tolist())]
    return text[firsts], firsts - offsets[text[firsts]], counts, marks[firsts], np.array(named, np.uint64)


_RUN = "mark long, name long, id long, tag long, place long, kind int"
_GONE, _RANK, _CROWD = 0, 1, 2


def _frame(columns: dict[str, np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[name]) for name in names], names=names)


def find_runs(documents: DataFrame, length: int) -> DataFrame:
    """Runs of all texts: first ones of a task to be ranked, further ones of a task as gone, by ``kind``."""

    def close(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, tags, places, marks, names = (np.concatenate(part) for part in zip(*held))
        order = np.lexsort((places, tags, ids, names, marks))
        ids, tags, places, marks, names = ids[order], tags[order], places[order], marks[order], names[order]
        fresh = np.ones(len(ids), bool)  # a row that comes twice is one text
        fresh[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (places[1:] != places[:-1]) | (marks[1:] != marks[:-1])
        ids, tags, places, marks, names = ids[fresh], tags[fresh], places[fresh], marks[fresh], names[fresh]
        new_mark = np.concatenate([[True], marks[1:] != marks[:-1]])
        new_name = new_mark | np.concatenate([[True], names[1:] != names[:-1]])
        group = np.cumsum(new_mark) - 1
        different = np.bincount(group, weights=new_name)
        kind = np.where(new_name, _RANK, _GONE)
        # A few runs of a crowded mark tell the other tasks that it is there; the rest are ranked by window at once.
        crowded = new_name & (different[group] > CROWD_IN_TASK)
        nth = np.cumsum(new_name) - np.cumsum(new_name)[np.flatnonzero(new_mark)][group]
        kind[crowded & (nth >= CROWD_IN_TASK)] = _CROWD
        gone = kind == _GONE
        columns = {
            "mark": np.where(gone, 0, marks.view(np.int64)), "name": np.where(gone, 0, names.view(np.int64)), "id": ids,
            "tag": tags, "place": places, "kind": kind.astype(np.int32),
        }
        # Rows of one text follow each other, so its id and tag are compressed.
        kept = np.lexsort((places, tags, ids))
        kept = kept[~gone[kept]]
        yield _frame({name: column[kept] for name, column in columns.items()}, list(columns))
        yield _frame(_joined(ids[gone], tags[gone], places[gone]), list(columns))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in texts.in_pieces(batches, "text", PIECE_BYTES):
            text, starts, counts, marks, names = runs(*texts.utf8(batch.column("text")), length)
            if not len(text):
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)[text]
            tags = batch.column("tag").to_numpy(zero_copy_only=False)[text]
            held.append((ids, tags, pack(starts, counts), marks, names))
            size += len(text)
            if size > TASK_RUNS:
                yield from close(held)
                held, size = [], 0
        if held:
            yield from close(held)

    return documents.mapInArrow(each, _RUN)


def _joined(ids: np.ndarray, tags: np.ndarray, places: np.ndarray) -> dict[str, np.ndarray]:
    """Removed runs that follow each other in a text as fewer rows: ``mark`` is the end of the last window."""
    order = np.lexsort((places, tags, ids))
    ids, tags = ids[order], tags[order]
    starts, counts = unpack(places[order])
    ends = starts + counts
    begins = np.ones(len(ids), bool)
    begins[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (starts[1:] != ends[:-1])
    firsts = np.flatnonzero(begins)
    lasts = np.append(firsts[1:], len(ids)) - 1
    zero = np.zeros(len(firsts), np.int64)
    return {
        "mark": ends[lasts] if len(firsts) else zero, "name": zero, "id": ids[firsts],
        "tag": tags[firsts], "place": pack(starts[firsts], zero), "kind": np.full(len(firsts), _GONE, np.int32),
    }


class _RankRuns:
    """Rows sorted by mark, name and place, in batches: earlier equals stay, later ones are gone, and runs of a mark that
    differ are to be ranked window by window."""

    def __init__(self):
        self.held: pa.Table | None = None  # the first run of the last mark, not known to have company yet
        self.mark = self.name = None
        self.text: tuple | None = None  # id, tag and place of the last row
        self.company = False

    def __call__(self, batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        passed = columns["kind"] != _RANK
        out = []
        if passed.any():
            out.append(_frame({name: column[passed] for name, column in columns.items()}, list(columns)))
            columns = {name: column[~passed] for name, column in columns.items()}
        count = len(columns["mark"])
        if not count:
            return out
        marks, names = columns["mark"], columns["name"]
        old = self.mark is not None and marks[0] == self.mark
        new_mark = np.concatenate([[not old], marks[1:] != marks[:-1]])
        new_name = new_mark | np.concatenate([[not (old and names[0] == self.name)], names[1:] != names[:-1]])
        # A row that comes twice, from other tasks, is one text: its copy does not stand earlier.
        fresh = new_name.copy()
        for column, last_ in zip((columns["id"], columns["tag"], columns["place"]), self.text or (None, None, None)):
            fresh[1:] |= column[1:] != column[:-1]
            fresh[0] |= column[0] != last_
        group = np.cumsum(new_mark) - (0 if old else 1)
        different = np.bincount(group, weights=new_name)
        if old:
            different[0] += 2 if self.company else 1
        company = different[group] > 1
        gone = fresh & ~new_name
        if gone.any():
            out.append(_frame(_joined(*(columns[name][gone] for name in ("id", "tag", "place"))), list(columns)))
        ranked = new_name & company
        if old and not self.company and different[0] > 1 and self.held is not None:
            out.append(self.held)
            self.held = None
        out.append(_frame({name: column[ranked] for name, column in columns.items()}, list(columns)))
        last = group[-1]
        if different[last] > 1:
            self.held, self.company = None, True
        else:
            if not (old and last == 0):
                first = np.flatnonzero(group == last)[:1]
                self.held = _frame({name: column[first] for name, column in columns.items()}, list(columns))
            self.company = False
        self.mark, self.name = marks[-1], names[-1]
        self.text = columns["id"][-1], columns["tag"][-1], columns["place"][-1]
        return out


def rank_runs(found: DataFrame) -> DataFrame:
    """Sort runs by their marks: gone ones, and those to be ranked by window."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = _RankRuns()
        for batch in batches:
            yield from rank(batch)

    # What is settled already is spread by its text.
    key = F.when(F.col("kind") == _RANK, F.col("mark")).otherwise(F.xxhash64("id", "tag", "place"))
    dealt = found.repartition(tables.shuffle_partitions(found.sparkSession), key).sortWithinPartitions(
        "mark", "name", "id", "tag", "place"
    )
    return dealt.mapInArrow(each, _RUN)


# -- windows --------------------------------------------------------------------------------------------------

_OPENED = "mark long, id long, tag long, start long, run binary"
_SPAN = "id long, tag long, first long, last long"


def open_runs(documents: DataFrame, ranked: DataFrame, length: int) -> DataFrame:
    """The bytes of runs to be ranked by window; those of crowded marks as single windows, under marks of their own."""
    crowded = ranked.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("most"))
    crowded = crowded.filter((F.col("n") > CROWD) | (F.col("most") == _CROWD)).select("mark", F.lit(True).alias("crowded"))
    entry = F.struct("place", "mark", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    listed = ranked.join(crowded, "mark", "left").select("id", "tag", entry.alias("entry"))
    of_text = listed.groupBy("id", "tag").agg(F.collect_set("entry").alias("runs"))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earliest: dict[bytes, tuple] = {}
        for batch in texts.in_pieces(batches, "text", PIECE_BYTES):
            data, offsets = texts.utf8(batch.column("text"))
            view = data.tobytes()
            lists = batch.column("runs")
            entries = lists.flatten()
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(lists.offsets.to_numpy()))
            ids, tags = (batch.column(name).to_numpy(zero_copy_only=False)[text].tolist() for name in ("id", "tag"))
            places, marks, alone = (entries.field(name).to_numpy(zero_copy_only=False) for name in ("place", "mark", "crowded"))
            starts, counts = unpack(places)
            rows: list[tuple] = []
            columns = (ids, tags, offsets[text].tolist(), marks.tolist(), alone.tolist(), starts.tolist(), counts.tolist())
            for id_, tag_, base, mark, crowd, start, count in zip(*columns):
                if not crowd:
                    rows.append((mark, id_, tag_, start, view[base + start : base + start + count + length - 1]))
                    continue
                for at in range(start, start + count):
                    window = view[base + at : base + at + length]
                    key, here = xxhash.xxh3_128_digest(window), (id_, tag_, at)
                    # What stands earlier in this task is enough to know that this one goes: it needs no bytes.
                    late = earliest.get(key, here) < here
                    if not late:
                        earliest[key] = here
                    own = int.from_bytes(key[:8], "little", signed=True)
                    rows.append((own, *here, b"" if late else window))
            if rows:
                mark, id_, tag_, start, run = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(column, pa.int64()) for column in (mark, id_, tag_, start)), pa.array(run, pa.binary())],
                    names=["mark", "id", "tag", "start", "run"],
                )

    joined = documents.join(of_text, ["id", "tag"]).dropDuplicates(["id", "tag"]).select("id", "tag", "text", "runs")
    return joined.mapInArrow(each, _OPENED)


def _later_windows(rows: pa.Table, length: int) -> dict[str, np.ndarray]:
    """Of runs sorted by mark and place, whole marks together: the windows that stand earlier under the same mark."""
    marks, ids, tags, starts = (rows[name].to_numpy() for name in ("mark", "id", "tag", "start"))
    runs_ = rows["run"].combine_chunks().cast(pa.large_binary())
    _, offset_buffer, data_buffer = runs_.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[runs_.offset : runs_.offset + len(runs_) + 1]
    data = np.frombuffer(data_buffer, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    names = names_of_window(names_of_mark(data), length)
    row = np.repeat(np.arange(len(ids)), np.diff(offsets))[: len(names)]
    at = np.arange(len(names))
    whole = at + length <= offsets[1:][row]
    row, at, names = row[whole], at[whole], names[whole]
    order = np.lexsort((names, marks[row]))  # stable: equal windows stay in order of their places
    row, at, names = row[order], at[order], names[order]
    mark = marks[row]
    later = np.zeros(len(row), bool)
    later[1:] = (names[1:] == names[:-1]) & (mark[1:] == mark[:-1])
    row, at = row[later], at[later]
    first = starts[row] + at - offsets[row]
    return {"id": ids[row], "tag": tags[row], "first": first, "last": first}


def _spans(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Neighbouring windows of a text as spans: first and last window."""
    order = np.lexsort((columns["first"], columns["tag"], columns["id"]))
    ids, tags, firsts, lasts = (columns[name][order] for name in ("id", "tag", "first", "last"))
    begins = np.ones(len(ids), bool)
    begins[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (firsts[1:] > lasts[:-1] + 1)
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], len(ids)) - 1
    return _frame(
        {"id": ids[at], "tag": tags[at], "first": firsts[at], "last": lasts[ends] if len(at) else firsts},
        ["id", "tag", "first", "last"],
    )


def rank_windows(opened: DataFrame, length: int) -> DataFrame:
    """Spans of windows that stand earlier: sorted by mark and place, ranked within whole marks."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            gone = pa.compute.equal(pa.compute.binary_length(rows["run"]), 0).to_numpy()
            ids, tags, starts = (rows[name].to_numpy()[gone] for name in ("id", "tag", "start"))
            yield _spans({"id": ids, "tag": tags, "first": starts, "last": starts})
            yield _spans(_later_windows(rows, length))

        for batch in texts.in_pieces(batches, "run", PIECE_BYTES):
            held.append(batch)
            size += batch.nbytes
            last = batch.column("mark")[-1].as_py()
            if size < 2 * PIECE_BYTES or held[0].column("mark")[0].as_py() == last:
                continue
            rows = pa.Table.from_batches(held)
            whole = int(np.searchsorted(rows["mark"].to_numpy(), last))  # the last mark may go on
            yield from settle(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
            size = sum(part.nbytes for part in held)
        if held:
            yield from settle(pa.Table.from_batches(held))

    dealt = opened.repartition(tables.shuffle_partitions(opened.sparkSession), "mark")
    return dealt.sortWithinPartitions("mark", "id", "tag", "start").mapInArrow(each, _SPAN)


# -- removal --------------------------------------------------------------------------------------------------


def remove_repeats(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH
) -> DataFrame:
    """Of every text: its id, ``n_bytes``, ``spans`` (removed runs of bytes: start and end) and ``kept`` (binary).

    A byte goes if a string of ``length`` bytes over it stands earlier too: in a row with a smaller id, or earlier in the
    same text. Strings are judged on the texts as given and never cross texts. A null text is empty; texts shorter than
    ``length`` stay. A null id comes before all others. Rows equal in id and text are one text, returned as often as they
    come; unequal texts with one id go by their hash, of 64 bits. Other columns are left out.
    """
    if not MARK + 1 <= length <= 100:
        raise ValueError(f"length must be {MARK + 1} to 100")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    documents = df.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("id"),
        F.xxhash64(text).alias("tag"), text.alias("text"),
    )
    ranked = tables.keep(rank_runs(find_runs(documents, length)), "suffix-runs")
    start = F.shiftright("place", _COUNT_BITS)
    gone = ranked.filter(F.col("kind") == _GONE).select("id", "tag", start.alias("first"), (F.col("mark") - 1).alias("last"))
    later = rank_windows(open_runs(documents, ranked.filter(F.col("kind") != _GONE), length), length)
    spans = gone.unionByName(later).groupBy("id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("windows"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.in_pieces(batches, "text", PIECE_BYTES):
            removed, kept = [], []
            for plain, windows in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("windows").to_pylist()):
                found: list[list[int]] = []
                for first, end in sorted((w["first"], w["last"] + length) for w in windows or ()):
                    if found and first <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], end)
                    else:
                        found.append([first, end])
                bounds = [0, *(at for span in found for at in span), len(plain)]
                removed.append([{"start": first, "end": end} for first, end in found])
                kept.append(b"".join(plain[first:end] for first, end in zip(bounds[::2], bounds[1::2])))
            sizes = pa.array(np.diff(texts.utf8(batch.column("text"))[1]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), sizes, pa.array(removed, span), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "spans", "kept"],
            )

    schema = "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    cleaned = documents.join(spans, ["id", "tag"], "left").select("id", "text", "windows").mapInArrow(cut, schema)
    return cleaned.select(F.nullif("id", F.lit(_NO_ID)).alias(id_column), "n_bytes", "spans", "kept")
