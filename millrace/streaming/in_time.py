"""Processors that act on the query's own watermark: lateness, versions in time, matching queues, triggers.

Rows are handled as whole columns, oldest first within a micro-batch; state is read and written once per key and batch, and a
key that waits has one timer. Spark's watermark before a batch is the newest time of all earlier batches less the delay. A row
whose window closed before it has come late; so the columns handed to these processors must not carry the watermark
themselves (Spark drops late rows of such a column before a processor sees them): see ``plain_time``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.late import ON_TIME, REFIRE, TOO_LATE

MATCHED, LEFT_ONLY, RIGHT_ONLY = "matched", "left_only", "right_only"


def plain_time(ts: str) -> Column:
    """A watermarked time in milliseconds, without the mark."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def window_last(ts: str, width: str) -> Column:
    """The last millisecond of the window of a row."""
    return F.unix_millis(F.window(F.col(ts).cast("timestamp"), width)["end"].cast("timestamp")) - 1


def buckets(df: DataFrame, columns: list[str], number: int) -> DataFrame:
    """Rows dealt over ``number`` keys, for processors that need the watermark but no key."""
    return df.withColumn("key", F.pmod(F.xxhash64(*columns), F.lit(number)).cast("string"))


def to_all_buckets(df: DataFrame, number: int) -> DataFrame:
    """Every row once for each key that ``buckets`` deals to: how few control rows reach all data rows."""
    return df.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).withColumn("key", F.col("key").cast("string"))


class Columnar(StatefulProcessor):
    """Handles the rows of a key in a batch as columns, or as one frame sorted by ``order``."""

    order = ["ts", "seq"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        pass

    def frame(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)

    def close(self) -> None:
        pass


class Lists:
    """Some lists in one value state: read and written at once, not entry by entry."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: str, number: int):
        self.state, self.number = handle.getValueState(name, schema), number
        self.there = False

    def read(self) -> tuple[list, ...]:
        value = self.state.get()
        self.there = value is not None
        return value if self.there else tuple([] for _ in range(self.number))

    def write(self, lists: list[list]) -> None:
        """To be called after ``read`` for the same key."""
        if any(lists):
            self.state.update(tuple(lists))
        elif self.there:
            self.state.clear()


def _columns(rows: list[tuple], number: int) -> list[list]:
    return [list(column) for column in zip(*rows)] if rows else [[] for _ in range(number)]


def _status(last: np.ndarray, watermark: int, lateness: int) -> np.ndarray:
    """A window is open while the watermark has not passed its last millisecond, and kept ``lateness`` longer."""
    kept = np.where(last + lateness >= watermark, REFIRE, TOO_LATE)
    return np.where((last >= watermark) | (watermark <= 0), ON_TIME, kept)


class Judge(Columnar):
    """Every row as it came (``columns``), with a status by the watermark before its batch. Run with time mode EventTime.

    Rows carry ``last``, the last millisecond of their window.
    """

    def __init__(self, columns: list[str], lateness: timedelta, name: str = "status"):
        self.columns, self.lateness, self.name = list(columns), lateness // timedelta(milliseconds=1), name

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            status = _status(part["last"].to_numpy(np.int64), watermark, self.lateness)
            yield part[self.columns].assign(**{self.name: status})


class LateWindows(Columnar):
    """Windows that fire at the watermark and fire again for each late row while they are kept.

    Rows are (key, ts, seq, last). Output rows are tagged: ``fire`` when the watermark passes a window with rows in time,
    ``refire`` for every row that comes while its closed window is kept, both with the number of rows so far; ``too_late``
    for a row whose window is gone. ``seq`` names the late row. A window that only late rows reach never fires by itself.
    A timer drops a window ``lateness`` after its end. Late rows of a batch come in ``order``. Run with time mode EventTime.
    """

    SCHEMA = "key string, kind string, last long, n long, seq long"
    COLUMNS = ["last", "n", "fired"]

    def __init__(self, lateness: timedelta, order: tuple[str, ...] = ("ts", "seq")):
        self.lateness, self.order = lateness // timedelta(milliseconds=1), list(order)

    def open(self, handle):
        self.windows = handle.getListState("windows", "last long, n long, fired boolean")

    def read(self) -> dict[int, tuple[int, bool]]:
        return {last: (n, fired) for last, n, fired in self.windows.get()} if self.windows.exists() else {}

    def write(self, known: dict[int, tuple[int, bool]]) -> None:
        if known:
            self.windows.put([(last, n, fired) for last, (n, fired) in sorted(known.items())])
        else:
            self.windows.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        frame, known, out = self.frame(rows), self.read(), []
        last = frame["last"].to_numpy(np.int64)
        status = _status(last, watermark, self.lateness)
        for window, n in zip(*(part.tolist() for part in np.unique(last[status == ON_TIME], return_counts=True))):
            if window not in known:
                self.handle.registerTimer(window + 1)
            before, fired = known.get(window, (0, False))
            known[window] = before + n, fired
        late = frame[status == REFIRE]
        for window, part in late.groupby("last", sort=True):
            window = int(window)
            before, fired = known.get(window, (0, True))
            if not fired:
                out.append(pd.DataFrame({"kind": "fire", "last": [window], "n": before, "seq": None}))
            again = np.arange(before + 1, before + len(part) + 1)
            out.append(pd.DataFrame({"kind": "refire", "last": window, "n": again, "seq": part["seq"].to_numpy()}))
            known[window] = before + len(part), True
            self.handle.registerTimer(window + self.lateness + 1)
        gone = frame[status == TOO_LATE]
        out.append(pd.DataFrame({"kind": TOO_LATE, "last": gone["last"], "n": None, "seq": gone["seq"]}))
        self.write(known)
        yield from self.tagged(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        known, out = self.read(), []
        for window, (n, fired) in sorted(known.items()):
            if window < watermark and not fired:
                out.append(pd.DataFrame({"kind": "fire", "last": [window], "n": n, "seq": None}))
                known[window] = n, True
                self.handle.registerTimer(window + self.lateness + 1)
        self.write({window: held for window, held in known.items() if window + self.lateness >= watermark})
        yield from self.tagged(key, out)

    @staticmethod
    def tagged(key, parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.assign(key=str(key[0]))[["key", "kind", "last", "n", "seq"]].astype({"n": "Int64", "seq": "Int64"})


def _whole(column: pd.Series) -> np.ndarray:
    """Whole numbers; one that is missing is an error."""
    return column.to_numpy() if column.dtype == np.int64 else column.astype("int64").to_numpy()


class Rows:
    """Rows (ts, seq, value) of a key, a column each: two of numbers and one of texts, which may be missing."""

    STATE = "ts binary, seq binary, length binary, text binary"

    def __init__(self, ts: np.ndarray, seq: np.ndarray, value: np.ndarray):
        self.ts, self.seq, self.value = ts, seq, value

    def __len__(self) -> int:
        return len(self.ts)

    def __getitem__(self, places) -> Rows:
        return Rows(self.ts[places], self.seq[places], self.value[places])

    def sorted(self) -> Rows:
        return self[np.lexsort((self.seq, self.ts))]

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        columns = zip(*((part.ts, part.seq, part.value) for part in parts))
        return Rows(*(np.concatenate(column) for column in columns))

    @staticmethod
    def read(ts: bytes, seq: bytes, length: bytes, text: bytes) -> Rows:
        lengths, whole = np.frombuffer(length, np.int32), text.decode()
        value, ends = np.empty(len(lengths), object), np.cumsum(np.maximum(lengths, 0), dtype=np.int64)
        value[:] = [None if n < 0 else whole[end - n : end] for n, end in zip(lengths.tolist(), ends.tolist())]
        return Rows(np.frombuffer(ts, np.int64), np.frombuffer(seq, np.int64), value)

    def written(self) -> tuple[bytes, bytes, bytes, bytes]:
        """The numbers as they are; the lengths of the texts, -1 for none, and the texts one after the other."""
        lengths = np.array([-1 if text is None else len(text) for text in self.value], np.int32)
        text = "".join(text for text in self.value if text is not None)
        return self.ts.tobytes(), self.seq.tobytes(), lengths.tobytes(), text.encode()


class AsOf(Columnar):
    """Data rows with the newest value of their key at or before their time, whatever the batches.

    Rows are (key, ts, seq, is_data, value): the value of a control row, or what a data row carries along (``row``). A data row is held until the watermark passes its time, as only then no earlier
    value can come; the watermark is that of the slower of both feeds. Values are kept while a row can still ask for them.
    At one time values come first, the last by ``seq`` counts. ``per_ms`` is 1000 for times in microseconds. What a key holds
    is packed into a few binary columns, and a task holds the rows of one micro-batch of a key. Run with time mode EventTime.
    """

    SCHEMA = "key string, seq long, value string, row string"
    # Rows that are handed back at a time.
    OUT = 50_000

    def __init__(self, per_ms: int = 1):
        self.per_ms = per_ms

    def open(self, handle):
        columns = Rows.STATE.split(", ")
        self.state = handle.getValueState("versions", ", ".join(f"{part}_{column}" for part in ("marks", "waiting") for column in columns))
        self.answered: dict[tuple, int] = {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: tuple[list, list] = ([], [])
        for part in rows:
            is_data = part["is_data"].to_numpy(bool)
            value = np.array([value if isinstance(value, str) else None for value in part["value"].tolist()], object)
            found = Rows(_whole(part["ts"]), _whole(part["seq"]), value)
            new[0].append(found[~is_data])
            new[1].append(found[is_data])
        yield from self.answer(key, *new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A key with rows in the micro-batch was answered for this watermark already.
        if self.answered.get(key) != timerValues.getCurrentWatermarkInMs():
            yield from self.answer(key, [], [], timerValues)

    def answer(self, key, new_marks: list[Rows], new_rows: list[Rows], timer_values) -> Iterator[pd.DataFrame]:
        watermark = timer_values.getCurrentWatermarkInMs()
        self.answered[key] = watermark
        passed = watermark * self.per_ms
        held = self.state.get() or (b"",) * 8
        marks = Rows.joined([Rows.read(*held[:4]), *new_marks]).sorted()
        # Of the values of one time only the last can be asked for.
        marks = marks[np.append(marks.ts[1:] != marks.ts[:-1], True)[: len(marks)]]
        waiting = Rows.joined([Rows.read(*held[4:]), *new_rows])
        ready = waiting.ts < passed
        rest, due = waiting[~ready], waiting[ready].sorted()
        # The newest value before the watermark and all after it can still be asked for.
        kept = marks[max(0, int(np.searchsorted(marks.ts, passed)) - 1) :]
        if len(kept) or len(rest):
            self.state.update((*kept.written(), *rest.written()))
        elif any(held):
            self.state.clear()
        if len(rest):
            self.handle.registerTimer(int(rest.ts.min()) // self.per_ms + 1)
        del held, waiting, kept, rest
        values = np.append(marks.value, None)  # the last place, -1, is that of no value
        for start in range(0, len(due), self.OUT):
            part = due[start : start + self.OUT]
            value = values[np.searchsorted(marks.ts, part.ts, side="right") - 1]
            name = np.full(len(part), str(key[0]), object)
            yield pd.DataFrame({"key": name, "seq": part.seq, "value": value, "row": part.value}, copy=False)


class MatchInOrder(Columnar):
    """Matching that consumes: the oldest waiting left record of a key meets the oldest waiting right one.

    Rows are (key, ts, seq, is_left). Each record is matched once; what waits is held in two queues. With ``within`` the two
    records of a pair are no further apart, and one that can have no partner any more is given up and reported alone: when
    its turn comes with a record too far from it, or when the watermark is that far past its time (time mode EventTime).
    ``match_no`` counts the pairs of a key from 1 and is null for a record alone.
    """

    SCHEMA = "key string, match_no long, left_seq long, right_seq long, status string"
    COLUMNS = ["key", "match_no", "left_seq", "right_seq", "status"]

    def __init__(self, within: timedelta | None = None):
        self.within = None if within is None else within // timedelta(milliseconds=1)

    def open(self, handle):
        parts = (f"{side}_{column} array<long>" for side in ("left", "right") for column in ("ts", "seq"))
        self.state = Lists(handle, "queues", ", ".join(parts), 4)
        self.count = handle.getValueState("pairs", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: tuple[list, list] = ([], [])
        for part in rows:
            for ts, seq, is_left in zip(*(part[c].tolist() for c in ("ts", "seq", "is_left"))):
                new[not is_left].append((int(ts), int(seq)))
        queues = [[*old, *sorted(part)] for old, part in zip(self.read(), new)]
        paired, alone = self.meet(*(np.array([ts for ts, _ in queue], np.int64) for queue in queues))
        out = []
        for place in (0, 1):
            out += [self.single(key, place, queues[place][i][1]) for i in alone[place]]
        if len(paired[0]):
            pairs = (self.count.get() or (0,))[0]
            self.count.update((pairs + len(paired[0]),))
            for number, (a, b) in enumerate(zip(*paired), pairs + 1):
                out.append((str(key[0]), number, queues[0][a][1], queues[1][b][1], MATCHED))
        self.write([queue[len(paired[place]) + len(alone[place]) :] for place, queue in enumerate(queues)])
        if out:
            yield pd.DataFrame(out, columns=self.COLUMNS, dtype=object)

    def read(self) -> list[list[tuple]]:
        held = self.state.read()
        return [list(zip(*held[:2])), list(zip(*held[2:]))]

    def write(self, queues: list[list[tuple]]) -> None:
        """Hold what waits, with one timer for the first record that can be given up."""
        self.state.write([*_columns(queues[0], 2), *_columns(queues[1], 2)])
        if self.within is not None and any(queues):
            self.handle.registerTimer(min(ts for queue in queues for ts, _ in queue) + self.within + 1)

    def meet(self, left: np.ndarray, right: np.ndarray) -> tuple[tuple, tuple[list[int], list[int]]]:
        """Places in both queues that are paired, and those given up; all of them stand before the rest of their queue."""
        n = min(len(left), len(right))
        if self.within is None or not n or np.abs(left[:n] - right[:n]).max() <= self.within:
            return (np.arange(n), np.arange(n)), ([], [])
        paired: tuple[list[int], list[int]] = ([], [])
        alone: tuple[list[int], list[int]] = ([], [])
        a = b = 0
        while a < len(left) and b < len(right):
            if abs(left[a] - right[b]) <= self.within:
                paired[0].append(a)
                paired[1].append(b)
                a, b = a + 1, b + 1
            elif left[a] < right[b]:
                alone[0].append(a)
                a += 1
            else:
                alone[1].append(b)
                b += 1
        return paired, alone

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = timerValues.getCurrentWatermarkInMs() - self.within  # before it, a record is given up
        queues = self.read()
        out = [self.single(key, place, seq) for place in (0, 1) for ts, seq in queues[place] if ts < last]
        self.write([[(ts, seq) for ts, seq in queue if ts >= last] for queue in queues])
        if out:
            yield pd.DataFrame(out, columns=self.COLUMNS, dtype=object)

    @staticmethod
    def single(key, place: int, seq: int) -> tuple:
        return (str(key[0]), None, *((seq, None, LEFT_ONLY) if place == 0 else (None, seq, RIGHT_ONLY)))


class Trigger(Columnar):
    """An endless window per key that fires by count, by time or by either: firings as ``windows.global_window_count_or_time``.

    Rows are (key, ts, seq). Rows are counted by span until the watermark passes its end; a key holds no more than its open
    spans, two numbers and one timer at the first end. Run with time mode EventTime if ``span`` is given.
    """

    SCHEMA = "key string, cause string, at_ms long, n long"

    def __init__(self, every: int | None = None, span: timedelta | None = None):
        if not every and not span:
            raise ValueError("a window without a trigger never fires")
        self.every, self.span = every, None if span is None else span // timedelta(milliseconds=1)

    def open(self, handle):
        self.state = handle.getValueState("window", "n long, closed long, ends array<long>, rows array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ts = np.sort(np.concatenate([part["ts"].to_numpy(np.int64) for part in rows]))
        before, closed, ends, counts = self.state.get() or (0, 0, [], [])
        known = dict(zip(ends, counts))
        if self.span:
            for end, n in zip(*(part.tolist() for part in np.unique((ts // self.span + 1) * self.span, return_counts=True))):
                known[end] = known.get(end, 0) + n
            first = min(known)
            if not ends or first < ends[0]:
                self.handle.registerTimer(first)
        self.hold_spans(before + len(ts), closed, sorted(known.items()))
        if self.every:
            numbers = np.arange(before + 1, before + len(ts) + 1)
            fires = numbers % self.every == 0
            if fires.any():
                yield self.firings(key, "count", ts[fires], numbers[fires])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        count, closed, ends, counts = self.state.get() or (0, 0, [], [])
        due = bisect_right(ends, watermark)
        if ends[due:]:
            self.handle.registerTimer(ends[due])
        if not due:
            return
        totals = closed + np.cumsum(counts[:due])
        self.hold_spans(count, int(totals[-1]), list(zip(ends[due:], counts[due:])))
        yield self.firings(key, "time", ends[:due], totals)

    def hold_spans(self, count: int, closed: int, spans: list[tuple]) -> None:
        self.state.update((count, closed, *_columns(spans, 2)))

    @staticmethod
    def firings(key, cause: str, at, n) -> pd.DataFrame:
        return pd.DataFrame({"key": str(key[0]), "cause": cause, "at_ms": at, "n": n})
