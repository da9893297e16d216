"""Stateful operators on keyed streams: the per-row forms of the ordered batch operators.

Each processor handles the rows of one key, oldest first within a micro-batch, and keeps its state in the state store.
A key's rows of one micro-batch are sorted in memory, so the size of a micro-batch (files or offsets per trigger)
bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

DAY_MS = 24 * 3600 * 1000


def run_keyed(
    df: DataFrame, key: str, processor: StatefulProcessor, schema: str | StructType, time_mode: str = "None", mode: str = "Append"
) -> DataFrame:
    """Apply a processor to every key."""
    return df.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=time_mode
    )


class HeldValue:
    """A value state that is read at its first use for a key and written once after the key's rows."""

    def __init__(self, state):
        self.state = state
        self.begin()

    def begin(self) -> None:
        self.known = self.changed = False
        self.value: tuple | None = None

    def get(self) -> tuple | None:
        if not self.known:
            self.value, self.known = self.read(), True
        return self.value

    def read(self) -> tuple | None:
        return self.state.get()  # None if there is none

    def write(self, value: tuple) -> None:
        self.state.update(value)

    def exists(self) -> bool:
        return self.get() is not None

    def update(self, value: tuple) -> None:
        self.value, self.known, self.changed = value, True, True

    def clear(self) -> None:
        self.update(None)

    def flush(self) -> None:
        if self.changed:
            self.state.clear() if self.value is None else self.write(self.value)
        self.begin()


class HeldList(HeldValue):
    """A list state, likewise; its value is a list of tuples."""

    def read(self) -> list[tuple] | None:
        return list(self.state.get()) if self.state.exists() else None

    def write(self, value: list[tuple]) -> None:
        self.state.put(value)

    def items(self) -> list[tuple]:
        return list(self.get() or ())

    def update(self, value: list[tuple] | None) -> None:
        super().update(value or None)


class HeldKeys(HeldValue):
    """The keys of a map state: one look for each unlike key among the rows, one write for each new one."""

    def begin(self) -> None:
        self.there: dict[str, bool] = {}
        self.added: list[str] = []

    def add(self, key: str) -> bool:
        """Whether the key is new."""
        if key not in self.there:
            self.there[key] = self.state.containsKey((key,))
        if self.there[key]:
            return False
        self.there[key] = True
        self.added.append(key)
        return True

    def flush(self) -> None:
        for key in self.added:
            self.state.updateValue((key,), (1,))
        self.begin()


class Ordered(StatefulProcessor):
    """Handles rows one by one, sorted by ``order``; ``step`` returns the rows to emit.

    State made by ``value_state``, ``list_state`` and ``key_state`` lives in memory while the rows of a key pass. A key has one
    timer at most, at the time that ``due`` reads from its state: it is set after the rows of a key, not row by row.
    """

    def __init__(self, order: tuple[str, ...], columns: tuple[str, ...]):
        self.order, self.columns = list(order), list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held: list[HeldValue] = []
        self.open(handle)

    def value_state(self, name: str, schema: str, ttl_ms: int | None = None) -> HeldValue:
        return self._hold(HeldValue(self.handle.getValueState(name, schema, ttlDurationMs=ttl_ms)))

    def list_state(self, name: str, schema: str) -> HeldList:
        return self._hold(HeldList(self.handle.getListState(name, schema)))

    def key_state(self, name: str) -> HeldKeys:
        return self._hold(HeldKeys(self.handle.getMapState(name, "value string", "n long")))

    def _hold(self, held: HeldValue) -> HeldValue:
        self.held.append(held)
        return held

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, key: tuple, row) -> list[tuple]:
        raise NotImplementedError

    def due(self) -> int | None:
        """When the key wants to be called again, by its state."""
        return None

    def expired(self, key: tuple, now: int) -> list[tuple]:
        """Rows to emit when the time of the timer is reached; ``now`` is how far time has come, at or after it."""
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.timer_values = timerValues
        parts = list(rows)
        ordered = (pd.concat(parts) if len(parts) > 1 else parts[0]).sort_values(self.order, kind="stable")
        before = self.due()
        out = [emitted for row in ordered.itertuples(index=False) for emitted in self.step(key, row)]
        after = self.due()
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        yield from self._emit(out)

    def handleExpiredTimer(
        self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[pd.DataFrame]:
        self.timer_values = timerValues
        out = self.expired(key, self.reached(timerValues, expiredTimerInfo.getExpiryTimeInMs()))
        after = self.due()
        if after is not None:
            self.handle.registerTimer(after)
        yield from self._emit(out)

    def reached(self, timer_values: TimerValues, expiry: int) -> int:
        """How far event time has come when a timer fires."""
        return max(expiry, timer_values.getCurrentWatermarkInMs())

    def _emit(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        for held in self.held:
            held.flush()
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def number(value) -> float | None:
    """A number of a row; what was null comes as NaN."""
    return None if value is None or value != value else float(value)


def exact(value: float) -> Decimal:
    return Decimal(str(value)).quantize(Decimal("0.000001"))


# -- running values -------------------------------------------------------------------------------------------


class RollingAggregates(Ordered):
    """After every row: first order value, sum, minimum, maximum, number of rows and mean of the value so far.

    Nulls count as rows only. Sums are exact to six decimals.
    """

    SCHEMA = "key string, seq long, first_seq long, total decimal(38,6), low double, high double, n long, average double"

    def __init__(self, key: str = "key", seq: str = "seq", value: str = "value", order: tuple[str, ...] = ("ts", "seq")):
        super().__init__(order, ("key", "seq", "first_seq", "total", "low", "high", "n", "average"))
        self.seq, self.value = seq, value

    def open(self, handle):
        self.state = self.value_state(
            "sums", "first_seq long, total decimal(38,6), low double, high double, n long, counted long"
        )

    def step(self, key, row):
        value, seq = number(getattr(row, self.value)), int(getattr(row, self.seq))
        first, total, low, high, n, counted = self.state.get() or (seq, None, None, None, 0, 0)
        n += 1
        if value is not None:
            total = exact(value) + (total or 0)
            low = value if low is None else min(low, value)
            high = value if high is None else max(high, value)
            counted += 1
        self.state.update((first, total, low, high, n, counted))
        return [(str(key[0]), seq, first, total, low, high, n, float(total) / counted if counted else None)]


class TopThree(Ordered):
    """After every row the three highest values so far, descending, as text with two decimals; nulls are passed over."""

    SCHEMA = "key string, seq long, best string"

    def __init__(self, seq: str = "seq", value: str = "value", order: tuple[str, ...] = ("ts", "seq")):
        super().__init__(order, ("key", "seq", "best"))
        self.seq, self.value = seq, value

    def open(self, handle):
        self.best = self.list_state("best", "value double")

    def step(self, key, row):
        value = number(getattr(row, self.value))
        known = [v for (v,) in self.best.items()]
        best = sorted([*known, value], reverse=True)[:3] if value is not None else known
        if best != known:
            self.best.update([(v,) for v in best])
        return [(str(key[0]), int(getattr(row, self.seq)), ",".join(f"{v:.2f}" for v in best))]


class DistinctValues(Ordered):
    """The first row of every value of a key; null is a value. Nothing is ever forgotten."""

    SCHEMA = "key string, value string"

    def __init__(self, value: str = "value", order: tuple[str, ...] = ("ts", "seq")):
        super().__init__(order, ("key", "value"))
        self.value = value

    def open(self, handle):
        self.seen = self.key_state("seen")

    def step(self, key, row):
        value = getattr(row, self.value)
        value = None if value is None or value != value else str(value)
        return [(str(key[0]), value)] if self.seen.add("null" if value is None else f"={value}") else []


class CountWindow(Ordered):
    """Every ``slide`` rows of a key, the sum and number of its last ``size`` rows.

    With ``slide`` equal to ``size`` the windows tumble and an unfinished one is not emitted. Nulls count as rows only.
    """

    SCHEMA = "key string, row_no long, total decimal(38,6), n long"

    def __init__(self, size: int, slide: int, value: str = "value", order: tuple[str, ...] = ("ts", "seq")):
        super().__init__(order, ("key", "row_no", "total", "n"))
        self.size, self.slide, self.value = size, slide, value

    def open(self, handle):
        self.recent = self.list_state("recent", "value double")
        self.count = self.value_state("count", "n long")

    def step(self, key, row):
        recent = [*self.recent.items(), (number(getattr(row, self.value)),)][-self.size :]
        row_no = (self.count.get() or (0,))[0] + 1
        self.recent.update(recent)
        self.count.update((row_no,))
        if row_no % self.slide:
            return []
        known = [exact(v) for (v,) in recent if v is not None]
        return [(str(key[0]), row_no, sum(known) if known else None, len(recent))]


# -- patterns -------------------------------------------------------------------------------------------------


class LevelJump(Ordered):
    """Rows whose level differs from the row before by ``jump`` or more; the first level is compared with 0."""

    SCHEMA = "key string, seq long, previous double, level double"

    def __init__(self, jump: float = 10, seq: str = "seq", level: str = "value", order: tuple[str, ...] = ("ts", "seq")):
        super().__init__(order, ("key", "seq", "previous", "level"))
        self.jump, self.seq, self.level = jump, seq, level

    def open(self, handle):
        self.last = self.value_state("last", "level double")

    def step(self, key, row):
        level = number(getattr(row, self.level))
        previous = (self.last.get() or (None,))[0] or 0.0  # a null counts as 0 for the row after it
        self.last.update((level,))
        if level is None or abs(level - previous) < self.jump:
            return []
        return [(str(key[0]), int(getattr(row, self.seq)), previous, level)]


class NewVisitor(Ordered):
    """Repairs the flag of a device: only the first row flagged '1' keeps it. The state never expires.

    Rows pass with their JSON text in ``value``.
    """

    SCHEMA = "mid string, seq long, ts long, is_new string, value string"

    def __init__(self):
        super().__init__(("ts", "seq"), ("mid", "seq", "ts", "is_new", "value"))

    def open(self, handle):
        self.seen = self.value_state("seen", "first long")

    def step(self, key, row):
        flag = row.is_new
        if flag == "1":
            if self.seen.exists():
                flag = "0"
            else:
                self.seen.update((int(row.ts),))
        return [(key[0], int(row.seq), int(row.ts), flag, row.value)]


class DailyVisit(Ordered):
    """The first entry row of a device and day. Rows are entry pages with their JSON text in ``value``.

    The last day of a device is forgotten a day after it was written. By event time (time mode EventTime) a timer
    does that, and a run over given data ends. With ``ttl_ms`` the state store does it by the clock (time mode
    ProcessingTime); such a job runs until it is stopped.
    """

    SCHEMA = "mid string, seq long, ts long, value string"

    def __init__(self, ttl_ms: int | None = None):
        super().__init__(("ts", "seq"), ("mid", "seq", "ts", "value"))
        self.ttl_ms = ttl_ms

    def open(self, handle):
        self.last = self.value_state("last", "day long, ts long", self.ttl_ms)

    def step(self, key, row):
        ts = int(row.ts)
        day = ts // DAY_MS
        if self.last.exists() and self.last.get()[0] == day:
            return []
        self.last.update((day, ts))
        return [(key[0], int(row.seq), ts, row.value)]

    def due(self):
        return self.last.get()[1] + DAY_MS if self.ttl_ms is None and self.last.exists() else None

    def expired(self, key, now):
        if self.last.exists() and self.last.get()[1] + DAY_MS <= now:
            self.last.clear()
        return []


class Bounce(Ordered):
    """Entry pages not followed by another page of the device in time.

    Run with time mode EventTime. An entry waits for its timeout; a page before that cancels it, a page at or after it, or
    the watermark, releases it. The timer of a key stands at its first timeout.
    """

    SCHEMA = "mid string, seq long, ts long, value string"

    def __init__(self, timeout: timedelta):
        super().__init__(("ts", "seq"), ("mid", "seq", "ts", "value"))
        self.timeout_ms = timeout // timedelta(milliseconds=1)

    def open(self, handle):
        self.waiting = self.list_state("waiting", "seq long, ts long, value string")

    def step(self, key, row):
        out, ts, held = [], int(row.ts), self.waiting.items()
        if row.shown and held:
            for seq, since, value in held:
                if ts - since >= self.timeout_ms:
                    out.append((key[0], seq, since, value))
            self.waiting.clear()
        if row.entry:
            self.waiting.update([*self.waiting.items(), (int(row.seq), ts, row.value)])
        return out

    def due(self):
        held = self.waiting.items()
        return min(since for _, since, _ in held) + self.timeout_ms if held else None

    def expired(self, key, now):
        held = self.waiting.items()
        self.waiting.update([w for w in held if w[1] + self.timeout_ms > now])
        return [(key[0], *w) for w in held if w[1] + self.timeout_ms <= now]


class RisingAlert(Ordered):
    """Alerts when a level keeps rising for ``hold``. Run with time mode EventTime; ``ts`` in milliseconds.

    The first rise sets a timer; a row that does not rise cancels it; after an alert the next rise sets a new one. With
    ``once`` a run of rises alerts only once, as in the batch form.
    """

    SCHEMA = "key string, first_rise long"

    def __init__(
        self, hold: timedelta, level: str = "value", order: tuple[str, ...] = ("ts", "seq"), once: bool = False
    ):
        super().__init__(order, ("key", "first_rise"))
        self.hold_ms, self.level, self.once = hold // timedelta(milliseconds=1), level, once

    def open(self, handle):
        self.last = self.value_state("last", "level double")
        self.since = self.value_state("since", "ts long, alerted boolean")

    def alert(self, since: int) -> None:
        self.since.update((since, True)) if self.once else self.since.clear()

    def step(self, key, row):
        level, ts = number(getattr(row, self.level)), int(row.ts)
        previous = (self.last.get() or (None,))[0] or 0.0
        self.last.update((level,))
        out = []
        if self.since.exists():
            since, alerted = self.since.get()
            if not alerted and since + self.hold_ms < ts:
                # Time has passed the timer within this batch: the alert comes before this row.
                self.alert(since)
                out.append((str(key[0]), since))
        if level is not None and level > previous:
            if not self.since.exists():
                self.since.update((ts, False))
        elif self.since.exists():
            self.since.clear()
        return out

    def due(self):
        since, alerted = self.since.get() or (None, True)
        return None if alerted else since + self.hold_ms

    def expired(self, key, now):
        since, alerted = self.since.get() or (None, True)
        if alerted:
            return []
        self.alert(since)
        return [(str(key[0]), since)]


class Reminder(Ordered):
    """A message some time after every row, by event time or by processing time.

    The messages of a key wait in one value; its timer stands at the first of them.
    """

    SCHEMA = "key string, fired_at long"

    def __init__(self, delay: timedelta, event_time: bool, order: tuple[str, ...] = ("ts", "seq")):
        super().__init__(order, ("key", "fired_at"))
        self.delay_ms, self.event_time = delay // timedelta(milliseconds=1), event_time

    def open(self, handle):
        self.waiting = self.value_state("waiting", "fires_at array<long>")

    def step(self, key, row):
        now = int(row.ts) if self.event_time else self.timer_values.getCurrentProcessingTimeInMs()
        waiting = self.waiting.get() or ([],)
        waiting[0].append(now + self.delay_ms)
        self.waiting.update(waiting)
        return []

    def due(self):
        return min(self.waiting.get()[0]) if self.waiting.exists() else None

    def reached(self, timer_values, expiry):
        return super().reached(timer_values, expiry) if self.event_time else max(expiry, timer_values.getCurrentProcessingTimeInMs())

    def expired(self, key, now):
        waiting = self.waiting.get()[0] if self.waiting.exists() else []
        later = [at for at in waiting if at > now]
        self.waiting.update((later,) if later else None)
        return [(str(key[0]), at) for at in sorted(waiting) if at <= now]
