"""Machines that fold the events of a key in order of event time: over a table at once, or over a stream with
transformWithState. Both run the same steps along the same time line, so a stream gives the rows of the batch.

A stream holds a row back until the watermark has passed it, as rows come in any order within the lateness; then the rows
of its key that are due are folded in order. So a task keeps the rows of one key that are younger than the watermark, and
the machine's state. Rows later than the watermark are dropped by Spark. Timers are in event time: what a machine wants to
do later happens when the watermark (in a table: the next row of the key) gets there, before rows of the same instant.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: A step's result: the state, when the machine wants its alarm (microseconds; None: not), and rows of the output.
Result = tuple[tuple, int | None, list[tuple]]


@dataclass(frozen=True)
class Machine:
    """takes: columns of an event that the machine reads, behind its time; state, output: their fields as DDL. The output
    follows the key. idle: microseconds without an event and without an alarm to come after which a key is forgotten."""

    takes: tuple[str, ...]
    state: str
    start: Callable[[], tuple]
    output: str
    step: Callable[[tuple, int, tuple], Result]
    alarm: Callable[[tuple, int], Result] | None = None
    idle: int | None = None


class TimeLine:
    """One key's way through time. kept: state, alarm and time of the last event as saved, or None for a new key."""

    def __init__(self, machine: Machine, kept: tuple | None = None) -> None:
        self.machine = machine
        self.state, self.due, self.last = kept or (machine.start(), None, None)

    def next(self) -> int | None:
        """When something happens without an event."""
        if self.due is not None:
            return self.due
        return None if self.last is None or self.machine.idle is None else self.last + self.machine.idle

    def until(self, at: int | None) -> Iterator[tuple]:
        """What happens without an event up to `at` (None: for ever)."""
        while (then := self.next()) is not None and (at is None or then <= at):
            if self.due is None:
                self.state, self.last = self.machine.start(), None
            else:
                self.state, self.due, rows = self.machine.alarm(self.state, then)
                yield from rows

    def event(self, at: int, row: tuple) -> Iterator[tuple]:
        yield from self.until(at)
        self.last = at
        self.state, self.due, rows = self.machine.step((*self.state, self.due), at, row)
        yield from rows


def _timed(events: DataFrame, key: str, time: str, order: str, machine: Machine, *more: str) -> DataFrame:
    return events.where(F.col(time).isNotNull()).select(*more, key, F.unix_micros(F.col(time).cast("timestamp")).alias("__at"), F.col(order).alias("__order"), *(F.col(x).alias(f"__in{i}") for i, x in enumerate(machine.takes)))


def _schema(events: DataFrame, key: str, machine: Machine) -> StructType:
    return StructType([events.schema[key], *StructType.fromDDL(machine.output)])


def fold_table(events: DataFrame, key: str, time: str, order: str, machine: Machine) -> DataFrame:
    """The machine's rows over a table; ties in time go by `order`. Alarms after the last event take place. Rows without a
    time take no part; no key is a key. One key is held at a time, its rows pass in batches. Steps of a key follow from
    each other, so a key is one task's work."""
    schema = _schema(events, key, machine)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, now = None, None
        block = lambda rows: pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], arrow)
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if line is None or row[0] != now:
                    found += [(now, *x) for x in line.until(None)] if line else []
                    line, now = TimeLine(machine), row[0]
                found += [(now, *x) for x in line.event(row[1], row[3:])]
            yield block(found)
        if line:
            yield block([(now, *x) for x in line.until(None)])

    t = _timed(events, key, time, order, machine)
    return t.repartition(F.col(key)).sortWithinPartitions(key, "__at", "__order").mapInArrow(run, schema)


class _Fold(StatefulProcessor):
    def __init__(self, machine: Machine, waiting: StructType, names: list[str]) -> None:
        # schemas are parsed in the driver: workers have no session
        self.machine, self.schema, self.names, self.saved = machine, waiting, names, StructType.fromDDL(f"{machine.state}, due bigint, last bigint")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.saved)
        self.waiting = handle.getListState("waiting", self.schema)

    def _row(self, key: tuple, found: tuple) -> Row:
        return Row(**dict(zip(self.names, (*key, *found), strict=True)))

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[x] for x in self.schema.names) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        old = tuple(self.kept.get()) if self.kept.exists() else None
        line = TimeLine(self.machine, old and (old[:-2], *old[-2:]))
        for row in sorted((r for r in waiting if r[0] <= now), key=lambda r: r[:2]):
            for x in line.event(row[0], row[2:]):
                yield self._row(key, x)
        for x in line.until(now):
            yield self._row(key, x)
        later = [r for r in waiting if r[0] > now]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if line.last is None:
            self.kept.clear()
        else:
            self.kept.update((*line.state, line.due, line.last))
        then = [x for x in (line.next(), min((r[0] for r in later), default=None)) if x is not None]
        if then:
            self._wake(min(then))

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, key: str, time: str, order: str, machine: Machine, late: str = "10 minutes") -> DataFrame:
    """fold_table over a stream, for a session whose state store is RocksDB. State and timers are in the checkpoint, so a
    query that is started again goes on; keys that the machine forgets leave the store."""
    rows = _timed(events.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late), key, "__ts", order, machine, "__ts")
    waiting = StructType([f for f in rows.schema if f.name not in (key, "__ts")])
    schema = _schema(events, key, machine)
    return rows.groupBy(key).transformWithState(_Fold(machine, waiting, schema.names), schema, "Append", "EventTime")


# --- the machines


def upgrade_batches(drain: int = 1_000_000, poll: int = 5_000_000, most: int = 50, idle: int | None = None) -> Machine:
    """Files of a repository wait for their upgrade until it is warm. Events (kind, files): `warm` opens the gate and starts a
    batch at once; `startup` opens it if files are left; `flush` adds files, and while the gate is open those that come
    within `drain` microseconds make one batch. A batch takes `most` files; the rest follows, a batch every `poll`
    microseconds. Output: time, trigger, events drained, files taken."""

    def take(state: tuple, at: int, trigger: str) -> Result:
        opened, n, files = state
        taken = min(most, files)
        rest = files - taken
        return (opened, 0, rest), at + poll if rest else None, [(at, trigger, n, taken)] if taken else []

    def step(state: tuple, at: int, row: tuple) -> Result:
        opened, n, files, due = state
        kind, count = row[0], row[1] or 0
        if kind == "warm":
            return take((True, n, files), at, "warm")
        if kind not in ("flush", "startup") or count <= 0:
            return (opened, n, files), due, []
        opened = opened or kind == "startup"
        soon = min(at + drain, due) if due is not None else at + drain
        return (opened, n + 1, files + count), soon if opened else None, []

    def alarm(state: tuple, at: int) -> Result:
        return take(state, at, "flush" if state[1] else "poll")

    return Machine(("kind", "files"), "opened boolean, n bigint, files bigint", lambda: (False, 0, 0), "at bigint, trigger string, n bigint, files bigint", step, alarm, idle)


#: Seconds that a refusal keeps a file waiting; other reasons DEFAULT_WAIT.
WAIT = {"pressure_rate_exceeded": 30, "pressure_burst_exceeded": 10, "pressure_workspace_exceeded": 20, "cooldown_active": 15}
DEFAULT_WAIT = 10


def admission(most: int, window: int = 60_000_000, idle: int | None = None) -> Machine:
    """Calls of a language: at most `most` admitted ones within the window (its start included), and none for a file whose refusals
    keep it waiting; waits add up from the end of the one before. Events (id, file, refused: the policy's own refusal or
    null). An admitted call ends its file's wait. Output: id, file, reason (null: admitted), the wait's end. The state holds
    the admitted times of a window and the files that wait."""

    def step(state: tuple, at: int, row: tuple) -> Result:
        admitted, until, _ = state
        number, file, refused = row
        admitted = [x for x in admitted or () if x >= at - window]
        until = until or {}
        while until and until[first := next(iter(until))] <= at and first != file:
            del until[first]
        reason = "pressure_rate_exceeded" if len(admitted) >= most else refused if refused else "cooldown_active" if at < until.get(file, 0) else None
        if reason is None:
            admitted.append(at)
            until.pop(file, None)
            return (admitted, until), None, [(number, file, None, None)]
        end = max(at, until.pop(file, 0)) + WAIT.get(reason, DEFAULT_WAIT) * 1_000_000
        until[file] = end
        return (admitted, until), None, [(number, file, reason, end)]

    return Machine(("id", "file", "refused"), "admitted array<bigint>, waits map<string, bigint>", lambda: ([], {}), "id bigint, file string, reason string, until bigint", step, None, idle)


def auto_hold(enabled: bool = True) -> Machine:
    """A hold that alerts set and release. Events (id, kind): `warn` and `critical` set it where it is not set; `ok` releases
    it if an alert had set it; `hold` and `release` are by hand, `auto_on` and `auto_off` switch the rule. A hold set by
    hand stays. Output: id, kind, whether held, whether the rule holds it, and what the event did."""

    def step(state: tuple, at: int, row: tuple) -> Result:
        held, own, on, _ = state
        number, kind = row
        action = "NO_CHANGE"
        if kind in ("hold", "release"):
            held, action = kind == "hold", "BY_HAND"
        elif kind in ("auto_on", "auto_off"):
            on, action = kind == "auto_on", "SWITCHED"
        elif not on:
            action = "AUTO_DISABLED"
        elif kind in ("warn", "critical") and not held:
            held, own, action = True, True, "HOLD_ENABLED"
        elif kind == "ok" and own and held:
            held, own, action = False, False, "HOLD_RELEASED"
        return (held, own, on), None, [(number, kind, held, own, action)]

    return Machine(("id", "kind"), "held boolean, own boolean, enabled boolean", lambda: (False, False, enabled), "id bigint, kind string, held boolean, own boolean, action string", step)
