"""Operators with state and timers, on streams in any order within the watermark.

Rows of a key wait in its state until the watermark has passed their time; then they are taken
in order of time, with the deadlines they set falling due between them. So the result doesn't
depend on how a stream is cut into micro-batches. At one time rows come first, by their other
columns. What a key holds is bounded by its machine and by the rows within the watermark's delay.

Each operator takes rows with a watermark on a timestamp column, or a batch, which is a whole
stream; a batch is sorted by key and time, and no key is held whole. Streams need the RocksDB
state store.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A time after all others, and results that are handed on at once.
END, OUT_ROWS = 1 << 62, 4096


class Machine:
    """What happens to a key, one row or deadline after the other. state is a dict of JSON values; times are in microseconds."""

    output = ""

    def __init__(self, state: dict[str, Any]):
        self.state = state

    def row(self, at: int, row: dict[str, Any]) -> list[tuple]:
        raise NotImplementedError

    def deadline(self) -> int | None:
        """When something falls due without a row."""
        return None

    def due(self, at: int) -> list[tuple]:
        return []


def advance(machine: Machine, rows: Iterable[tuple[int, dict[str, Any]]], until: int = END) -> Iterator[tuple]:
    """What a machine says to rows in order and to its deadlines, up to a time."""
    for at, row in rows:
        while (due := machine.deadline()) is not None and due < at:
            yield from machine.due(due)
        yield from machine.row(at, row)
    while (due := machine.deadline()) is not None and due <= until:
        yield from machine.due(due)


def _frame(rows: list[tuple], output: StructType) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=output.names, dtype=object)
    return frame.astype({f.name: "Int64" for f in output.fields if isinstance(f.dataType, LongType)})


class _Ordered(StatefulProcessor):
    def __init__(self, make: Callable[[dict[str, Any]], Machine], key: str, output: StructType):
        self.make, self.key, self.output = make, key, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("at", LongType()), StructField("row", StringType())]))
        self.machine = handle.getValueState("machine", StructType([StructField("state", StringType())]))

    def _call_at(self, micros: int) -> None:
        self.handle.registerTimer(max(-(-micros // 1000), 0))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(at), row) for part in rows for at, row in zip(part.iloc[:, -2].tolist(), part.iloc[:, -1].tolist(), strict=True)]
        if new:
            self.waiting.appendList(new)
            self._call_at(min(at for at, _ in new))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        waiting = [(at, row) for at, row in self.waiting.get()]
        ready, rest = [(at, json.loads(row)) for at, row in waiting if at <= until], [x for x in waiting if x[0] > until]
        ready.sort(key=lambda x: (x[0], [(v is not None, v) for v in x[1].values()]))
        machine = self.make(json.loads(self.machine.get()[0]) if self.machine.exists() else {})
        out = list(advance(machine, ready, until))
        if ready:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if machine.state:
            self.machine.update((json.dumps(machine.state),))
        elif self.machine.exists():
            self.machine.clear()
        for at in (machine.deadline(), min((at for at, _ in rest), default=None)):
            if at is not None:
                self._call_at(at)
        if out:
            yield _frame([(*key, *x) for x in out], self.output)

    def close(self) -> None:
        pass


def _whole(parts: Iterator[pd.DataFrame], make: Callable[[dict[str, Any]], Machine], output: StructType) -> Iterator[pd.DataFrame]:
    """The same of a partition of a batch, sorted by key and time: holds one machine and OUT_ROWS results."""
    rows = ((k, int(at), row) for part in parts for k, at, row in part.itertuples(index=False, name=None))
    out: list[tuple] = []
    for key, own in groupby(rows, lambda r: r[0]):
        for said in advance(make({}), ((at, json.loads(row)) for _, at, row in own)):
            out.append((key, *said))
            if len(out) == OUT_ROWS:
                yield _frame(out, output)
                out = []
    yield _frame(out, output)


def run(rows: DataFrame, key: str, time: str, columns: list[str], make: Callable[[dict[str, Any]], Machine], output: str) -> DataFrame:
    """key and what a machine says of the rows of each key, in order of time. Rows without a key or a time don't count."""
    kinds = StructType([rows.schema[key], *StructType.fromDDL(output).fields])
    sent = rows.where(F.col(time).isNotNull() & F.col(key).isNotNull()).select(key, time, F.unix_micros(F.col(time).cast("timestamp")).alias("_at"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("_row"))
    if rows.isStreaming:
        return sent.groupBy(key).transformWithStateInPandas(_Ordered(make, key, kinds), kinds, "Append", "EventTime")
    values = F.struct(*columns).alias("_values")
    in_order = sent.drop(time).repartition(key).withColumn("_values", F.from_json("_row", rows.select(values).schema["_values"].dataType))
    in_order = in_order.sortWithinPartitions(key, "_at", *(f"_values.{c}" for c in columns)).drop("_values")
    return in_order.mapInPandas(lambda parts: _whole(parts, make, kinds), kinds)


class RunEnds(Machine):
    """A run is over with its first end event, or when the time since its first event is up."""

    def __init__(self, state: dict[str, Any], kind: str, last: str, timeout: int):
        super().__init__(state)
        self.kind, self.last, self.timeout = kind, last, timeout

    def row(self, at: int, row: dict[str, Any]) -> list[tuple]:
        self.state.setdefault("began", at)
        if row[self.kind] == self.last and "over" not in self.state:
            self.state["over"] = True
            return [("complete", at)]
        return []

    def deadline(self) -> int | None:
        if "began" not in self.state:
            return None
        return self.state["began"] + self.timeout * (2 if "over" in self.state else 1)

    def due(self, at: int) -> list[tuple]:
        if "over" in self.state:
            self.state.clear()
            return []
        self.state["over"] = True
        return [("timeout", at)]


def finished(events: DataFrame, key: str, kind: str, time: str, last: str, timeout_us: int) -> DataFrame:
    """key, state and at (microseconds) of each run that is over: complete or timeout.

    What comes later is the run's too and says nothing, until twice the time since it began; then it is forgotten.
    """
    return run(events, key, time, [kind], lambda s: RunEnds(s, kind, last, timeout_us), "state string, at bigint")


class HeldQuestions(Machine):
    """A row answers the row before it if that holds a question and isn't too old."""

    def __init__(self, state: dict[str, Any], holds: str, id: str, ttl: int):
        super().__init__(state)
        self.holds, self.id, self.ttl = holds, id, ttl

    def row(self, at: int, row: dict[str, Any]) -> list[tuple]:
        out = [(row[self.id], at, self.state["id"])] if "until" in self.state else []
        self.state.clear()
        if row[self.holds]:
            self.state.update(until=at + self.ttl, id=row[self.id])
        return out

    def deadline(self) -> int | None:
        return self.state.get("until")

    def due(self, at: int) -> list[tuple]:
        self.state.clear()
        return []


def held_answers(turns: DataFrame, key: str, time: str, id: str, holds: str, ttl_us: int) -> DataFrame:
    """key, answer, at and question: the rows whose predecessor holds a question that hasn't expired, the bound included (T15). At one time rows come by id, which is a long."""
    return run(turns, key, time, [id, holds], lambda s: HeldQuestions(s, holds, id, ttl_us), "answer bigint, at bigint, question bigint")


class Holds(Machine):
    """Holders of a thing: the first takes it, the last gives it back; each for a while at most."""

    def __init__(self, state: dict[str, Any], holder: str, takes: str, timeout: int):
        super().__init__(state)
        self.holder, self.takes, self.timeout = holder, takes, timeout
        self.queue = [(t, h) for h, t in state.items() if t is not None]  # by time; entries of holders that have left are passed over
        heapify(self.queue)
        self.active = len(self.queue)

    def _left(self, holder: str, at: int, how: str) -> tuple:
        self.active -= 1
        return (at, holder, how, self.active, self.active == 0)

    def row(self, at: int, row: dict[str, Any]) -> list[tuple]:
        holder = str(row[self.holder])
        if row[self.takes]:
            if holder in self.state:
                return []
            self.state[holder] = at + self.timeout
            heappush(self.queue, (at + self.timeout, holder))
            self.active += 1
            return [(at, holder, "taken", self.active, False)]
        was = self.state.pop(holder, None)
        return [self._left(holder, at, "released")] if was is not None else []

    def deadline(self) -> int | None:
        while self.queue and self.state.get(self.queue[0][1]) != self.queue[0][0]:
            heappop(self.queue)
        return self.queue[0][0] if self.queue else None

    def due(self, at: int) -> list[tuple]:
        out = []
        while self.deadline() == at:
            holder = heappop(self.queue)[1]
            self.state[holder] = None  # until it releases, it can't take again
            out.append(self._left(holder, at, "timeout"))
        return out


def reference_holds(changes: DataFrame, key: str, time: str, holder: str, takes: str, timeout_us: int) -> DataFrame:
    """key, at, holder, change (taken, released or timeout), held (how many hold it now) and restored (nobody does any more).

    A holder that takes again without having released changes nothing, also after its time was up.
    """
    return run(changes, key, time, [holder, takes], lambda s: Holds(s, holder, takes, timeout_us), "at bigint, holder string, change string, held bigint, restored boolean")


class Spool(Machine):
    """Records in order of arrival under a cap by class and two over all."""

    def __init__(self, state: dict[str, Any], names: tuple[str, str, str], caps: dict[str, int], most: int, most_bytes: int):
        super().__init__(state)
        self.names, self.caps, self.most, self.most_bytes = names, caps, most, most_bytes

    def row(self, at: int, row: dict[str, Any]) -> list[tuple]:
        id, kind, size = (row[n] for n in self.names)
        kept = self.state.setdefault("kept", [])
        out = []

        def evict(record: list) -> None:
            kept.remove(record)
            out.append((record[0], at, "evicted", id))

        own = [r for r in kept if r[1] == kind]
        while own and len(own) >= self.caps[kind]:
            evict(own.pop(0))
        while kept and (len(kept) >= self.most or sum(r[2] for r in kept) + size > self.most_bytes):
            evict(kept[0])
        kept.append([id, kind, size])
        return [*out, (id, at, "admitted", None)]


def admitted(records: DataFrame, key: str, time: str, id: str, kind: str, size: str, caps: dict[str, int], most: int, most_bytes: int) -> DataFrame:
    """key, record, at, change (admitted or evicted) and by (the record that it made room for) of a spool, in order of arrival.

    A record that finds its class full evicts the oldest of its class; one that finds the spool
    full, by number or bytes, the oldest of all, until there is room. A record never evicts
    itself, and enters an empty spool however large it is. caps has every class; id is a long;
    at one time records arrive by id.
    """
    return run(records, key, time, [id, kind, size], lambda s: Spool(s, (id, kind, size), caps, most, most_bytes), "record bigint, at bigint, change string, by bigint")
