"""Schedules, grants and budgets as streams: the steps of operators.folds over state variables, event by event as they arrive.

A key's few fields are a value state, its grants, closed targets and requests
are map states, and ids that were used are a map state that may have a time to
live.  They lie in the state store (RocksDB, on the executors' disks, with its
changes in the checkpoint folder).  A key's events of one micro-batch read and
write each entry that they name once (budgets all of the key's requests, as
many as their cap allows), so a key's state may be larger than memory and a
restart goes on where the last batch ended.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import folds

#: transformWithState keeps its state in this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_ENTRY = "name string"
_JSON = "json string"


class _Entries:
    """A map state by item access; values travel as JSON.

    The store is another process, so within a batch an entry is read once, and
    what has changed is written once, by `flush`.
    """

    def __init__(self, state):
        self.state, self.read, self.changed, self.whole = state, {}, set(), False

    def get(self, name: Any) -> Any:
        if name not in self.read and not self.whole:
            key = (json.dumps(name),)
            self.read[name] = (json.loads(self.state.getValue(key)[0]),) if self.state.containsKey(key) else ()
        return next(iter(self.read.get(name, ())), None)

    def __contains__(self, name: Any) -> bool:
        self.get(name)
        return bool(self.read.get(name))

    def __setitem__(self, name: Any, value: Any) -> None:
        self.read[name] = (value,)
        self.changed.add(name)

    def add(self, name: Any) -> None:
        if name not in self.changed:
            self[name] = True

    def _all(self) -> list:
        if not self.whole:
            stored = {json.loads(k[0]): (json.loads(v[0]),) for k, v in self.state.iterator()}
            self.read, self.whole = {**stored, **self.read}, True
        return [v[0] for v in self.read.values() if v]

    def __len__(self) -> int:
        return len(self._all())

    def values(self) -> list:
        return self._all()

    def flush(self) -> None:
        for name in self.changed:
            self.state.updateValue((json.dumps(name),), (json.dumps(self.read[name][0]),))
        self.changed = set()


class Replay(StatefulProcessor):
    """Events of a key in order through a step.

    fields: names of the step's state that are one value; entries: names of maps
    and sets, with their time to live in milliseconds or None.
    """

    def __init__(self, step: Callable[[Any, dict], dict], start: dict, entries: dict[str, int | None], order: list[str], names: list[str]):
        self.step, self.entries, self.order, self.names = step, entries, order, names
        self.start = {k: v for k, v in start.items() if k not in entries}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("fields", _JSON)
        self.maps = {name: handle.getMapState(name, _ENTRY, _JSON, ttl) for name, ttl in self.entries.items()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state = dict(self.start)
        if held := self.value.get():
            state |= json.loads(held[0])
        entries = {name: _Entries(m) for name, m in self.maps.items()}
        whole = {**state, **entries}
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        events = frame.astype(object).where(frame.notna(), None).to_dict("records")
        made = [self.step(whole, e) for e in events]
        self.value.update((json.dumps({k: whole[k] for k in state}),))
        for e in entries.values():
            e.flush()
        for n in self.names:
            frame[n] = pd.array([m.get(n) for m in made], dtype=object)
        yield frame

    def close(self) -> None:
        pass


def _replayed(events: DataFrame, key: str, order: list[str], step, start: dict, entries: dict[str, int | None], added: str) -> DataFrame:
    names = [c.split()[0] for c in added.split(", ")]
    kept = [f for f in events.schema if f.name not in names]
    rows = events.select(*[F.col(f"`{f.name}`") for f in kept])
    out = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + added.replace(" long", " bigint"))
    timed = any(ttl is not None for ttl in entries.values())
    return rows.groupBy(key).transformWithStateInPandas(Replay(step, start, entries, order, names), out, "append", "processingTime" if timed else "none")


def stream_schedules(events: DataFrame, key: str, order: list[str], interval_s: int, remember_ms: int | None = None) -> DataFrame:
    """A streaming frame of events to what folds.schedules makes of them (M2).

    A key's events of one micro-batch are taken in order and are in memory
    together, so the source must bound a micro-batch; one that comes in a later
    batch than a younger one counts when it comes.  Run ids are remembered for
    remember_ms, or for ever.  The session must have set STORE.
    """
    return _replayed(events, key, order, folds.schedule_step(interval_s), folds.schedule_start(), {"used": remember_ms}, folds.SCHEDULE)


def stream_grants(records: DataFrame, key: str, order: list[str], remember_ms: int | None = None) -> DataFrame:
    """A streaming frame of records to what folds.grant_ledger makes of them (M4); attempt ids are remembered for remember_ms, or for ever."""
    return _replayed(records, key, order, folds.grant_step, folds.grant_start(), {"grants": None, "revoked": None, "attempts": remember_ms, "closed": None}, folds.GRANTS)


def stream_budget(events: DataFrame, key: str, order: list[str], *caps: int) -> DataFrame:
    """A streaming frame of events to what folds.request_budget makes of them (M10); caps as budget_step takes them."""
    return _replayed(events, key, order, folds.budget_step(*caps), folds.budget_start(), {"requests": None}, folds.BUDGET)
