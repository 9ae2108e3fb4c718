"""Stream operators whose state ends by time: mouse trajectories and signs of life.

Both keep keyed state with timers on event time, so they need a watermark on
``ts`` and the RocksDB state store. A row is taken when the watermark has
passed it, in order of time, whatever order it arrived in; rows later than the
watermark are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.gestures import OPEN, TRAJECTORY, Trajectory

#: What the session must set for keyed state with timers.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

WAITING = "ts double, tie long, x int, y int, button string, focused boolean"


class _Trajectories(StatefulProcessor):
    """Moves that wait for the watermark, and the open trajectory."""

    def __init__(self, idle: float, settings: tuple[float, float, float]):
        self.idle, self.settings = idle, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            new = [(float(t), int(e), int(x), int(y), None if pd.isna(b) else b, bool(f)) for t, e, x, y, b, f in part[["at", "tie", "x", "y", "button", "focused"]].itertuples(index=False, name=None)]
            self.waiting.appendList(new)
            self.handle.registerTimer(int(max(r[0] for r in new) * 1000) + 1)
        yield from self._take(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._take(key[0], timerValues.getCurrentWatermarkInMs())

    def _take(self, session, watermark: int) -> Iterator[pd.DataFrame]:
        """Feeds what the watermark has passed; a session that then was silent for ``idle`` is over."""
        t = Trajectory(*self.settings)
        if self.open.exists():
            t.load(session, tuple(self.open.get()))
        held = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in held if r[0] * 1000 < watermark), key=lambda r: r[:2])
        out = []
        for at, _, *move in ready:
            if t.seen is not None and at - t.seen > self.idle:
                out.append(t.finish(t.seen))
            out += t.feed(session, at, *move)
        rest = [r for r in held if r[0] * 1000 >= watermark]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if t.seen is not None and not rest and (t.seen + self.idle) * 1000 < watermark:
            out.append(t.finish(t.seen))
            self.open.clear()
        elif t.seen is not None:
            self.open.update(t.dump())
            if ready:
                self.handle.registerTimer(int((t.seen + self.idle) * 1000) + 1)
        out = [r for r in out if r]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRAJECTORY.split(", ")])

    def close(self) -> None:
        pass


def trajectories(moves: DataFrame, late: str = "10 seconds", idle: float = 3600.0, interval: float = 0.0111, timeout: float = 0.2, least: float = 10.0) -> DataFrame:
    """Mouse trajectories of a stream of ``session_id, ts, event_id, x, y, button`` (and ``focused``), ``ts`` a timestamp.

    The rows are those of the batch form, the open trajectory included: it is
    given out when its session has been silent for ``idle`` seconds, and the
    session's state then goes. A pause that long also ends a trajectory where the
    next move would have gone on with it.
    """
    focused = F.coalesce("focused", F.lit(False)) if "focused" in moves.columns else F.lit(True)
    m = moves.withWatermark("ts", late).select("session_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"), F.col("event_id").cast("long").alias("tie"), "x", "y", "button", focused.alias("focused"))
    return m.groupBy("session_id").transformWithStateInPandas(_Trajectories(idle, (interval, timeout, least)), TRAJECTORY, "Append", "EventTime")


ABANDONED = "block long, last_seen double, n_signs long"


class _Heartbeats(StatefulProcessor):
    """Signs that wait for the watermark; a block's last sign of life and how many it gave."""

    def __init__(self, deadline: float):
        self.deadline = deadline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at double")
        self.state = handle.getValueState("signs", "last double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            new = [(float(t),) for t in part["at"]]
            self.waiting.appendList(new)
            self.handle.registerTimer(int(max(new)[0] * 1000) + 1)
        yield from self._take(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._take(key[0], timerValues.getCurrentWatermarkInMs())

    def _take(self, block, watermark: int) -> Iterator[pd.DataFrame]:
        """Counts the signs that the watermark has passed; a pause that is too long gives the block out."""
        last, n = self.state.get() if self.state.exists() else (None, 0)
        held, out = [float(r[0]) for r in self.waiting.get()], []
        ready, rest = sorted(t for t in held if t * 1000 < watermark), [(t,) for t in held if t * 1000 >= watermark]
        for t in ready:
            if last is not None and t - last > self.deadline:
                out.append((block, float(last), int(n)))
                n = 0
            last, n = t, n + 1
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if last is not None and (last + self.deadline) * 1000 < watermark:
            out.append((block, float(last), int(n)))
            self.state.clear()
        elif ready:
            self.state.update((float(last), int(n)))
            self.handle.registerTimer(int((last + self.deadline) * 1000) + 1)
        yield pd.DataFrame(out, columns=["block", "last_seen", "n_signs"])

    def close(self) -> None:
        pass


def abandoned(signs: DataFrame, deadline: float = 30.0, late: str = "10 seconds") -> DataFrame:
    """``block, last_seen, n_signs`` of each block of ``block, ts`` signs that then gives none for more than ``deadline`` seconds.

    A block is given out once; a sign after that begins a new watch.
    """
    s = signs.withWatermark("ts", late).select(F.col("block").cast("long").alias("block"), "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    return s.groupBy("block").transformWithStateInPandas(_Heartbeats(deadline), ABANDONED, "Append", "EventTime")
