"""Gestures from raw input: scroll sessions, key holds, focus gating, mouse trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(ticks: DataFrame, gap: int, key: str = "session_id", at: str = "us") -> DataFrame:
    """Adds ``session_no``: a gap longer than ``gap`` starts a new one, an equal gap does not."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    new = F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True)).cast("int")
    return ticks.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def scroll_gestures(ticks: DataFrame, gap: int, key: str = "session_id", at: str = "us") -> DataFrame:
    """Scroll gestures: ends at the last tick; a reversal is a change of sign between ticks, zero being a sign.

    Where ticks have a ``dx``, gestures have its total, and a tick that moves
    neither way is none: it neither joins a gesture nor keeps it open.
    """
    across = "dx" in ticks.columns
    s = sessions(ticks.where("dx <> 0 or dy <> 0") if across else ticks, gap, key, at)
    w = Window.partitionBy(key, "session_no").orderBy(at, "event_id")
    s = s.withColumn("_turn", F.coalesce(F.signum("dy") != F.lag(F.signum("dy")).over(w), F.lit(False)).cast("int"))
    return s.groupBy(key, "session_no").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.sum("dy").alias("total_dy"), F.count("*").alias("n_ticks"), F.sum("_turn").alias("reversals"), *([F.sum("dx").alias("total_dx")] if across else []))


def key_holds(presses: DataFrame, key: list[str], at: str = "us") -> DataFrame:
    """Press and release pairs: repeated presses are ignored, a release without press too, a key never released gives nothing."""
    w = Window.partitionBy(*key).orderBy(at, "event_id")
    kept = presses.withColumn("_was", F.coalesce(F.lag("action").over(w), F.lit("R"))).where("action <> _was").drop("_was")
    ends = kept.withColumn("released", F.lead(at).over(w))
    return ends.where("action = 'P' and released is not null").select(*key, F.col(at).alias("pressed"), "released", (F.col("released") - F.col(at)).alias("held"))


def as_of(events: DataFrame, samples: DataFrame, value: str, key: str = "session_id", at: str = "us") -> DataFrame:
    """Events with the latest sample of their key at or before them (null before the first), in one sort of both; of samples of one time the largest counts."""
    both = events.withColumn("_side", F.lit(1)).unionByName(samples.select(key, at, value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side", F.when(F.col("_side") == 0, F.col(value))).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1").drop("_side")


def focus_gate(events: DataFrame, samples: DataFrame, key: str = "session_id", at: str = "us") -> DataFrame:
    """Events while the target has the focus; key releases always pass."""
    return as_of(events, samples, "focused", key, at).where(F.coalesce("focused", F.lit(False)) | (F.col("kind") == "release"))


TRAJECTORY = "session_id long, start double, end double, x0 int, y0 int, x1 int, y1 int, button string, distance double, linearity double, points array<array<int>>"


def trajectories(moves: DataFrame, interval: float = 0.0111, timeout: float = 0.2, least: float = 10.0) -> DataFrame:
    """Mouse trajectories of ``session_id, ts, x, y, button`` rows.

    A state machine, not a session window: a change of button ends a trajectory
    and begins one at the new point, which the old one does not get; the timeout
    is tested on small moves only. Positions are sampled at ``interval``, still
    ones too. A trajectory ends at the time of the event that ends it, the last
    of a session at its last event. Fewer than two points, or a path under
    ``least`` pixels, give nothing. Events of one time are taken by ``event_id``
    where there is one, else by place. A session's moves arrive sorted and are
    read in batches, so only the open trajectory is held. A move whose
    ``focused`` is false, where there is such a column, is part of none, but ends
    the open one at its time; so a loss of focus acts at the next move.
    """
    tie = ["event_id"] if "event_id" in moves.columns else ["x", "y", "button"]
    focused = F.coalesce("focused", F.lit(False)) if "focused" in moves.columns else F.lit(True)
    ordered = moves.repartition("session_id").sortWithinPartitions("session_id", "ts", *tie).select("session_id", "ts", "x", "y", "button", focused.alias("focused"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Trajectory(interval, timeout, least)
        names = [c.split()[0] for c in TRAJECTORY.split(", ")]
        for b in batches:
            out = [r for m in b.itertuples(index=False) for r in state.feed(*m) if r]
            if out:
                yield pd.DataFrame(out, columns=names)
        if last := state.finish(state.seen):
            yield pd.DataFrame([last], columns=names)

    return ordered.mapInPandas(run, TRAJECTORY)


def focused_trajectories(moves: DataFrame, samples: DataFrame, **settings: float) -> DataFrame:
    """Mouse trajectories while the target has the focus by the last of ``session_id, ts, focused`` samples; none before the first."""
    return trajectories(as_of(moves, samples, "focused", at="ts"), **settings)


#: An open trajectory: when it began, last moved and was last sampled, its last place and button, its session's last event, its points flat.
OPEN = "began double, moved double, sampled double, x double, y double, button string, seen double, points array<int>"


class Trajectory:
    """The open trajectory of the session that is being read."""

    def __init__(self, interval: float, timeout: float, least: float):
        self.interval, self.timeout, self.least = interval, timeout, least
        self.session, self.seen, self.points = None, None, []

    def dump(self) -> tuple:
        """The open trajectory as a row of ``OPEN``."""
        p = [c for q in self.points for c in q]
        return (*((self.began, self.moved, self.sampled, *map(float, self.last)) if p else (0.0,) * 5), self.button if p else None, self.seen, p)

    def load(self, session, state: tuple) -> None:
        self.session, (self.began, self.moved, self.sampled, x, y, self.button, self.seen), p = session, state[:7], list(state[7])
        self.last, self.points = (x, y), [(int(a), int(b)) for a, b in zip(p[::2], p[1::2], strict=True)]

    def feed(self, session, ts, x, y, button, focused=True):
        """What the event ends: a trajectory of the session before, or of this one."""
        button, done = (None if button is None or button != button else button), None
        if not focused:
            if session != self.session:
                done, self.session = self.finish(self.seen), session
            else:
                done = self.finish(ts)
        elif session != self.session:
            done = self.finish(self.seen)
            self._start(session, ts, x, y, button)
        elif not self.points:
            self._start(session, ts, x, y, button)
        elif button != self.button:
            done = self.finish(ts)
            self._start(session, ts, x, y, button)
        elif self._still(x, y) and ts - self.moved > self.timeout:
            done = self.finish(ts)
        else:
            if not self._still(x, y):
                self.moved = ts
            if ts - self.sampled >= self.interval:
                self.points.append((int(x), int(y)))
                self.sampled = ts
            self.last = (x, y)
        self.seen = ts
        return [done]

    def _still(self, x, y) -> bool:
        return ((x - self.last[0]) ** 2 + (y - self.last[1]) ** 2) ** 0.5 < 2

    def _start(self, session, ts, x, y, button):
        self.session, self.button, self.points = session, button, [(int(x), int(y))]
        self.began = self.moved = self.sampled = ts
        self.last = (x, y)

    def finish(self, at):
        p, self.points = self.points, []
        if len(p) < 2:
            return None
        path = sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(p, p[1:], strict=False))
        if path < self.least:
            return None
        direct = ((p[0][0] - p[-1][0]) ** 2 + (p[0][1] - p[-1][1]) ** 2) ** 0.5
        linear = 1.0 if len(p) < 3 or direct < 1 or path == 0 else direct / path
        return (self.session, self.began, at, *p[0], *p[-1], self.button, path, linear, [list(a) for a in p[::5]])


def held(presses: DataFrame, buttons: list[str], key: str = "session_id", at: str = "us") -> DataFrame:
    """Adds ``held``: the sorted buttons whose last action (``P`` or ``R``) up to the event is a press; a release without press holds nothing."""
    w = Window.partitionBy(key).orderBy(at, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    down = [F.when(F.last(F.when(F.col("button") == b, F.col("action")), ignorenulls=True).over(w) == "P", F.lit(b)) for b in sorted(buttons)]
    return presses.withColumn("held", F.array_compact(F.array(*down)))


def focused_gestures(ticks: DataFrame, gap: int, key: str = "session_id", at: str = "us") -> DataFrame:
    """Scroll gestures of ticks with a ``focused`` flag: a tick without focus ends the open gesture and is no part of any."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    lost = F.sum(F.when(F.coalesce("focused", F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = ticks.withColumn("_span", lost).where("focused")
    inside = Window.partitionBy(key, "_span").orderBy(at, "event_id")
    kept = kept.withColumn("_new", F.coalesce(F.col(at) - F.lag(at).over(inside) > gap, F.lit(True)).cast("int"))
    kept = kept.withColumn("gesture", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.groupBy(key, "gesture").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.sum("dy").alias("total_dy"), F.count("*").alias("n_ticks"))
