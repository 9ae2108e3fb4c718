"""The same operators over streams: deduplicated journals, scroll gestures, count-based pages, flow levels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def journal(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Events once each, by id, within a watermark on ``ts``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def scroll_gestures(ticks: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Scroll gestures as session windows: a tick just at the gap still belongs; the end is the last tick."""
    s = ticks.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return s.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.sum("dy").alias("total_dy"), F.count("*").alias("n_ticks")).drop("w")


PAGE = "session_id long, page long, first_frame long, last_frame long"


def pages(frames: DataFrame, size: int) -> DataFrame:
    """A row for each full page of ``size`` frames of a session, counted by arrival in order of ``frame``; the state is the open page's count and first frame."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        page, held, first = state.get if state.exists else (0, 0, 0)
        out = []
        got = sorted(f for p in parts for f in p["frame"])
        for f in got:
            first = f if held == 0 else first
            held += 1
            if held == size:
                out.append((key[0], page, first, f))
                page, held = page + 1, 0
        state.update((page, held, first))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PAGE.split(", ")])

    return frames.groupBy("session_id").applyInPandasWithState(run, PAGE, "page long, held long, first long", "append", GroupStateTimeout.NoTimeout)


HOLD = "session_id long, key string, pressed long, released long"


def key_holds(presses: DataFrame) -> DataFrame:
    """Press and release pairs of ``session_id, key, us, action``; the state is the open press."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else -1
        out = []
        for us, action in sorted((u, a) for p in parts for u, a in zip(p["us"], p["action"], strict=True)):
            if action == "P" and since < 0:
                since = us
            elif action == "R" and since >= 0:
                out.append((key[0], key[1], since, us))
                since = -1
        state.update((int(since),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in HOLD.split(", ")])

    return presses.groupBy("session_id", "key").applyInPandasWithState(run, HOLD, "since long", "append", GroupStateTimeout.NoTimeout)


def write_journal(events: DataFrame, path: str, checkpoint: str):
    """An append-only JSON journal, once for each event."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
