"""Gauges of a stream of page moves: counters that each micro-batch observes, and a listener that keeps their totals."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "pages"


def counters(state="state", was="was") -> list:
    """Moves into a state as counters: a page is triaged when triage decides, retained when it is first kept, evicted when it is boring or gone."""
    into = lambda to, *of: F.count_if((F.col(state) == to) & F.col(was).isin(*of))
    return [
        F.count("*").alias("moves"),
        (into("BORING_EVICTING", "TRIAGING") + into("INTERESTING_RETAINED", "TRIAGING")).alias("triaged"),
        into("INTERESTING_RETAINED", "TRIAGING").alias("retained"),
        F.count_if((F.col(state) == "BORING_EVICTING") & (F.coalesce(F.col(was), F.lit("")) != "BORING_EVICTING")).alias("evicted_boring"),
        F.count_if((F.col(state) == "EVICTED") & (F.coalesce(F.col(was), F.lit("")) != "EVICTED")).alias("evicted"),
    ]


def observed(moves: DataFrame, name: str = NAME) -> DataFrame:
    """``moves`` of ``state, was`` with the counters observed as they pass; no further job reads them."""
    return moves.observe(name, *counters())


class Gauges(StreamingQueryListener):
    """Totals of the counters over all micro-batches of the observed streams.

    A micro-batch reports once, when it is done; one that is reported again
    after a restart of its query takes the place of its first report.
    """

    def __init__(self, name: str = NAME):
        self.name, self._seen, self._lock = name, {}, threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            with self._lock:
                self._seen[str(event.progress.id), event.progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> dict[str, int]:
        with self._lock:
            rows = list(self._seen.values())
        return {k: sum(r[k] for r in rows) for k in (rows[0] if rows else {})}


def line(totals: dict[str, int], states: dict[str, int]) -> str:
    """One line for a log: the counters, then how many pages are in each state that has any."""
    now = " ".join(f"{k}:{v}" for k, v in states.items() if v > 0)
    return " | ".join([*(f"{k}: {v}" for k, v in totals.items()), f"states: {now}"])
