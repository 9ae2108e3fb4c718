"""Triage, refinement and search of pages by trackers, over several kernels.

A kernel is one way to embed frames. A session's pages come in order, and each
kernel's tracker lives as long as the session, so a page is judged by what was
sampled before it. Only frames that a step asks for are scored. A session is
one ordered group: its frames arrive sorted and only the open page is held.

All functions take ``session_id, page, kernel, frame, ts, embedding`` with ``ts``
in seconds; frames without an embedding, or with a null in it, are left out,
frames of one number are taken by ``ts``, embeddings of one kernel and page must
be of one length, other columns are not read, and no rows give no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trackers import NOVEL, STRATEGIES

# The settings where none are given. ``novel``, the z that makes a frame novel, is that of the strategy.
#: Settings of triage and refinement; ``keep`` is the z that makes a page worth keeping.
TRIAGE = {"sentinels": 6, "keep": 0.3, "share": 0.15, "branching": 4, "least_span": 8}
#: Settings of the search: spans kept and depth below a hot span and below any other, share of frames sampled, seconds around another kernel's find.
SEARCH = {"branching": 8, "top": 1, "depth": 4, "top_lazy": 1, "depth_lazy": 2, "share": 0.33, "around": 1.0}

VERDICT = "session_id long, page long, max_z double, interesting boolean, hot array<struct<kernel:string,lo:int,hi:int>>"
KEYFRAME = "session_id long, page long, type string, kernel string, frame long, frame_index int, ts double, score double, z double, reason string, place int"
LOG = "session_id long, page long, kernel string, seq int, type string, depth int, z double"


def spread(lo: int, hi: int, k: int) -> list[int]:
    """``k`` whole numbers from ``lo`` to ``hi``, evenly spread and rounded down."""
    return [lo + i * (hi - lo) // (k - 1) for i in range(k)] if k > 1 else [lo]


class Frames:
    """A kernel's frames of one page; ``vectors`` reads the embeddings of those asked for."""

    def __init__(self, kernel: str, pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.kernel = kernel
        self.frame, self.ts, self._embedding = (x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*pieces, strict=True))

    def __len__(self) -> int:
        return len(self.frame)

    def vectors(self, at: list[int]) -> np.ndarray:
        return self._embedding[at]


Page = Callable[[int, int, dict[str, object], list[Frames], dict[str, float]], list[tuple]]


def _pages(batches: Iterator[pa.RecordBatch], named: list[str]) -> Iterator[tuple[int, int, list[Frames], dict[str, float]]]:
    """The pages of sorted batches, each with its kernels' frames in order of their names."""
    at, kernels, given = None, {}, {}
    for b in batches:
        t = pa.Table.from_batches([b])
        col = {c: t.column(c).combine_chunks() for c in t.column_names}
        keys = list(zip(col["session_id"].to_pylist(), col["page"].to_pylist(), col["kernel"].to_pylist(), strict=True))
        cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
        ends = col["embedding"].offsets.to_numpy()
        values = col["embedding"].values.to_numpy()
        frame, ts = col["frame"].to_numpy(), col["ts"].to_numpy()
        for i, j in zip(cuts, cuts[1:], strict=False):
            session, page, kernel = keys[i]
            if (session, page) != at:
                if at is not None:
                    yield *at, [Frames(k, p) for k, p in kernels.items()], given
                at, kernels, given = (session, page), {}, {n: float(col[n][i].as_py()) for n in named if col[n][i].as_py() is not None}
            kernels.setdefault(kernel, []).append((frame[i:j], ts[i:j], values[ends[i] : ends[j]].reshape(j - i, -1)))
    if at is not None:
        yield *at, [Frames(k, p) for k, p in kernels.items()], given


def ordered(latents: DataFrame, work: Page, schema: str, strategy: str, schedule: dict[str, Callable[[Column], Column]] | None = None, **tracker) -> DataFrame:
    """``work(session, page, trackers by kernel, frames of each kernel, scheduled settings)`` on each page of each session, in order.

    ``schedule`` gives settings as expressions of the step, a page's place in
    its session from 0.
    """
    schedule, kind = schedule or {}, STRATEGIES[strategy]
    rows = latents.where("embedding is not null and not exists(embedding, x -> x is null)").select(F.col("session_id").cast("long"), F.col("page").cast("long"), "kernel", F.col("frame").cast("long"), F.col("ts").cast("double"), F.col("embedding").cast("array<double>"))
    if schedule:
        step = F.dense_rank().over(Window.partitionBy("session_id").orderBy("page")) - 1
        rows = rows.withColumn("_step", step).select("*", *[f(F.col("_step")).cast("double").alias(f"_set_{n}") for n, f in schedule.items()]).drop("_step")
    names = [x.split()[0] for x in _top(schema)]
    kinds = pa.schema([pa.field(n, _arrow(t)) for n, t in (x.split(" ", 1) for x in _top(schema))])

    def run(batches):
        session, trackers = None, {}
        for s, page, frames, given in _pages(batches, [f"_set_{n}" for n in schedule]):
            if s != session:
                session, trackers = s, {}
            for f in frames:
                if f.kernel not in trackers:
                    trackers[f.kernel] = kind(**tracker)
            out = work(s, page, trackers, frames, {n[5:]: v for n, v in given.items()})
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(n).type) for n, c in zip(names, zip(*out, strict=True), strict=True)], schema=kinds)

    return rows.repartition("session_id").sortWithinPartitions("session_id", "page", "kernel", "frame", "ts").mapInArrow(run, schema)


def _top(schema: str) -> list[str]:
    """The top-level fields of a schema."""
    out, depth, word = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return [*out, word.strip()]


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(f"x {kind}").fields[0].dataType)


def _keyframe(session, page, frames: Frames, i: int, score, z, reason, place) -> tuple:
    return (session, page, f"{frames.kernel}_KEYFRAME", frames.kernel, int(frames.frame[i]), i, float(frames.ts[i]), float(score), float(z), reason, place)


def _coarse(tracker, frames: Frames, s: dict) -> tuple[float, list[tuple[str, int, int]]]:
    """The largest z of a page's sentinels, and if it is worth keeping the spans with a novel end."""
    at = spread(0, len(frames) - 1, int(s["sentinels"]))
    x = frames.vectors(at)
    novel, z = tracker.judge(tracker.scores(x), s["novel"])
    tracker.update(x)
    top = float(z.max())
    hot = [(frames.kernel, a, b) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if novel[k] or novel[k + 1]]
    return top, hot if top > s["keep"] else []


def _fine(tracker, frames: Frames, hot: list[tuple[str, int, int]], s: dict) -> list[tuple[int, float, float]]:
    """(frame, score, z) of the novel frames found by splitting hot spans, first come first served.

    The budget is tested before a span, so it may be exceeded by a branch less one.
    """
    queue, used, out, learnt = deque((a, b) for _, a, b in hot), 0, [], []
    while queue and used < int(len(frames) * s["share"]):
        a, b = queue.popleft()
        a, b = min(a, len(frames) - 1), min(b, len(frames) - 1)  # another kernel may have more frames
        at = [(a + b) // 2] if b - a < 4 else spread(a, b, int(s["branching"]))
        used += len(at)
        x = frames.vectors(at)
        score = tracker.scores(x)
        novel, z = tracker.judge(score, s["novel"])
        learnt.append(x)
        out += [(i, score[k], z[k]) for k, i in enumerate(at) if novel[k]]
        if b - a > s["least_span"]:
            queue += [(i, j) for k, (i, j) in enumerate(zip(at, at[1:], strict=False)) if (novel[k] or novel[k + 1]) and j - i > 2]
    if learnt:
        tracker.update(np.vstack(learnt))
    return out


def _triaged(keyframes: bool, strategy: str, settings: dict) -> Page:
    def work(session, page, trackers, frames, given):
        s = TRIAGE | {"novel": NOVEL[strategy]} | settings | given
        found = [_coarse(trackers[f.kernel], f, s) for f in frames]
        top, hot = max(z for z, _ in found), [h for _, spans in found for h in spans]
        fine = [(f, k) for f in frames for k in _fine(trackers[f.kernel], f, hot, s)] if top > s["keep"] else []
        if keyframes:
            return [_keyframe(session, page, f, *k, "fine_refinement", n + 1) for n, (f, k) in enumerate(fine)]
        return [(session, page, top, top > s["keep"], [dict(zip(("kernel", "lo", "hi"), h, strict=True)) for h in hot])]

    return work


def verdicts(latents: DataFrame, strategy: str = "pca_mahalanobis", schedule=None, tracker: dict | None = None, **settings) -> DataFrame:
    """``VERDICT`` of each page: the largest z over its kernels, whether any finds it worth keeping, and their hot spans one kernel after the other.

    A page that is kept is refined before the next one comes, and trackers learn
    what both steps sampled.
    """
    return ordered(latents, _triaged(False, strategy, settings), VERDICT, strategy, schedule, **(tracker or {}))


def refined(latents: DataFrame, strategy: str = "pca_mahalanobis", schedule=None, tracker: dict | None = None, **settings) -> DataFrame:
    """``KEYFRAME`` rows of the pages that triage keeps, in the order of their discovery; each kernel refines the hot spans of all."""
    return ordered(latents, _triaged(True, strategy, settings), KEYFRAME, strategy, schedule, **(tracker or {}))


class Agent:
    """One kernel's search of a page."""

    def __init__(self, frames: Frames, tracker, settings: dict, finds: list[tuple], exchange: bool):
        self.frames, self.tracker, self.s, self.finds, self.exchange = frames, tracker, settings, finds, exchange
        self.queue = deque([(0, len(frames) - 1, 0, True)])
        self.budget, self.used, self.heard, self.learnt, self.log = int(len(frames) * settings["share"]), 0, 0, [], []

    def hear(self) -> None:
        """Puts the time around each new find of another kernel in front of the queue."""
        new, self.heard = self.finds[self.heard :], len(self.finds)
        for kernel, ts, *_ in new if self.exchange else ():
            if kernel != self.frames.kernel:
                lo = int(np.searchsorted(self.frames.ts, ts - self.s["around"], "left"))
                hi = min(len(self.frames) - 1, int(np.searchsorted(self.frames.ts, ts + self.s["around"], "right")))
                if lo < hi:
                    self.queue.appendleft((lo, hi, 0, True))

    def step(self) -> None:
        """Samples one span, publishes its finds and queues its best parts."""
        if self.used >= self.budget:
            self.queue.clear()
            return
        self.hear()
        if not self.queue:
            return
        a, b, depth, was_hot = self.queue.popleft()
        top, deepest = (self.s["top"], self.s["depth"]) if was_hot else (self.s["top_lazy"], self.s["depth_lazy"])
        if depth >= deepest:
            self.log.append(("terminate_branch", depth, None))
            return
        at = spread(a, b, int(self.s["branching"]))
        self.used += len(at)
        x = self.frames.vectors(at)
        score = self.tracker.scores(x)
        novel, z = self.tracker.judge(score, self.s["novel"])
        self.learnt.append(x)
        parts = []
        for k, (i, j) in enumerate(zip(at, at[1:], strict=False)):
            hot = bool(novel[k] or novel[k + 1])
            parts.append((i, j, hot, float(max(z[k], z[k + 1]))))
            best = k if z[k] > z[k + 1] else k + 1
            if hot and z[best] > self.s["novel"]:
                self.finds.append((self.frames.kernel, float(self.frames.ts[at[best]]), at[best], float(score[best]), float(z[best])))
        parts.sort(key=lambda p: -p[3])
        for i, j, hot, best_z in parts[: int(top if any(p[2] for p in parts) else self.s["top_lazy"])]:
            self.queue.append((i, j, depth + 1, hot))
            self.log.append(("queue_span", depth + 1, best_z))


def _searched(log: bool, exchange: bool, strategy: str, settings: dict, own: dict[str, dict]) -> Page:
    def work(session, page, trackers, frames, given):
        s, finds = SEARCH | {"novel": NOVEL[strategy]} | settings | given, []
        agents = [Agent(f, trackers[f.kernel], s | own.get(f.kernel, {}), finds, exchange) for f in frames]
        while any(a.queue for a in agents):
            for a in agents:
                a.step()
        for a in agents:
            if a.learnt:
                a.tracker.update(np.vstack(a.learnt))
        if log:
            return [(session, page, a.frames.kernel, n, *e) for a in agents for n, e in enumerate(a.log)]
        by = {f.kernel: f for f in frames}
        kept = sorted((-z, n, kernel, i, score) for n, (kernel, _, i, score, z) in enumerate(finds) if z > s["novel"])
        return [_keyframe(session, page, by[kernel], i, score, -z, "cooperative_search_spike", n + 1) for n, (z, _, kernel, i, score) in enumerate(kept)]

    return work


def searched(latents: DataFrame, strategy: str = "pca_mahalanobis", schedule=None, tracker: dict | None = None, exchange: bool = True, own: dict[str, dict] | None = None, **settings) -> DataFrame:
    """``KEYFRAME`` rows of each page by a search of all kernels in turn, by z and then in order of discovery.

    Each kernel takes a step in turn. A find is told to the others in the order
    in which finds were made; they look first at the time around it. ``own``
    has settings of single kernels; ``schedule`` those that change with the step.
    A sentinel between two hot spans is found by both, and both finds count.
    """
    return ordered(latents, _searched(False, exchange, strategy, settings, own or {}), KEYFRAME, strategy, schedule, **(tracker or {}))


def search_log(latents: DataFrame, strategy: str = "pca_mahalanobis", schedule=None, tracker: dict | None = None, exchange: bool = True, own: dict[str, dict] | None = None, **settings) -> DataFrame:
    """``LOG`` rows of ``searched``: the spans that each kernel queued, and the branches that ended at their depth."""
    return ordered(latents, _searched(True, exchange, strategy, settings, own or {}), LOG, strategy, schedule, **(tracker or {}))


def tracked(latents: DataFrame, strategy: str = "pca_mahalanobis", **tracker) -> DataFrame:
    """Each frame of each page with its score by the tracker before the page, which then learns the page."""

    def work(session, page, trackers, frames, given):
        out = []
        for f in frames:
            x = f.vectors(list(range(len(f))))
            out += [(session, page, f.kernel, int(n), float(v)) for n, v in zip(f.frame, trackers[f.kernel].scores(x), strict=True)]
            trackers[f.kernel].update(x)
        return out

    return ordered(latents, work, "session_id long, page long, kernel string, frame long, score double", strategy, **tracker)
