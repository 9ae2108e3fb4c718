"""Triage, refinement and search against plain loops over lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoscope.functions import scalars
from chronoscope.operators import search, trackers

SCHEMA = "session_id long, page long, kernel string, frame long, ts double, embedding array<double>"


def table(seed, sessions=2, pages=5, size=40, kernels=("a", "b"), d=6):
    """{(session, page): {kernel: [(ts, vector)]}} with steps in the vectors."""
    rng, out, at = random.Random(seed), {}, {}
    for s in range(sessions):
        for p in range(pages):
            n = size - 7 * (p % 2)
            for k in kernels:
                v = at.get((s, k), [rng.gauss(0, 1) for _ in range(d)])
                rows = []
                for i in range(n):
                    if rng.random() < 0.08:
                        v = [rng.gauss(0, 1) for _ in range(d)]
                    v = [x + rng.gauss(0, 0.02) for x in v]
                    rows.append(((p * size + i) * 0.1, v))
                at[s, k] = v
                out.setdefault((s, p), {})[k] = rows
    return out


def frames(spark, t):
    rows = [(s, p, k, round(ts * 10), ts, v) for (s, p), ks in t.items() for k, x in ks.items() for ts, v in x]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).withColumn("_step", F.lit("x")).repartition(5)


# --- plain trackers


class PlainCosine:
    def __init__(self):
        self.last, self.seen = None, []

    @staticmethod
    def distance(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return 1 - max(-1, min(1, sum(x * y for x, y in zip(a, b)) / (na * nb)))

    def scores(self, batch):
        if self.last is None:
            return [0.0] * len(batch)
        return [self.distance(a, b) for a, b in zip([self.last, *batch], batch)]

    def judge(self, scores, z):
        return judge(self.seen, scores, z)

    def update(self, batch):
        last = batch[0] if self.last is None else self.last
        if len(batch) > 1:
            self.seen += [self.distance(a, b) for a, b in zip([last, *batch], batch)]
        self.last = batch[-1]


class PlainPca:
    """Components by eigenvectors of the summed scatter, cut to ``k`` after each fit."""

    def __init__(self, k=16, share=0.95):
        self.k, self.share, self.n, self.pool, self.seen, self.fit = k, share, 0, [], [], None

    def scores(self, batch):
        if self.n <= self.k:
            return [0.0] * len(batch)
        mean, var, axes = self.fit[0], self.fit[1] / (self.n - 1), self.fit[2]
        use, part = 0, 0.0
        while part / var.sum() < self.share:
            part += var[use]
            use += 1
        return [math.sqrt(sum(float(np.dot(x - mean, axes[c])) ** 2 / (var[c] + 1e-8) for c in range(use))) for x in np.array(batch)]

    def judge(self, scores, z):
        self.seen += scores
        return judge(self.seen, scores, z)

    def update(self, batch):
        self.pool += batch
        if len(self.pool) < self.k:
            return
        x = np.array(self.pool)
        scatter = (x - x.mean(0)).T @ (x - x.mean(0))
        mean, n = x.mean(0), len(x)
        if self.fit is not None:
            old, power, axes = self.fit
            scatter = scatter + (axes.T * power) @ axes + self.n * n / (self.n + n) * np.outer(old - mean, old - mean)
            mean = (self.n * old + n * mean) / (self.n + n)
        power, axes = np.linalg.eigh(scatter)
        order = np.argsort(-power)[: self.k]
        self.fit, self.n, self.pool = (mean, np.maximum(power[order], 0), axes.T[order]), self.n + n, []


def judge(seen, scores, z):
    m = sum(seen) / len(seen) if seen else 0.0
    d = math.sqrt(sum((x - m) ** 2 for x in seen) / len(seen)) if len(seen) > 1 else 0.0
    return ([x > m + z * d for x in scores], [(x - m) / (d + 1e-8) for x in scores]) if d > 0 else ([False] * len(scores), [0.0] * len(scores))


NOVEL = {"naive_cos_dissimilarity": 0.5, "pca_mahalanobis": 0.1}
PLAIN = {"naive_cos_dissimilarity": PlainCosine, "pca_mahalanobis": lambda: PlainPca(4)}


def grid(a, b, k):
    return [math.floor(a + i * (b - a) / (k - 1) + 1e-9) for i in range(k)]


def states(t, strategy):
    """Pages in order, with each kernel's tracker."""
    held = {}
    for (s, p), ks in sorted(t.items()):
        for k in ks:
            held.setdefault((s, k), PLAIN[strategy]())
        yield s, p, ks, {k: held[s, k] for k in ks}


def plain_triage(t, strategy, keep=0.3, share=0.15):
    verdicts, keyframes, novel = [], [], NOVEL[strategy]
    for s, p, ks, tr in states(t, strategy):
        tops, hot = [], []
        for k in sorted(ks):
            at = grid(0, len(ks[k]) - 1, 6)
            batch = [ks[k][i][1] for i in at]
            mask, z = tr[k].judge(tr[k].scores(batch), novel)
            tr[k].update(batch)
            tops.append(max(z))
            if max(z) > keep:
                hot += [(k, at[i], at[i + 1]) for i in range(5) if mask[i] or mask[i + 1]]
        verdicts.append((s, p, max(tops), max(tops) > keep, hot))
        if max(tops) > keep:
            for k in sorted(ks):
                queue, used, learnt = [(a, b) for _, a, b in hot], 0, []
                while queue and used < int(len(ks[k]) * share):
                    a, b = queue.pop(0)
                    at = [(a + b) // 2] if b - a < 4 else grid(a, b, 4)
                    used += len(at)
                    batch = [ks[k][i][1] for i in at]
                    score = tr[k].scores(batch)
                    mask, z = tr[k].judge(score, novel)
                    learnt += batch
                    keyframes += [(s, p, k, i, score[n], z[n]) for n, i in enumerate(at) if mask[n]]
                    if b - a > 8:
                        queue += [(at[n], at[n + 1]) for n in range(3) if (mask[n] or mask[n + 1]) and at[n + 1] - at[n] > 2]
                if learnt:
                    tr[k].update(learnt)
    return verdicts, keyframes


def plain_search(t, strategy, exchange=True, share=lambda step: 0.33, novel=None, window=1.0):
    out, step, novel = [], {}, NOVEL[strategy] if novel is None else novel
    for s, p, ks, tr in states(t, strategy):
        now = step.get(s, 0)
        step[s] = now + 1
        names, events = sorted(ks), []
        queue = {k: [(0, len(ks[k]) - 1, 0, True)] for k in names}
        used, told, learnt = dict.fromkeys(names, 0), dict.fromkeys(names, 0), {k: [] for k in names}
        while any(queue.values()):
            for k in names:
                if used[k] >= int(len(ks[k]) * share(now)):
                    queue[k] = []
                    continue
                for e in events[told[k] :] if exchange else []:
                    if e[0] != k:
                        times = [x[0] for x in ks[k]]
                        lo = sum(x < e[1] - window for x in times)
                        hi = min(sum(x <= e[1] + window for x in times), len(times) - 1)
                        if lo < hi:
                            queue[k].insert(0, (lo, hi, 0, True))
                told[k] = len(events)
                if not queue[k]:
                    continue
                a, b, depth, hot = queue[k].pop(0)
                if depth >= (4 if hot else 2):
                    continue
                at = grid(a, b, 8)
                used[k] += 8
                batch = [ks[k][i][1] for i in at]
                score = tr[k].scores(batch)
                mask, z = tr[k].judge(score, novel)
                learnt[k] += batch
                spans = []
                for i in range(7):
                    spans.append((max(z[i], z[i + 1]), i, mask[i] or mask[i + 1]))
                    best = i if z[i] > z[i + 1] else i + 1
                    if spans[-1][2] and z[best] > novel:
                        events.append((k, ks[k][at[best]][0], at[best], score[best], z[best]))
                zmax, i, was = min(spans, key=lambda x: (-x[0], x[1]))
                queue[k].append((at[i], at[i + 1], depth + 1, was))
        for k in names:
            if learnt[k]:
                tr[k].update(learnt[k])
        out += [(s, p, e[0], e[2], e[3], e[4]) for _, _, e in sorted((-e[4], n, e) for n, e in enumerate(events))]
    return out


def same(got, want):
    assert want and len(got) == len(want)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-6, atol=1e-7)


def keyframes(df):
    assert not df.where(F.col("type") != F.concat("kernel", F.lit("_KEYFRAME"))).count()
    return [(r["session_id"], r["page"], r["kernel"], r["frame_index"], r["score"], r["z"]) for r in df.orderBy("session_id", "page", "place").collect()]


SMALL = {"tracker": {"components": 4}}


@pytest.mark.parametrize("strategy", sorted(trackers.STRATEGIES))
@pytest.mark.parametrize("seed", [1, 2])
def test_triage_and_refinement(spark, strategy, seed):
    t = table(seed)
    verdicts, want = plain_triage(t, strategy)
    got = search.verdicts(frames(spark, t), strategy, **SMALL).orderBy("session_id", "page").collect()
    assert [(r["session_id"], r["page"], r["interesting"], [tuple(h) for h in r["hot"]]) for r in got] == [(s, p, i, h) for s, p, _, i, h in verdicts]
    assert np.allclose([r["max_z"] for r in got], [v[2] for v in verdicts], rtol=1e-6, atol=1e-7)
    assert len({h[0] for v in verdicts for h in v[4]}) == 2  # spans of both kernels
    same(keyframes(search.refined(frames(spark, t), strategy, **SMALL)), want)


@pytest.mark.parametrize("strategy", sorted(trackers.STRATEGIES))
@pytest.mark.parametrize("exchange", [True, False])
def test_search_with_and_without_exchange(spark, strategy, exchange):
    for seed in (3, 4):
        t = table(seed)
        same(keyframes(search.searched(frames(spark, t), strategy, exchange=exchange, **SMALL)), plain_search(t, strategy, exchange))
        same(keyframes(search.searched(frames(spark, t), strategy, exchange=exchange, novel=1.0, **SMALL)), plain_search(t, strategy, exchange, novel=1.0))


def test_exchange_matters(spark):
    t = table(3)
    assert plain_search(t, "pca_mahalanobis", True) != plain_search(t, "pca_mahalanobis", False)


def test_search_follows_the_schedule(spark):
    t = table(5, pages=6)
    share = lambda step: 0.2 if step < 2 else 0.2 + 0.6 * (step - 2) / 3 if step < 5 else 0.8
    by_step = {"share": lambda step: scalars.scheduled(step, F.lit(0.2), F.lit(0.8), F.lit(2), F.lit(3))}
    got = keyframes(search.searched(frames(spark, t), "naive_cos_dissimilarity", by_step))
    same(got, plain_search(t, "naive_cos_dissimilarity", share=share))
    assert got != keyframes(search.searched(frames(spark, t), "naive_cos_dissimilarity"))


def test_only_sampled_frames_are_read(monkeypatch):
    read, whole = [], search.Frames.vectors
    monkeypatch.setattr(search.Frames, "vectors", lambda self, at: read.extend(at) or whole(self, at))
    rng = np.random.default_rng(1)
    f = search.Frames("a", [(np.arange(400), np.arange(400) / 10, rng.normal(size=(400, 5)))])
    search._searched(False, True, "pca_mahalanobis", {}, {})(0, 0, {"a": trackers.PcaTracker(4)}, [f], {})
    assert 0 < len(read) < 400 * 0.33 + 8
    read.clear()
    search._triaged(False, "naive_cos_dissimilarity", {})(0, 0, {"a": trackers.CosineTracker()}, [f], {})
    assert read == grid(0, 399, 6)


def test_pca_waits_for_enough_vectors():
    rng, p = np.random.default_rng(2), trackers.PcaTracker()
    for page in range(5):
        x = rng.normal(size=(6, 20))
        assert (p.scores(x) > 0).all() if page > 2 else not p.scores(x).any()
        p.update(x)
        assert p.n == (18 if page >= 2 else 0)


def test_trackers_at_their_edges():
    c = trackers.CosineTracker()
    c.update(np.ones((1, 3)))
    assert c.moments.n == 0 and c.last is not None
    c.update(np.zeros((2, 3)))
    assert c.moments.n == 2 and not np.isnan(c.moments.mean)
    c.update(np.zeros((0, 3)))
    m = trackers.Moments()
    m.add(np.array([1.0, np.nan, 3.0]))
    assert (m.n, m.mean, m.std) == (2, 2.0, 1.0)
    assert not m.judged(np.array([np.nan]), 0.1)[0].any()


def test_tracked_pages(spark):
    t = table(6, sessions=2, pages=4, size=9)
    want = []
    for s, p, ks, tr in states(t, "pca_mahalanobis"):
        for k in sorted(ks):
            v = [x[1] for x in ks[k]]
            want += [(s, p, k, round(x[0] * 10), y) for x, y in zip(ks[k], tr[k].scores(v))]
            tr[k].update(v)
    got = [tuple(r) for r in search.tracked(frames(spark, t), components=4).orderBy("session_id", "page", "kernel", "frame").collect()]
    same(got, want)


def test_log_and_empty_tables(spark):
    t = table(7, pages=2)
    log = search.search_log(frames(spark, t), share=0.9, **SMALL)
    assert {r["type"] for r in log.collect()} == {"queue_span", "terminate_branch"}
    none = frames(spark, t).where("false")
    assert search.searched(none).count() == search.verdicts(none).count() == search.tracked(none).count() == 0
    odd = frames(spark, t).limit(3).withColumn("embedding", F.lit(None).cast("array<double>"))
    assert search.refined(odd).count() == 0
