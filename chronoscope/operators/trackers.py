"""Trackers of novelty: the state that scores a session's vectors one batch after another.

A tracker scores a batch with what it holds (``scores``), judges these scores
(``judge``), and learns the batch when its page is done (``update``).
"""

from __future__ import annotations

import numpy as np


class Moments:
    """Running mean and population deviation of all values so far but NaN."""

    def __init__(self):
        self.n, self.mean, self.m2 = 0, 0.0, 0.0

    def add(self, values: np.ndarray) -> None:
        v = values[~np.isnan(values)]
        if len(v):
            n, mean = self.n + len(v), v.mean()
            gap = mean - self.mean
            self.m2 += ((v - mean) ** 2).sum() + gap * gap * self.n * len(v) / n
            self.mean += gap * len(v) / n
            self.n = n

    @property
    def std(self) -> float:
        return (self.m2 / self.n) ** 0.5 if self.n > 1 else 0.0

    def judged(self, scores: np.ndarray, z: float) -> tuple[np.ndarray, np.ndarray]:
        """Which scores are more than ``z`` deviations above the mean, and their z; none, and zeros, where nothing deviates."""
        if self.std == 0:
            return np.zeros(len(scores), bool), np.zeros(len(scores))
        return scores > self.mean + self.std * z, (scores - self.mean) / (self.std + 1e-8)


class CosineTracker:
    """Cosine distance of each vector from the one before; the first of a batch from the last one learnt.

    Distances join the moments when they are learnt, so a batch is judged by
    those before it. A batch of one vector moves the last vector but adds no
    distance; the first vector of all is at distance 0 from itself.
    """

    def __init__(self, **_):
        self.last, self.moments = None, Moments()

    def _distances(self, x: np.ndarray) -> np.ndarray:
        s = np.vstack([self.last, x]).astype(float)
        s /= np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-12)
        return 1.0 - np.clip((s[:-1] * s[1:]).sum(axis=1), -1.0, 1.0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.last is None or not len(x) else self._distances(x)

    def judge(self, scores: np.ndarray, z: float) -> tuple[np.ndarray, np.ndarray]:
        return self.moments.judged(scores, z)

    def update(self, x: np.ndarray) -> None:
        if not len(x):
            return
        self.last = x[0] if self.last is None else self.last
        if len(x) > 1:
            self.moments.add(self._distances(x))
        self.last = x[-1]


class PcaTracker:
    """Mahalanobis distance in the space of principal components that are fitted batch by batch.

    Vectors are held until there are as many as components, then merged into the
    fit. Scores are 0 until more vectors than components are fitted; then as
    many components count as hold ``share`` of the kept variance. Scores join
    the moments before they are judged.
    """

    def __init__(self, components: int = 16, share: float = 0.95, **_):
        self.k, self.share, self.n, self.held, self.moments = components, share, 0, [], Moments()

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.n <= self.k:
            return np.zeros(len(x))
        variance = self.singular**2 / (self.n - 1)
        use = int(np.searchsorted(np.cumsum(variance / variance.sum()), self.share)) + 1
        p = (x - self.mean) @ self.axes[:use].T
        return np.sqrt((p**2 / (variance[:use] + 1e-8)).sum(axis=1))

    def judge(self, scores: np.ndarray, z: float) -> tuple[np.ndarray, np.ndarray]:
        self.moments.add(scores)
        return self.moments.judged(scores, z)

    def update(self, x: np.ndarray) -> None:
        if len(x):
            self.held.append(np.asarray(x, float))
        if sum(map(len, self.held)) >= self.k:
            self._merge(np.vstack(self.held))
            self.held = []

    def _merge(self, x: np.ndarray) -> None:
        m, mean = len(x), x.mean(axis=0)
        rows = x - mean
        if self.n:
            gap = np.sqrt(self.n * m / (self.n + m)) * (self.mean - mean)
            rows = np.vstack([self.singular[:, None] * self.axes, rows, gap])
            mean = (self.n * self.mean + m * mean) / (self.n + m)
        _, s, axes = np.linalg.svd(rows, full_matrices=False)
        self.mean, self.n, self.singular, self.axes = mean, self.n + m, s[: self.k], axes[: self.k]


#: Trackers by the name of their strategy.
STRATEGIES = {"naive_cos_dissimilarity": CosineTracker, "pca_mahalanobis": PcaTracker}
#: By strategy, the z from which on a frame is novel.
NOVEL = {"naive_cos_dissimilarity": 0.5, "pca_mahalanobis": 0.1}
