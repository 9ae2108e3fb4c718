"""Vector expressions on array columns; no Python on the executors."""

from __future__ import annotations

from pyspark.sql import functions as F


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a):
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))


def normalise(a):
    """Each element over the norm, which is computed once a vector."""
    return F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, n: x.cast("double") / n)


def cosine_distance(a, b):
    """1 - cosine, the cosine held within -1 and 1; a zero vector has cosine 0 with all."""
    c = dot(a, b) / (norm(a) * norm(b))
    return F.lit(1.0) - F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))


def linspace(a, b, k: int):
    """``k`` whole numbers from a to b, evenly spread and rounded down."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: a + F.floor(i * (b - a) / (k - 1)))


def _step(p, q):
    x, y = p[0] - q[0], p[1] - q[1]
    return F.sqrt((x * x + y * y).cast("double"))


def path_length(points):
    """The way along an array of [x, y]; 0 for fewer than two."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), _step)
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def linearity(points):
    """The straight way over the whole one: 1 for fewer than three points, ends less than one apart, or no way at all."""
    direct, whole = _step(F.element_at(points, 1), F.element_at(points, -1)), path_length(points)
    return F.when((F.size(points) < 3) | (direct < 1) | (whole == 0), 1.0).otherwise(direct / whole)


def strided(a, k: int):
    """Every ``k``-th element, the first included."""
    return F.filter(a, lambda _, i: i % k == 0)
