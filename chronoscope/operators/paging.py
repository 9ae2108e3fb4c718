"""Count-based pages, decimation and frame rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pages(frames: DataFrame, size: int, key: str = "session_id", order: tuple[str, ...] = ("us", "event_id"), partial: bool = False) -> DataFrame:
    """Adds ``page`` and ``frame`` by arrival; an incomplete last page is left out unless ``partial``."""
    w = Window.partitionBy(key).orderBy(*order)
    n = F.row_number().over(w) - 1
    out = frames.withColumn("_n", n).withColumn("page", F.floor(F.col("_n") / size)).withColumn("frame", F.pmod("_n", F.lit(size)))
    if not partial:
        total = F.count("*").over(Window.partitionBy(key))
        out = out.withColumn("_total", total).where((F.col("page") + 1) * size <= F.col("_total")).drop("_total")
    return out.drop("_n")


def frame_rate(n, first, last, default: float = 60.0):
    """Frames per second of ``n`` frames between two times in microseconds; ``default`` where no time passes."""
    return F.when(last > first, (n - 1) * 1_000_000 / (last - first)).otherwise(F.lit(default))


def decimate(frames: DataFrame, target: float, key: str = "session_id", at: str = "us", tie: str = "event_id") -> DataFrame:
    """Every ``ceil(fps / target)``-th frame of a key; all where the rate is not above the target or there is one frame."""
    w = Window.partitionBy(key)
    f = frames.withColumn("_fps", frame_rate(F.count("*").over(w), F.min(at).over(w), F.max(at).over(w)))
    f = f.withColumn("_n", F.row_number().over(w.orderBy(at, tie)) - 1).withColumn("_all", F.count("*").over(w))
    step = F.when((F.col("_all") < 2) | (F.col("_fps") <= target), 1).otherwise(F.ceil(F.col("_fps") / target))
    return f.withColumn("step", step.cast("long")).where("_n % step = 0").drop("_fps", "_n", "_all")


def numbered(rows: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Adds ``_at``: each row's place in an order of all rows, from 0.

    ``bucket`` must not fall along the order. Buckets are counted first, then
    rows are numbered within theirs, so no task sorts them all. Nulls come first.
    """
    b = rows.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = b.groupBy("_bucket").agg(F.count("*").alias("_n")).select(F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    joined = b.withColumn("_own", own).join(base, F.col("_bucket").eqNullSafe(F.col("_of")))
    return joined.withColumn("_at", F.col("_base") + F.col("_own")).drop("_bucket", "_of", "_base", "_own")
