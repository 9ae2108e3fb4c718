"""Interval operators: topology, merging, and band joins without nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topology(events: DataFrame, session: str = "session_id") -> DataFrame:
    """Which events are active in every elementary interval of their session.

    Breakpoints get ordinals, an event is expanded over the ordinals it spans,
    and intervals meet events on an equality, so the cost is that of the answer.
    Events without length make breakpoints but are never active.
    """
    points = events.select(session, F.explode(F.array("start", "end")).alias("t")).distinct()
    w = Window.partitionBy(session).orderBy("t")
    points = points.select(session, "t", F.row_number().over(w).alias("o"), F.lead("t").over(w).alias("next"))
    first = points.select(session, F.col("t").alias("start"), F.col("o").alias("so"))
    last = points.select(session, F.col("t").alias("end"), F.col("o").alias("eo"))
    spans = events.where(F.col("start") < F.col("end")).select(session, "event_id", "start", "end").join(first, [session, "start"]).join(last, [session, "end"])
    active = spans.select(session, "event_id", F.explode(F.sequence("so", F.col("eo") - 1)).alias("o"))
    ids = active.groupBy(session, "o").agg(F.count("*").alias("n_active"), F.sort_array(F.collect_list("event_id")).alias("event_ids"))
    return ids.join(points, [session, "o"]).select(session, F.col("t").alias("start"), F.col("next").alias("end"), "n_active", "event_ids")


def merge(intervals: DataFrame, key: str = "session_id") -> DataFrame:
    """Islands of intervals that overlap or touch, with how many each merges."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def pad(points: DataFrame, at: str, before: int, after: int) -> DataFrame:
    """An interval around each point."""
    return points.withColumns({"start": F.col(at) - before, "end": F.col(at) + after})


#: Buckets of a level that an interval covers at most, and how many times wider the next level's are.
FAN = 16


def band_join(intervals: DataFrame, points: DataFrame, at: str, width: int, key: str = "session_id") -> DataFrame:
    """Points within ``[start, end]`` of the intervals of their key, both ends included.

    Intervals are expanded over buckets of ``width``, longer ones over buckets
    that are ``FAN`` times as wide for each level, so that no interval has more
    than ``FAN`` + 1 rows; points have a row for each level up to the highest.
    The join is an equality on key, level and bucket, checked exactly after it.
    """
    span = F.floor(F.col("end") / width) - F.floor(F.col("start") / width) + 1
    level = F.greatest(F.ceil(F.log(float(FAN), span / FAN)), F.lit(0)).cast("int")
    bucket = lambda c: F.floor(F.col(c) / (F.lit(width) * F.pow(F.lit(FAN), F.col("_l")).cast("long")))
    levelled = intervals.withColumn("_l", level)
    wide = levelled.withColumn("_b", F.explode(F.sequence(bucket("start"), bucket("end"))))
    top = levelled.agg(F.coalesce(F.max("_l"), F.lit(0))).scalar()
    each = points.withColumn("_l", F.explode(F.sequence(F.lit(0), top))).withColumn("_b", bucket(at))
    return wide.join(each, [key, "_l", "_b"]).where(F.col(at).between(F.col("start"), F.col("end"))).drop("_l", "_b")


def breakpoints(events: DataFrame, key: str = "session_id") -> DataFrame:
    """The distinct times at which an interval of a key begins or ends."""
    return events.select(key, F.explode(F.array("start", "end")).alias("t")).distinct()


def frames_around(marks: DataFrame, frames: DataFrame, at: str, reach: int, key: str = "session_id") -> DataFrame:
    """For each mark the first and last frame number within ``reach`` of it; spans of one frame are left out."""
    near = band_join(pad(marks.select(key, "mark_id", at), at, reach, reach).drop(at), frames.select(key, at, "idx"), at, 2 * reach, key)
    return near.groupBy(key, "mark_id").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).where("lo < hi")


def keyed(topology: DataFrame, key: str = "session_id") -> DataFrame:
    """A map's entries of a topology: ``interval`` and its ids. Of intervals whose keys agree, the later one stays."""
    from ..functions.scalars import interval_key

    t = topology.withColumn("interval", interval_key(F.col("start"), F.col("end")))
    return t.groupBy(key, "interval").agg(F.max_by("event_ids", "start").alias("event_ids"), F.max("start").alias("start"))
