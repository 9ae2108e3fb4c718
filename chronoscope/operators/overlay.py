"""What an overlay shows at a time: typed events, live sets, heatmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import key_label, key_text, time_offset

PAYLOAD = "type string, start_pos array<int>, end_pos array<int>, sample_points array<array<int>>, button string, x int, y int, key string, total_dx int, total_dy int, linearity double"
INPUT, TRAJECTORY, CLICK, KEY, SCROLL = "USER_INPUT", "mouse_trajectory", "mouse_click", "key", "scroll_trajectory"


def parsed(events: DataFrame) -> DataFrame:
    """User input with its payload parsed once and missing fields at their defaults."""
    p = events.where(F.col("stream_type") == INPUT).withColumn("p", F.from_json("payload_json", PAYLOAD))
    p = p.where("p.type is not null").withColumns({"start": F.coalesce("start_timestamp", F.lit(0.0)), "delta": F.coalesce("delta_timestamp", F.lit(0.0))})
    return p.withColumn("end", F.col("start") + F.col("delta"))


def clicks(p: DataFrame) -> DataFrame:
    return p.where(F.col("p.type") == CLICK).select("event_id", "start", F.coalesce("p.button", F.lit("unknown")).alias("button"), F.coalesce("p.x", F.lit(0)).alias("x"), F.coalesce("p.y", F.lit(0)).alias("y"))


def keys(p: DataFrame) -> DataFrame:
    text = key_text(F.coalesce("p.key", F.lit("?")))
    return p.where(F.col("p.type") == KEY).select("event_id", "start", "end", text.alias("key"), key_label(text).alias("label"))


def scrolls(p: DataFrame) -> DataFrame:
    return p.where(F.col("p.type") == SCROLL).select("event_id", "start", "end", F.coalesce("p.total_dx", F.lit(0)).alias("dx"), F.coalesce("p.total_dy", F.lit(0)).alias("dy"))


def mouse_paths(p: DataFrame) -> DataFrame:
    points = F.coalesce("p.sample_points", F.array().cast("array<array<int>>"))
    return p.where(F.col("p.type") == TRAJECTORY).select("event_id", "start", "end", points.alias("points"), F.coalesce("p.linearity", F.lit(1.0)).alias("linearity"))


def time_offsets(p: DataFrame, recordings: DataFrame, key: str = "session_id") -> DataFrame:
    """``key, time_offset``: a recording's start if it is a Unix time, else its session's first path, click or key; scrolls don't count, and nothing at all is 0."""
    first = p.where(F.col("p.type").isin(TRAJECTORY, CLICK, KEY)).groupBy(key).agg(F.min("start").alias("_first"))
    return recordings.join(first, key, "left").select(key, time_offset(F.col("video_start"), F.col("_first")).alias("time_offset"))


def alive(frames: DataFrame, events: DataFrame, before: int, after: int, key: str = "session_id", at: str = "us") -> DataFrame:
    """Events that are shown at each frame: ``start - before <= t <= end + after``, with their age."""
    from .intervals import band_join

    shown = events.withColumns({"_s": F.col("start"), "_e": F.col("end"), "start": F.col("start") - before, "end": F.col("end") + after})
    out = band_join(shown, frames, at, max(1, before + after, 1_000_000), key)
    return out.withColumns({"start": F.col("_s"), "end": F.col("_e"), "age": F.col(at) - F.col("_e")}).drop("_s", "_e")


def last_keys(frames: DataFrame, presses: DataFrame, within: int, n: int = 8, key: str = "session_id") -> DataFrame:
    """The last ``n`` presses shown at each frame, newest first."""
    shown = alive(frames, presses.withColumn("end", F.col("start")), 0, within, key)
    w = Window.partitionBy(key, "frame_id").orderBy(F.desc("start"), F.desc("event_id"))
    return shown.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def heatmap(points: DataFrame, width: int, height: int, key: list[str]) -> DataFrame:
    """Cells under the discs of ``x, y, radius, weight`` points: the largest weight counts, discs are not added up.

    Points of one place, radius and weight are one; cells out of bounds are cut.
    """
    p = points.select(*key, "x", "y", "radius", "weight").distinct()
    p = p.withColumn("dx", F.explode(F.sequence(-F.col("radius"), F.col("radius"))))
    p = p.withColumn("_h", F.floor(F.sqrt(F.col("radius") * F.col("radius") - F.col("dx") * F.col("dx"))).cast("int"))
    p = p.withColumn("dy", F.explode(F.sequence(-F.col("_h"), F.col("_h"))))
    cells = p.select(*key, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "weight").where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    return cells.groupBy(*key, "x", "y").agg(F.max("weight").alias("value"))


def normalised(grid: DataFrame) -> DataFrame:
    """Adds ``norm``: the value over the largest of all."""
    return grid.withColumn("norm", F.col("value") / grid.agg(F.max("value")).scalar())


def runs(messages: DataFrame, key: str, at: str, tie: str, text: str) -> DataFrame:
    """Runs of equal messages with how often each is repeated."""
    w = Window.partitionBy(key).orderBy(at, tie)
    new = F.coalesce(F.col(text) != F.lag(text).over(w), F.lit(True)).cast("int")
    m = messages.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy(key, "run").agg(F.first(text).alias(text), F.count("*").alias("n"), F.min(at).alias("start"))
