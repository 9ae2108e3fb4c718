"""Coarse triage of frame pages by window functions; ``search`` has the forms that keep a tracker's state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import linspace
from .novelty import drift, running_z


def sentinels(pages: DataFrame, k: int = 6, n: str = "n_frames") -> DataFrame:
    """``k`` evenly spread frames of each page, by ordinal and frame index."""
    return pages.select("*", F.posexplode(linspace(F.lit(0), F.col(n) - 1, k)).alias("ordinal", "idx"))


def coarse_triage(latents: DataFrame, k: int = 6, z: float = 0.3, page_key: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Sentinels of each page with ``score`` and ``z`` against the pages so far, and the span to the next sentinel.

    ``hot`` tells that either end of the span is novel; only sentinels meet the
    embeddings, so whole pages are never scored.
    """
    key = list(page_key)
    frames = latents.withColumn("idx", F.row_number().over(Window.partitionBy(*key, "page").orderBy("frame")) - 1)
    pages = frames.groupBy(*key, "page").agg(F.count("*").alias("n_frames"))
    picked = sentinels(pages, k).join(frames.select(*key, "page", "idx", "frame", "embedding"), [*key, "page", "idx"])
    picked = picked.withColumn("_seq", F.col("page") * k + F.col("ordinal"))
    scored = running_z(drift(picked, key, "_seq"), key, "page")
    w = Window.partitionBy(*key, "page").orderBy("ordinal")
    novel = F.col("z") > z
    spans = scored.withColumns({"novel": novel, "next_idx": F.lead("idx").over(w), "hot": F.coalesce(novel | F.lead(novel).over(w), F.lit(False)), "span_z": F.greatest("z", F.lead("z").over(w))})
    return spans.drop("embedding", "_seq")


def interesting(spans: DataFrame, z: float = 0.3, page_key: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """The verdict on each page: interesting if any sentinel's z is above the threshold."""
    return spans.groupBy(*page_key, "page").agg(F.max("z").alias("max_z"), (F.max("z") > z).alias("interesting"), F.sum(F.col("hot").cast("int")).alias("n_hot"))


def peaks(spans: DataFrame) -> DataFrame:
    """``peak`` of each hot span: the frame of its end with the larger z, of equal ones the later."""
    w = Window.partitionBy("session_id", "page").orderBy("ordinal")
    both = spans.withColumns({"_frame": F.lead("frame").over(w), "_z": F.lead("z").over(w)})
    return both.where("hot and next_idx is not null").withColumn("peak", F.when(F.col("z") > F.col("_z"), F.col("frame")).otherwise(F.col("_frame"))).drop("_frame", "_z")


def top_spans(spans: DataFrame, top: int, lazy: int, page_key: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """The best spans of each page by z: ``top`` of them where one is hot, else ``lazy``; ties by ordinal."""
    w = Window.partitionBy(*page_key, "page")
    s = spans.where("next_idx is not null").withColumn("_any", F.max("hot").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("span_z"), "ordinal")))
    return s.where(F.col("rank") <= F.when(F.col("_any"), top).otherwise(lazy)).drop("_any")


def across_kernels(scores: DataFrame, threshold: float, key: list[str]) -> DataFrame:
    """Each page over all its kernels: the largest novelty, whether any kernel finds it interesting, and the kernels that do, sorted."""
    hit = F.col("z") > threshold
    kernels = F.array_sort(F.collect_set(F.when(hit, F.col("kernel"))))
    return scores.groupBy(*key).agg(F.max("z").alias("z"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("interesting"), kernels.alias("kernels"))
