"""Novelty of frame embeddings: drift, running z-scores, PCA with Mahalanobis distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance


def drift(latents: DataFrame, key: list[str], order: str = "frame") -> DataFrame:
    """Adds ``score``: the cosine distance from the frame before; 0 for the first."""
    w = Window.partitionBy(*key).orderBy(order)
    before = latents.withColumn("_prev", F.lag("embedding").over(w))
    score = F.when(F.col("_prev").isNull(), 0.0).otherwise(cosine_distance(F.col("embedding"), F.col("_prev")))
    return before.withColumn("score", score).drop("_prev")


def running_z(scores: DataFrame, key: list[str], batch: str, include_current: bool = True) -> DataFrame:
    """Adds ``mean``, ``std`` and ``z`` over all batches up to the current one, it included or not.

    Population moments; a deviation of 0, or of one value or none, gives z = 0.
    NaN scores take no part in the moments.
    """
    end = Window.currentRow if include_current else -1
    w = Window.partitionBy(*key).orderBy(batch).rangeBetween(Window.unboundedPreceding, end)
    s = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    out = scores.withColumns({"n_seen": F.count(s).over(w), "mean": F.avg(s).over(w), "std": F.stddev_pop(s).over(w)})
    flat = (F.col("n_seen") <= 1) | F.col("std").isNull() | (F.col("std") < 1e-12)
    return out.withColumn("std", F.when(flat, 0.0).otherwise(F.col("std"))).withColumn("z", F.when(flat, 0.0).otherwise((F.col("score") - F.col("mean")) / (F.col("std") + 1e-8)))


def pooled(tokens: DataFrame, key: list[str]) -> DataFrame:
    """The mean embedding of each key's rows, as an array."""
    parts = tokens.select(*key, F.posexplode("embedding").alias("pos", "x")).groupBy(*key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("embedding"))


def pca_mahalanobis(latents: DataFrame, k: int = 16, share: float = 0.95) -> DataFrame:
    """Adds ``score``: the Mahalanobis distance in the space of the first principal components of all rows.

    Of ``k`` components as many count as hold ``share`` of the variance of these.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = latents.withColumn("_v", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(v)
    centred = scaler.transform(v)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    total = float(sum(v.select(Summarizer.variance(F.col("_v")).alias("s")).first()["s"]))
    ratio, used = [float(r) for r in model.explainedVariance], 0
    while used < len(ratio) and sum(ratio[:used]) < share * sum(ratio):
        used += 1
    variance = F.array(*[F.lit(r * total + 1e-8) for r in ratio[:used]])
    p = F.slice(vector_to_array(F.col("_p")), 1, used)
    out = model.transform(centred)
    return out.withColumn("score", F.sqrt(F.aggregate(F.zip_with(p, variance, lambda x, s: x * x / s), F.lit(0.0), lambda a, x: a + x))).drop("_v", "_c", "_p")
