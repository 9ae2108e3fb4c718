"""Recovery of a run: committed chunks and what only the journal has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def consolidate(chunks: DataFrame, journal: DataFrame, key: str = "event_id") -> DataFrame:
    """Chunk rows, then journal rows of events that no chunk has; columns of either side are kept and filled with null."""
    tail = journal.join(chunks.select(key), key, "left_anti")
    return chunks.withColumn("origin", F.lit("chunk")).unionByName(tail.withColumn("origin", F.lit("journal")), allowMissingColumns=True)


def write_consolidated(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """``events_complete``: the consolidated table in files of bounded rows."""
    df.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)


def read_consolidated(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_consolidated`` wrote, columns of the journal's tail included."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order; deterministic if the order is total."""
    from pyspark.sql import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
