"""Folders that driver and executors share, and small helpers on DataFrames."""

from __future__ import annotations

import tempfile
import uuid
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word in every contract: space and 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    A session on one machine that has no such setting (tests) gets a local
    folder; on a cluster the setting must name a folder that all machines see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            base = tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, which cuts its lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(spark: SparkSession) -> int:
    """How many ways the packed exchanges deal their rows: it follows the session's shuffle partitions."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes that one group of a packed exchange holds.
GROUP = 8 << 20


def spread(spark: SparkSession, size: int, group: int = GROUP) -> int:
    """How many groups ``size`` bytes are dealt into, so that a group's size doesn't depend on theirs."""
    return max(spark.sparkContext.defaultParallelism, -(-size // group))


def ascii_lower(c):
    """A to Z in lower case, everything else unchanged."""
    return F.translate(c, UPPER, LOWER)


def words(c):
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text column; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def once(df: DataFrame, **columns) -> DataFrame:
    """``df`` with columns that are computed once a row.

    A filter on a plain column is moved below it and repeats its expression,
    within lambdas even once an element; it can't be moved below a generator.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], F.inline(F.array(made)))


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))
