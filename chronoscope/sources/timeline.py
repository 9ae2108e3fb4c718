"""Readers of recorded sessions, and the logical tables derived from generic event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW_CONTEXT = "struct<pid:int,exe_path:string,exe_name:string,app_name:string,title:string>"
EVENT = "event_id string, stream_type string, start_timestamp double, delta_timestamp double, payload_json string"
JOURNAL = f"{EVENT}, window_context {WINDOW_CONTEXT}"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Parquet chunks with the fixed schema and the file each row came from."""
    return spark.read.schema(EVENT).parquet(path).withColumn("source_file", F.col("_metadata.file_name"))


def read_journal(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A JSON-lines journal: a malformed line raises when ``strict``, else it is left out."""
    return spark.read.schema(JOURNAL).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def find_recording(files: DataFrame, name: str = "name") -> DataFrame:
    """The recording of each folder: the first ``baseline_*.mp4`` by name, else the first ``*.mp4``."""
    from pyspark.sql import Window

    rank = F.when(F.col(name).rlike(r"^baseline_.*\.mp4$"), 0).otherwise(1)
    w = Window.partitionBy("folder").orderBy(rank, name)
    return files.where(F.col(name).endswith(".mp4")).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def recording_start(name) -> F.Column:
    """The start time in a recording's name, else 0."""
    return F.coalesce(F.regexp_extract(name, r"^baseline_record_([0-9.]+)\.mp4$", 1).try_cast("double"), F.lit(0.0))


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Durational events by session, in whole microseconds."""
    length = F.when(F.col("event_type") == "click", 0).otherwise(F.round(F.col("value") * 1_000_000).cast("long"))
    return events(spark, sf).select(
        F.col("user_id").alias("session_id"), "event_id", F.col("event_type").alias("stream_type"),
        F.col("us").alias("start"), (F.col("us") + length).alias("end"), "value", F.col("props").alias("payload_json"),
    )


def flow_events(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes that enter or leave a stage."""
    cents = F.round(F.col("value") * 100).cast("long")
    return events(spark, sf).select(F.col("event_type").alias("stage"), "event_id", "us", F.when(F.pmod("event_id", F.lit(2)) == 1, -cents).otherwise(cents).alias("net"))


def ticks(spark: SparkSession, sf: str, across: bool = False) -> DataFrame:
    """Scroll ticks: the payload number's side of 50 is the direction; sideways, the event's number decides."""
    k = F.get_json_object("props", "$.k").cast("int")
    dx = [(F.pmod("event_id", F.lit(3)) - 1).cast("int").alias("dx")] if across else []
    return events(spark, sf).select(F.col("user_id").alias("session_id"), "event_id", "us", F.signum(k - 50).cast("int").alias("dy"), *dx)


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as recorded input with JSON payloads, some of whose fields are missing; errors are no input."""
    e = events(spark, sf).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    of = lambda kind, **fields: F.to_json(F.struct(F.lit(kind).alias("type"), *[c.alias(n) for n, c in fields.items()]))
    k, some = F.col("k"), F.col("event_id") % 3 > 0
    payload = (
        F.when(F.col("event_type") == "click", of("mouse_click", button=F.when(some, F.lit("left")), x=k, y=F.when(some, k * 2)))
        .when(F.col("event_type") == "view", of("mouse_trajectory", sample_points=F.when(some, F.array(F.array(k, k), F.array(k + 1, k))), linearity=F.when(some, k / 100)))
        .when(F.col("event_type") == "purchase", of("key", key=F.when(some, F.concat(F.lit("'"), F.chr(97 + k % 26), F.lit("'"))).otherwise(F.lit("Key.shift"))))
        .otherwise(of("scroll_trajectory", total_dx=F.when(some, k), total_dy=k - 50))
    )
    stream = F.when(F.col("event_type") == "error", F.lit("SYSTEM")).otherwise(F.lit("USER_INPUT"))
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").cast("string").alias("event_id"), stream.alias("stream_type"), (F.col("us") / 1e6).alias("start_timestamp"), (F.col("k") / 10).alias("delta_timestamp"), payload.alias("payload_json"))


def latents(spark: SparkSession, sf: str, page: int = 50) -> DataFrame:
    """Frame embeddings in pages."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select((F.col("vec_id") / page).cast("long").alias("page"), F.col("vec_id").alias("frame"), "embedding", "label")


def kernels(spark: SparkSession, sf: str, session: int = 8) -> DataFrame:
    """Frames of pages in sessions of eight, ten a second, by two kernels: the halves of their embeddings."""
    half = lambda name, at: F.struct(F.lit(name).alias("kernel"), F.slice("embedding", at, 32).alias("embedding"))
    rows = latents(spark, sf).select((F.col("page") / session).cast("long").alias("session_id"), "page", "frame", (F.col("frame") / 10).alias("ts"), F.explode(F.array(half("first", 1), half("last", 33))).alias("_k"))
    return rows.select("session_id", "page", "_k.kernel", "frame", "ts", "_k.embedding")
