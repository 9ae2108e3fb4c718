"""Sinks of micro-batches: a bounded queue of pages, and numbered chunks of events.

Both keep what they know in folders named by micro-batch. A batch reads the state
that the batch before it left and overwrites its own, so one that is repeated
after a failure writes the same rows in the same places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.paging import numbered


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """The batches that a folder has, in order; its files system is the one that Spark uses for it."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def _drop(spark: SparkSession, folder: str, below: int) -> None:
    """Deletes what batches before ``below`` left in the folder; a restart repeats the last batch at most."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for b in _batches(spark, folder):
        if b < below:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={b}"), True)


def _before(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    """What the last whole batch before ``batch`` left in the folder."""
    earlier = [b for b in _batches(spark, folder) if b < batch]
    return spark.read.parquet(f"{folder}/batch={earlier[-1]}") if earlier else None


@dataclass
class Admission:
    """Takes pages from a stream into a queue of bounded size.

    In each micro-batch the worker first claims the ``take`` pages of the queue
    that are due first (by ``priority``, then age, then page), which makes room;
    pages that arrive are then admitted by age while there is room, and the
    rest is shed, the newest first to go. Last, while the queue holds more than
    ``most_bytes``, its least novel pages are shed, of equal ones the oldest.
    A page that comes twice in a batch, or again while it waits, counts once, by
    its first row in order of all columns; rows without a page are left out. Rows
    need ``page_id, created_at, priority, novelty, bytes``; a null novelty is 0,
    null bytes are 0. Decisions are in ``<folder>/decisions`` as
    ``page_id, verdict``, the queue after each batch in ``<folder>/queue``.
    """

    folder: str
    capacity: int
    take: int
    most_bytes: int | None = None

    COLUMNS = ("page_id", "created_at", "priority", "novelty", "bytes")

    def __call__(self, pages: DataFrame, batch: int) -> None:
        spark = pages.sparkSession
        arrived = pages.select(*self.COLUMNS).where("page_id is not null").withColumns({"novelty": F.coalesce("novelty", F.lit(0.0)), "bytes": F.coalesce("bytes", F.lit(0))})
        arrived = arrived.groupBy("page_id").agg(F.min(F.struct(*self.COLUMNS[1:])).alias("_p")).select("page_id", "_p.*")
        queue = _before(spark, f"{self.folder}/queue", batch)
        queue = (spark.createDataFrame([], arrived.schema) if queue is None else queue.select(*self.COLUMNS)).persist()
        claimed = queue.orderBy("priority", "created_at", "page_id").limit(self.take)
        left = queue.join(claimed.select("page_id"), "page_id", "left_anti")
        new = arrived.join(queue.select("page_id"), "page_id", "left_anti").persist()
        admitted = new.orderBy("created_at", "page_id").limit(max(0, self.capacity - max(0, queue.count() - self.take))).persist()
        waiting = left.unionByName(admitted)
        shed = new.join(admitted.select("page_id"), "page_id", "left_anti")
        if self.most_bytes is not None:  # the queue is bounded, so one window over it is too
            best = Window.orderBy(F.desc("novelty"), F.desc("created_at"), F.desc("page_id")).rowsBetween(Window.unboundedPreceding, 0)
            summed = waiting.withColumn("_fits", F.sum("bytes").over(best) <= self.most_bytes)
            waiting, over = summed.where("_fits").drop("_fits"), summed.where("not _fits").drop("_fits")
        else:
            over = waiting.where("false")
        verdicts = [(claimed, "claimed"), (admitted, "admitted"), (shed, "shed"), (over, "evicted")]
        decided = None
        for df, verdict in verdicts:
            own = df.select("page_id", F.lit(verdict).alias("verdict"))
            decided = own if decided is None else decided.unionByName(own)
        decided.write.mode("overwrite").parquet(f"{self.folder}/decisions/batch={batch}")
        waiting.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/queue/batch={batch}")  # last: the batch is whole with it
        _drop(spark, f"{self.folder}/queue", batch - 1)
        for df in (queue, new, admitted):
            df.unpersist()


def admit(pages: DataFrame, admission: Admission, checkpoint: str) -> StreamingQuery:
    """Runs an admission over what a stream of pages has now."""
    return pages.writeStream.foreachBatch(admission).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass
class Chunks:
    """Rolls events over into numbered chunks of ``size`` rows.

    Events are taken in order of ``order``, whose first column is a number, within
    a micro-batch (numbered by stretches of ``stretch`` of it), after those that
    the batches before left over; each ``size`` of them are a chunk, written by
    one task to ``<folder>/chunks/chunk=<number>``, and what remains waits in
    ``<folder>/pending``. A batch that failed is repeated with the same chunk
    numbers, and overwrites them. ``close`` writes the last, short chunk; a stream
    that goes on after it fills that chunk up.
    """

    folder: str
    size: int = 10_000
    order: tuple[str, ...] = ("start_timestamp", "event_id")
    stretch: float = 60.0

    def __call__(self, events: DataFrame, batch: int) -> None:
        self._roll(events, batch, False)

    def close(self, spark: SparkSession) -> None:
        """Writes the events that wait as the last chunk."""
        done = _batches(spark, f"{self.folder}/pending")
        if done:
            held = spark.read.parquet(f"{self.folder}/pending/batch={done[-1]}")
            self._roll(held.drop("_at").where("false"), done[-1] + 1, True)

    def _roll(self, events: DataFrame, batch: int, last: bool) -> None:
        spark = events.sparkSession
        held = _before(spark, f"{self.folder}/pending", batch)
        start = int(held.agg(F.max("_next")).first()[0] or 0) if held is not None else 0
        waiting = held.where("_at is not null").drop("_next") if held is not None else None
        n = waiting.count() if waiting is not None else 0
        rows = numbered(events, list(self.order), F.floor(F.col(self.order[0]) / self.stretch)).withColumn("_at", F.col("_at") + n)
        total = n + rows.count()
        if waiting is not None:
            rows = rows.unionByName(waiting, allowMissingColumns=True)
        full = total if last else total // self.size * self.size
        chunk = (F.lit(start) + F.floor(F.col("_at") / self.size)).cast("long")
        whole = rows.where(F.col("_at") < full).withColumn("chunk", chunk)
        if full:
            parts = whole.repartition(-(-full // self.size), "chunk").sortWithinPartitions("chunk", "_at").drop("_at")
            parts.write.partitionBy("chunk").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.folder}/chunks")
        following = start + -(-full // self.size)
        rest = rows.where(F.col("_at") >= full).withColumn("_at", F.col("_at") - full).withColumn("_next", F.lit(following).cast("long"))
        mark = spark.createDataFrame([(following,)], "_next long")  # keeps the number where nothing waits
        rest.unionByName(mark, allowMissingColumns=True).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/pending/batch={batch}")
        _drop(spark, f"{self.folder}/pending", batch - 1)


def roll(events: DataFrame, chunks: Chunks, checkpoint: str) -> StreamingQuery:
    """Runs a roll-over of what a stream of events has now."""
    return events.writeStream.foreachBatch(chunks).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
