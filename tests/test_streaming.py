"""Streams give what the batch operators give."""

import datetime as dt

from pyspark.sql import functions as F

from chronoscope.operators import gestures, paging
from chronoscope.streaming import stateful


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark, df, path, files=3):
    df.repartition(files).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_pages(spark, tmp_path):
    f = spark.range(100).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("frame"))
    got = drain(spark, stateful.pages(stream(spark, f, tmp_path / "f"), 8), "pages")
    batch = paging.pages(f.withColumnRenamed("frame", "us").withColumn("event_id", F.col("us")), 8).select("session_id", "page").distinct()
    assert sorted(tuple(r) for r in got.select("session_id", "page").collect()) == sorted(tuple(r) for r in batch.collect())


def test_key_holds(spark, tmp_path):
    p = spark.range(60).select((F.col("id") % 2).alias("session_id"), F.lit("k").alias("key"), F.col("id").alias("us"), F.when(F.col("id") % 5 < 3, "P").otherwise("R").alias("action"))
    got = drain(spark, stateful.key_holds(stream(spark, p, tmp_path / "k", 1)), "holds")
    batch = gestures.key_holds(p.withColumn("event_id", F.col("us")), ["session_id", "key"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r)[:4] for r in batch.collect())


def test_scroll_sessions(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    data = [(0, i, ms, d) for i, (ms, d) in enumerate([(0, 1), (300, 1), (601, -1), (700, 1), (60_000, 1)])]
    b = spark.createDataFrame([(s, e, t0 + dt.timedelta(milliseconds=ms), d) for s, e, ms, d in data], "session_id long, event_id long, ts timestamp, dy int")
    got = drain(spark, stateful.scroll_gestures(stream(spark, b, tmp_path / "s", 1)), "scrolls")
    batch = gestures.scroll_gestures(b.withColumn("us", F.unix_micros("ts")), 300_000)
    want = sorted((r["total_dy"], r["n_ticks"]) for r in batch.collect())
    assert set((r["total_dy"], r["n_ticks"]) for r in got.collect()) <= set(want)
    assert (2, 2) in {(r["total_dy"], r["n_ticks"]) for r in got.collect()}  # the tick just at the gap belongs


def test_journal_drops_repeats(spark, tmp_path):
    e = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 1))], "event_id string, ts timestamp")
    q = stateful.write_journal(stateful.journal(stream(spark, e, tmp_path / "e")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r["event_id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b"]
