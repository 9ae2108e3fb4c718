"""Chunks, journals and the consolidated table: written, read again, recovered."""

from pyspark.sql import functions as F

from chronoscope.functions import scalars
from chronoscope.operators import consolidate, overlay
from chronoscope.sources import timeline

ROWS = [(f"e{i}", "USER_INPUT", float(i), 0.5, f'{{"type":"key","key":"k{i}"}}') for i in range(25)]


def test_chunks_have_a_fixed_schema_and_their_file(spark, tmp_path):
    for n, part in enumerate((ROWS[:10], ROWS[10:20])):
        spark.createDataFrame(part, timeline.EVENT).withColumn("more", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / f"events_chunk_{n:04d}.parquet"))
    got = timeline.read_chunks(spark, str(tmp_path / "events_chunk_*.parquet"))
    assert got.columns == [*(f.split()[0] for f in timeline.EVENT.split(", ")), "source_file"]
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r[0] for r in ROWS[:20]) and got.select("source_file").distinct().count() == 2


def test_a_run_is_recovered_from_chunks_and_journal(spark, tmp_path):
    chunks = spark.createDataFrame(ROWS[:20], timeline.EVENT)
    (tmp_path / "j.jsonl").write_text("\n".join(f'{{"event_id":"{r[0]}","stream_type":"{r[1]}","start_timestamp":{r[2]},"delta_timestamp":{r[3]},"payload_json":"{{}}","window_context":{{"pid":{i}}}}}' for i, r in enumerate(ROWS)) + "\n{broken")
    journal = timeline.read_journal(spark, str(tmp_path / "j.jsonl"), strict=False).where("event_id is not null")
    consolidate.write_consolidated(consolidate.consolidate(chunks, journal), str(tmp_path / "events_complete.parquet"), rows_per_file=7)
    got = consolidate.read_consolidated(spark, str(tmp_path / "events_complete.parquet"))
    rows = {r["event_id"]: (r["origin"], r["window_context"] and r["window_context"]["pid"]) for r in got.collect()}
    assert rows == {r[0]: ("chunk", None) if i < 20 else ("journal", i) for i, r in enumerate(ROWS)}
    assert max(r["count"] for r in got.groupBy(F.input_file_name()).count().collect()) <= 7
    consolidate.write_consolidated(chunks, str(tmp_path / "events_complete.parquet"))  # a second run takes the place of the first
    assert consolidate.read_consolidated(spark, str(tmp_path / "events_complete.parquet")).count() == 20
    assert consolidate.consolidate(chunks.where("false"), journal).count() == 25 == overlay.keys(overlay.parsed(spark.createDataFrame(ROWS, timeline.EVENT))).count()


def test_merged_maps(spark):
    d = spark.sql("select map('a', '1', 'b', '2') as x, map('b', '3') as y, cast(null as map<string,string>) as z")
    got = d.select(scalars.merged(F.col("x"), F.col("y")), scalars.merged(F.col("x"), F.col("z")), scalars.merged(F.col("z"), F.col("z"))).first()
    assert list(got) == [{"a": "1", "b": "3"}, {"a": "1", "b": "2"}, {}]


def test_names_round_half_up(spark):
    d = spark.sql("select 1234565000L as us union all select 999995L union all select 0L").select(scalars.clip_name(F.col("us"), F.lit("hq")), scalars.still_path(F.lit("OCR"), F.col("us")))
    assert [tuple(r) for r in d.collect()] == [("clip_1234.57_hq.mp4", "stills/OCR_1234.5650.png"), ("clip_1.00_hq.mp4", "stills/OCR_1.0000.png"), ("clip_0.00_hq.mp4", "stills/OCR_0.0000.png")]
