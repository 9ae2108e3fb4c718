"""Admission, roll-over and gauges against plain loops, with failures and restarts."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_timers import files

from chronoscope.operators import scheduling
from chronoscope.streaming import gauges, sinks

PAGE = "page_id long, created_at double, priority double, novelty double, bytes long"


def arrivals(seed, n=9):
    rng, out = random.Random(seed), []
    for b in range(n):
        k = rng.choice([0, 1, 3, 8])
        out.append([(b * 100 + i, b + rng.random(), rng.choice([0.0, 1.0]), rng.choice([None, round(rng.random(), 2)]), rng.choice([None, 10, 20])) for i in range(k)])
    out[3].append(out[3][0] if out[3] else (333, 3.0, 0.0, 0.5, 10))
    out[4].append((444, 4.0, 0.0, 0.5, 10))
    out[5].append((444, 4.0, 0.0, 0.5, 10))
    return [b or [(b_ * 100 + 77, float(b_), 0.0, 0.1, 5)] for b_, b in enumerate(out)]


def plain_admission(batches, capacity, take, most):
    queue, out = {}, []
    for b, rows in enumerate(batches):
        due = sorted(queue.values(), key=lambda r: (r[2], r[1], r[0]))[:take]
        was = set(queue)
        for r in due:
            out.append((b, r[0], "claimed"))
            del queue[r[0]]
        new = {r[0]: (*r[:3], r[3] or 0.0, r[4] or 0) for r in rows if r[0] not in was}
        for k, r in enumerate(sorted(new.values(), key=lambda r: (r[1], r[0]))):
            fits = len(queue) < capacity
            out.append((b, r[0], "admitted" if fits else "shed"))
            if fits:
                queue[r[0]] = r
        while most is not None and sum(r[4] for r in queue.values()) > most:
            least = min(queue.values(), key=lambda r: (r[3], r[1], r[0]))
            out.append((b, least[0], "evicted"))
            del queue[least[0]]
    return sorted(out)


def decided(spark, folder):
    return sorted((r["batch"], r["page_id"], r["verdict"]) for r in spark.read.parquet(f"{folder}/decisions").collect())


@pytest.mark.parametrize("most", [None, 70])
def test_admission_of_a_stream(spark, tmp_path, most):
    batches = arrivals(1)
    a = sinks.Admission(str(tmp_path / "q"), 5, 2, most)
    sinks.admit(files(spark, tmp_path, batches, PAGE), a, str(tmp_path / "cp")).awaitTermination(240)
    got, want = decided(spark, a.folder), plain_admission(batches, 5, 2, most)
    assert got == want and {v for *_, v in want} >= {"claimed", "admitted", "shed"}
    assert most is None or any(v == "evicted" for *_, v in want)


def test_admission_repeats_nothing_after_a_failure(spark, tmp_path):
    batches, stream = arrivals(2), None
    stream = files(spark, tmp_path, batches, PAGE)
    a, failed = sinks.Admission(str(tmp_path / "q"), 5, 2), []

    def fails(df, batch):
        a(df, batch)
        if batch == 3 and not failed:
            failed.append(batch)
            raise RuntimeError("after the batch was written")

    q = stream.writeStream.foreachBatch(fails).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="after the batch"):
        q.awaitTermination(240)
    stream.writeStream.foreachBatch(fails).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    assert failed and decided(spark, a.folder) == plain_admission(batches, 5, 2, None)


EVENT = "event_id string, start_timestamp double, payload string"


def chunks_of(spark, folder):
    rows = spark.read.parquet(f"{folder}/chunks").withColumn("f", F.input_file_name()).collect()
    out, names = {}, {}
    for r in rows:
        out.setdefault(r["chunk"], []).append((r["start_timestamp"], r["event_id"]))
        names.setdefault(r["chunk"], set()).add(r["f"])
    assert all(len(v) == 1 for v in names.values())
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("when", ["chunks", "end"])
def test_roll_over_of_a_batch_that_fails_once(spark, tmp_path, monkeypatch, when):
    rng = random.Random(3)
    batches = [[(f"{b}-{i}", b * 10 + rng.random(), "x") for i in range(rng.choice([2, 7, 23, 40]))] for b in range(6)]
    want = sorted(((t, e) for b in batches for e, t, _ in b))
    c, failed = sinks.Chunks(str(tmp_path / "c"), 10), []

    def fails(df, batch):
        if batch == 2 and not failed and when == "chunks":  # chunks are written, what waits is not
            failed.append(batch)
            whole = sinks.Chunks._roll
            monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("broken")))
            try:
                whole(c, df, batch, False)
            finally:
                monkeypatch.undo()
        c(df, batch)
        if batch == 2 and not failed:
            failed.append(batch)
            raise RuntimeError("broken")

    stream = files(spark, tmp_path, batches, EVENT)
    start = lambda: stream.writeStream.foreachBatch(fails).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="broken"):
        start().awaitTermination(240)
    start().awaitTermination(240)
    got = chunks_of(spark, c.folder)
    assert failed and got == {k: want[k * 10 : k * 10 + 10] for k in range(len(want) // 10)}
    c.close(spark)
    got = chunks_of(spark, c.folder)
    assert got == {k: want[k * 10 : k * 10 + 10] for k in range(-(-len(want) // 10))}
    more = [(f"6-{i}", 60 + rng.random(), "x") for i in range(15)]
    spark.createDataFrame(more, EVENT).coalesce(1).write.parquet(f"{tmp_path}/tmp6")
    next((tmp_path / "tmp6").glob("part-*")).rename(tmp_path / "in" / "0006.parquet")
    start().awaitTermination(240)
    c.close(spark)
    want = sorted(want + [(t, e) for e, t, _ in more])
    assert chunks_of(spark, c.folder) == {k: want[k * 10 : k * 10 + 10] for k in range(-(-len(want) // 10))}
    assert len(list((tmp_path / "c" / "pending").glob("batch=*"))) <= 2


def test_gauges_agree_with_a_group_by(spark, tmp_path):
    rng, rows, n = random.Random(4), [], 0
    for page in range(40):
        state = None
        for _ in range(rng.randint(1, 8)):
            nexts = [t for f, t in scheduling.STEPS if f == state]
            if not nexts:
                break
            was, state, n = state, rng.choice(nexts), n + 1
            rows.append((page, n, state, was))
    schema = "page_id long, seq long, state string, was string"
    g = gauges.Gauges()
    spark.streams.addListener(g)
    try:
        stream = files(spark, tmp_path, [rows[i : i + 25] for i in range(0, len(rows), 25)], schema)
        for _ in range(2):  # the second start has nothing new to count
            q = gauges.observed(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(240)
        plain = lambda f: sum(1 for _, _, s, w in rows if f(s, w))
        want = {
            "moves": len(rows), "triaged": plain(lambda s, w: w == "TRIAGING"), "retained": plain(lambda s, w: w == "TRIAGING" and s == "INTERESTING_RETAINED"),
            "evicted_boring": plain(lambda s, w: s == "BORING_EVICTING"), "evicted": plain(lambda s, w: s == "EVICTED"),
        }
        for _ in range(100):
            if g.totals() == want:
                break
            time.sleep(0.2)
        assert g.totals() == want
    finally:
        spark.streams.removeListener(g)
    text = gauges.line(want, {"REFINING": 2, "EVICTED": 0})
    assert text.endswith("states: REFINING:2") and f"triaged: {want['triaged']}" in text
    assert spark.createDataFrame(rows, schema).agg(*gauges.counters()).first().asDict() == want
