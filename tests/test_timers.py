"""Stream operators with timers against their batch forms and plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronoscope.operators import gestures, scheduling
from chronoscope.streaming import timers

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def store(spark):
    old = {k: spark.conf.get(k) for k in timers.STORE}
    for k, v in timers.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def files(spark, path, batches, schema):
    """A file source with one file a micro-batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/tmp{i}")
        part = next((path / f"tmp{i}").glob("part-*"))
        (path / "in").mkdir(exist_ok=True)
        part.rename(path / "in" / f"{i:04d}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


def run(df, path, name="out", checkpoint="cp"):
    q = df.writeStream.format("parquet").option("path", str(path / name)).option("checkpointLocation", str(path / checkpoint)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


MOVE = "session_id long, event_id long, ts timestamp, x int, y int, button string, focused boolean"


def walk(seed):
    rng, rows, n = random.Random(seed), [], 0
    for s in range(3):
        t, x, y, button, focus = rng.random(), 500, 500, None, True
        for _ in range(120):
            t += rng.choice([0.005, 0.012, 0.012, 0.02, 0.25])
            if rng.random() < 0.7:
                x, y = x + rng.randint(-30, 30), y + rng.randint(-30, 30)
            button = rng.choice(["left", None]) if rng.random() < 0.05 else button
            focus = not focus if rng.random() < 0.06 else focus
            rows.append((s, n, at(round(t, 3)), x, y, button, focus))
            n += 1
    return rows


def key(r):
    return tuple(str(r[c]) for c in ("session_id", "start", "end", "x0", "y0", "x1", "y1", "button", "points"))


def test_stream_of_moves_equals_the_batch(store, tmp_path):
    rows = walk(3)
    order = sorted(rows, key=lambda r: (r[2] + dt.timedelta(seconds=random.Random(r[1]).random()), r[1]))  # up to a second out of order
    batches = [order[i : i + 60] for i in range(0, len(order), 60)]
    batches += [[(99, 9999, at(9000), 0, 0, None, True)], [(99, 10000, at(9001), 0, 0, None, True)]]  # time goes on
    run(timers.trajectories(files(store, tmp_path, batches, MOVE), late="5 seconds", idle=600.0), tmp_path)
    got = sorted(map(key, store.read.parquet(str(tmp_path / "out")).collect()))
    batch = gestures.trajectories(store.createDataFrame(rows, MOVE).withColumn("ts", F.unix_micros("ts") / 1e6))
    want = sorted(map(key, batch.collect()))
    assert len(want) > 10 and got == want
    ends = {s: max(r[2] for r in rows if r[0] == s) for s in range(3)}
    assert any(k[2] == str(ends[int(k[0])].replace(tzinfo=dt.timezone.utc).timestamp()) for k in got)  # an open one is among them


def test_stream_of_moves_goes_on_after_a_restart(store, tmp_path):
    rows = walk(4)
    order = sorted(rows, key=lambda r: r[2])
    batches = [order[i : i + 90] for i in range(0, len(order), 90)] + [[(99, 9999, at(9000), 0, 0, None, True)], [(99, 10000, at(9001), 0, 0, None, True)]]
    half = files(store, tmp_path, batches[:2], MOVE)
    run(timers.trajectories(half, idle=600.0), tmp_path)
    for i, b in enumerate(batches[2:], 2):
        store.createDataFrame(b, MOVE).coalesce(1).write.parquet(f"{tmp_path}/tmp{i}")
        next((tmp_path / f"tmp{i}").glob("part-*")).rename(tmp_path / "in" / f"{i:04d}.parquet")
    run(timers.trajectories(half, idle=600.0), tmp_path)
    got = sorted(map(key, store.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(key, gestures.trajectories(store.createDataFrame(rows, MOVE).withColumn("ts", F.unix_micros("ts") / 1e6)).collect()))


def plain_focus(rows, samples):
    """Trajectories row by row: a move without focus ends the open one, and joins none."""
    out = []
    for s in sorted({r[0] for r in rows}):
        t, mine = gestures.Trajectory(0.0111, 0.2, 10.0), sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1]))
        for r in mine:
            known = [f for u, f in sorted(samples[s]) if u <= r[2]]
            if known and known[-1]:
                out += t.feed(s, r[2].timestamp(), r[3], r[4], r[5])
                continue
            out.append(t.finish(r[2].timestamp()))
            t.seen = r[2].timestamp()
        out.append(t.finish(t.seen))
    return sorted((r[0], r[3:7], r[7], round(r[8], 6)) for r in out if r)


def test_focus_loss_ends_a_trajectory_at_the_next_move(spark):
    rows = [r[:6] for r in walk(5)]
    rng = random.Random(6)
    samples = {s: [(at(k * 0.7 + rng.random() / 3), rng.random() < 0.6) for k in range(12)] for s in range(3)}
    moves = spark.createDataFrame(rows, MOVE.rpartition(",")[0]).withColumn("ts", F.unix_micros("ts") / 1e6)
    polled = spark.createDataFrame([(s, u, f) for s, x in samples.items() for u, f in x], "session_id long, ts timestamp, focused boolean").withColumn("ts", F.unix_micros("ts") / 1e6)
    got = sorted((r["session_id"], (r["x0"], r["y0"], r["x1"], r["y1"]), r["button"], round(r["distance"], 6)) for r in gestures.focused_trajectories(moves, polled).collect())
    want = plain_focus(rows, samples)
    assert len(want) > 5 and [(*g[:2], g[3]) for g in got] == [(w[0], tuple(w[1]), w[3]) for w in want]
    assert gestures.focused_trajectories(moves, polled.where("false")).count() == 0


SIGN = "block long, ts timestamp"


def plain_abandoned(signs, end, deadline=30):
    out = []
    for b in {b for b, _ in signs}:
        times = sorted(t for x, t in signs if x == b)
        n = 0
        for t, after in zip(times, [*times[1:], end]):
            n += 1
            if after - t > deadline:
                out.append((b, t, n))
                n = 0
    return sorted(out)


def test_a_silent_block_is_given_out_once(store, tmp_path):
    rng = random.Random(8)
    signs, t = [], 0.0
    for _ in range(150):
        t += rng.choice([0.5, 1, 2, 9])
        signs.append((rng.randrange(12), round(t, 3)))
    signs += [(50, 3.0), (51, 4.0), (51, 34.0)]
    signs.sort(key=lambda x: x[1])
    batches = [[(b, at(u)) for b, u in signs[i : i + 10]] for i in range(0, len(signs), 10)]
    batches += [[(99, at(t + 500))], [(99, at(t + 501))]]
    half = files(store, tmp_path, batches[:7], SIGN)
    run(timers.abandoned(half, late="1 second"), tmp_path)
    for i, b in enumerate(batches[7:], 7):
        store.createDataFrame(b, SIGN).coalesce(1).write.parquet(f"{tmp_path}/tmp{i}")
        next((tmp_path / f"tmp{i}").glob("part-*")).rename(tmp_path / "in" / f"{i:04d}.parquet")
    run(timers.abandoned(half, late="1 second"), tmp_path)  # a restart gives nothing out again
    base = T0.replace(tzinfo=dt.timezone.utc).timestamp()
    got = sorted((r["block"], round(r["last_seen"] - base, 3), r["n_signs"]) for r in store.read.parquet(str(tmp_path / "out")).collect())
    assert got == plain_abandoned(signs, t + 500) and (50, 3.0, 1) in got and (51, 34.0, 2) in got
    batch = scheduling.silences(store.createDataFrame(signs, "block long, us double"), 30.0, t + 500)
    assert got == sorted((r["block"], r["last_seen"], r["n_signs"]) for r in batch.collect())
