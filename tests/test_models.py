"""Operators against small restatements of their rules, on random and edge inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoscope.functions import scalars, vectors
from chronoscope.operators import consolidate, flow, gestures, intervals, novelty, overlay, paging, scheduling, trackers
from chronoscope.plans import catalogue
from chronoscope.sources import timeline
from conftest import SF


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_topology_random_and_edges(spark):
    rng = random.Random(1)
    ev = [(0, i, (a := rng.randrange(60)), a + rng.choice([0, 1, 5, 20])) for i in range(60)] + [(1, 99, 5, 5)]
    got = {(s, a, b): ids for s, a, b, _, ids in rows(intervals.topology(spark.createDataFrame(ev, "session_id int, event_id int, start int, end int")), "session_id", "start")}
    want = {}
    for s in (0, 1):
        own = [e for e in ev if e[0] == s]
        t = sorted({x for e in own for x in e[2:]})
        for a, b in zip(t, t[1:]):
            ids = sorted(e[1] for e in own if e[2] <= a and e[3] > a)
            if ids:
                want[s, a, b] = ids
    assert got == want


def test_merge_touching_nested_single(spark):
    d = spark.createDataFrame([(0, 5, 9), (0, 1, 3), (0, 3, 4), (0, 6, 7), (1, 2, 2)], "session_id int, start int, end int")
    assert rows(intervals.merge(d).select("session_id", "start", "end", "n"), "session_id", "start") == [(0, 1, 4, 2), (0, 5, 9, 2), (1, 2, 2, 1)]


def test_band_join_is_inclusive(spark):
    rng = random.Random(2)
    iv = [(i % 3, (a := rng.randrange(200)), a + rng.randrange(30)) for i in range(30)]
    pt = [(i % 3, rng.randrange(230)) for i in range(100)]
    got = intervals.band_join(spark.createDataFrame(iv, "session_id int, start int, end int"), spark.createDataFrame(pt, "session_id int, us int"), "us", 10)
    assert sorted(tuple(r) for r in got.select("session_id", "start", "end", "us").collect()) == sorted((s, a, b, t) for s, a, b in iv for q, t in pt if s == q and a <= t <= b)


def test_band_join_of_long_intervals(spark):
    rng = random.Random(8)
    spans = [(0, i, a, a + rng.choice([0, 1, 10, 300, 5_000, 10**6])) for i in range(60) for a in [rng.randint(-2000, 2000)]]
    points = [(0, rng.randint(-3000, 10**6)) for _ in range(300)]
    iv, p = spark.createDataFrame(spans, "session_id int, id int, start long, end long"), spark.createDataFrame(points, "session_id int, us long")
    got = sorted((r["id"], r["us"]) for r in intervals.band_join(iv, p, "us", 10).collect())
    assert got == sorted((i, t) for _, i, a, b in spans for _, t in points if a <= t <= b)
    assert intervals.band_join(iv.where("false"), p, "us", 10).count() == 0


def test_consolidate(spark):
    chunk = spark.createDataFrame([("a", 1), ("b", 2)], "event_id string, v int")
    tail = spark.createDataFrame([("b", 2, "w"), ("c", 3, "w")], "event_id string, v int, ctx string")
    assert rows(consolidate.consolidate(chunk, tail).select("event_id", "v", "origin", "ctx"), "event_id") == [("a", 1, "chunk", None), ("b", 2, "chunk", None), ("c", 3, "journal", "w")]
    assert consolidate.consolidate(chunk.where("false"), tail.where("false")).count() == 0


def test_scroll_gap_equal_merges_and_zero_is_a_sign(spark):
    t = spark.createDataFrame([(0, 1, 0, 1), (0, 2, 300, 0), (0, 3, 601, -1), (0, 4, 700, -2)], "session_id int, event_id int, us int, dy int")
    assert rows(gestures.scroll_gestures(t, 300).select("session_no", "start", "end", "total_dy", "reversals"), "session_no") == [(1, 0, 300, 1, 1), (2, 601, 700, -3, 0)]


def test_key_holds(spark):
    p = spark.createDataFrame([(0, i, u, a) for i, (u, a) in enumerate([(1, "R"), (2, "P"), (3, "P"), (5, "R"), (6, "R"), (9, "P")])], "session_id int, event_id int, us int, action string")
    assert rows(gestures.key_holds(p, ["session_id"]), "pressed") == [(0, 2, 5, 3)]


def test_focus_gate(spark):
    e = spark.createDataFrame([(0, 1, "press"), (0, 5, "press"), (0, 8, "release")], "session_id int, us int, kind string")
    s = spark.createDataFrame([(0, 4, True), (0, 7, False)], "session_id int, us int, focused boolean")
    assert rows(gestures.focus_gate(e, s).select("us", "focused"), "us") == [(5, True), (8, False)]


def plain_trajectories(moves, interval=0.0111, timeout=0.2):
    """The state machine, event by event."""
    out, cur = [], None

    def end(at):
        p = cur["p"]
        path = sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(p, p[1:]))
        if len(p) > 1 and path >= 10:
            direct = np.hypot(p[0][0] - p[-1][0], p[0][1] - p[-1][1])
            out.append((cur["t0"], at, p[0][0], p[-1][0], cur["b"], path, direct / path if len(p) > 2 and direct >= 1 else 1.0))

    new = lambda t, x, y, b: {"t0": t, "p": [(x, y)], "b": b, "last": (x, y), "moved": t, "sampled": t}
    for t, x, y, b in moves:
        if cur is None:
            cur = new(t, x, y, b)
            continue
        if b != cur["b"]:
            end(t)
            cur = new(t, x, y, b)
            continue
        if np.hypot(x - cur["last"][0], y - cur["last"][1]) < 2:
            if t - cur["moved"] > timeout:
                end(t)
                cur = None
                continue
        else:
            cur["moved"] = t
        if t - cur["sampled"] >= interval:
            cur["p"].append((x, y))
            cur["sampled"] = t
        cur["last"] = (x, y)
    if cur:
        end(moves[-1][0])
    return out


def test_trajectories(spark):
    rng = random.Random(6)
    every, want = [], {}
    for s in range(4):
        t, x, y, b, own = 0.0, 0, 0, None, []
        for _ in range(300):
            t = round(t + rng.choice([0.0, 0.005, 0.012, 0.05, 0.3]), 4)
            if rng.random() < 0.7:
                x, y = x + rng.randrange(-9, 12), y + rng.randrange(-9, 12)
            if rng.random() < 0.05:
                b = None if b else "left"
            own.append((t, x, y, b))
        every += [(s, *m, i) for i, m in enumerate(own)]
        want[s] = plain_trajectories(own)
    rng.shuffle(every)
    df = spark.createDataFrame(every, "session_id long, ts double, x int, y int, button string, event_id int")
    got = rows(gestures.trajectories(df).select("session_id", "start", "end", "x0", "x1", "button", "distance", "linearity"), "session_id", "start")
    flat = [(s, *r) for s in want for r in sorted(want[s], key=lambda r: r[0])]
    assert len(got) == len(flat) > 20
    for a, b in zip(got, flat):
        assert a[:6] == b[:6] and a[6:] == pytest.approx(b[6:])


def test_flow_buckets_do_not_matter(spark):
    rng = random.Random(7)
    f = spark.createDataFrame([(rng.choice("ab"), i, rng.randrange(-200, 400), rng.randrange(-9, 9)) for i in range(400)], "stage string, event_id int, us long, net long")
    one, many = (rows(flow.levels(f, bucket_us=b).select("event_id", "level"), "event_id") for b in (10**6, 7))
    assert one == many
    one, many = (rows(flow.rates(f, 30, bucket_us=b).select("event_id", "rate", "n_window", "span_us"), "event_id") for b in (10**6, 7))
    assert one == many


@pytest.mark.parametrize("window", [1, 2, 9, 30])
def test_rates_against_plain_windows(spark, window):
    """Times that repeat, gaps longer than a window, nets that are null, and buckets as long as a window or longer."""
    rng = random.Random(window)
    every = [(rng.choice("ab"), i, rng.choice([rng.randrange(-50, 60), 7, 300 + rng.randrange(9)]), rng.choice([None, *range(-9, 9)])) for i in range(300)]
    f = spark.createDataFrame(every, "stage string, event_id int, us long, net long")
    want = []
    for stage, i, us, _ in every:
        own = [(t, n) for s, _, t, n in every if s == stage and us - window < t <= us]
        known = [n for _, n in own if n is not None]
        want.append((i, sum(known) / (window / 1_000_000) if known else None, len(own), us - min(t for t, _ in own)))
    for b in (1, 7, 64, 10**6):
        assert rows(flow.rates(f, window, bucket_us=b).select("event_id", "rate", "n_window", "span_us"), "event_id") == want


@pytest.mark.parametrize("name", ["q_flow_rate", "q_unsustainable", "q_overflow_eta", "q_shed_pages", "q_forced_refinement"])
def test_rates_take_one_pass(spark, name):
    """A frame that slides adds up its rows anew for each row."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan


@pytest.mark.parametrize("n", [1, 7, 8, 16])
def test_pages(spark, n):
    f = spark.range(n).select(F.lit(0).alias("session_id"), F.col("id").alias("us"), F.col("id").alias("event_id"))
    assert paging.pages(f, 8).count() == n // 8 * 8
    assert paging.pages(f, 8, partial=True).count() == n


@pytest.mark.parametrize("target", [5, 10, 30])
def test_decimate(spark, target):
    f = spark.range(31).select(F.lit(0).alias("session_id"), (F.col("id") * 100_000).alias("us"), F.col("id").alias("event_id"))
    step = -(-10 // target) if target < 10 else 1
    assert [r[0] for r in rows(paging.decimate(f, target).select("event_id"), "event_id")] == list(range(0, 31, step))


def test_running_z_with_and_without_the_batch(spark):
    rng = np.random.default_rng(0)
    data = [(0, i // 4, float(x)) for i, x in enumerate(rng.random(20))]
    d = spark.createDataFrame(data, "k int, b int, score double")
    for current in (True, False):
        for _, b, s, z in [tuple(r) for r in novelty.running_z(d, ["k"], "b", current).select("k", "b", "score", "z").collect()]:
            seen = np.array([x for _, c, x in data if c <= b - (not current)])
            want = (s - seen.mean()) / (seen.std() + 1e-8) if len(seen) > 1 and seen.std() > 0 else 0.0
            assert z == pytest.approx(want, abs=1e-9)


def test_running_z_without_variance_or_with_nan(spark):
    d = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 2, float("nan")), (0, 3, 1.0)], "k int, b int, score double")
    assert [r["z"] for r in novelty.running_z(d, ["k"], "b").orderBy("b").collect()] == [0.0] * 4


def test_drift_of_zero_and_first_vectors(spark):
    d = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [-1.0, 0.0])], "k int, frame int, embedding array<double>")
    assert [round(r["score"], 9) for r in novelty.drift(d, ["k"]).orderBy("frame").collect()] == [0.0, 1.0, 2.0]


def test_incremental_pca_agrees_with_svd():
    x = np.random.default_rng(3).normal(size=(200, 12))
    p = trackers.PcaTracker(12)
    assert (p.scores(x) == 0).all()
    for i in range(0, 200, 40):
        p.update(x[i : i + 40])
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(p.singular, s) and np.allclose(p.mean, x.mean(0))


def test_batch_pca_mahalanobis(spark):
    x = np.random.default_rng(4).normal(size=(60, 5))
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "frame int, embedding array<double>")
    got = [r["score"] for r in novelty.pca_mahalanobis(d, 3).orderBy("frame").collect()]
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    plain = lambda k: np.sqrt(((c @ vt[:k].T) ** 2 / (s[:k] ** 2 / 59 + 1e-8)).sum(1))
    assert np.allclose(got, plain(3))
    assert (s[:2] ** 2).sum() / (s**2).sum() < 0.67 <= (s[:3] ** 2).sum() / (s**2).sum()
    some = [r["score"] for r in novelty.pca_mahalanobis(d, 5, 0.67).orderBy("frame").collect()]
    assert np.allclose(some, plain(3))


def test_levels_never_fall_below_zero(spark):
    rng = random.Random(5)
    net = [rng.randrange(-10, 10) for _ in range(200)]
    d = spark.createDataFrame([("s", i, i, v) for i, v in enumerate(net)], "stage string, event_id int, us int, net int")
    level, want = 0, []
    for v in net:
        level = max(0, level + v)
        want.append(level)
    assert [r["level"] for r in flow.levels(d).orderBy("us").collect()] == want


def test_rate_leaves_out_the_cutoff(spark):
    d = spark.createDataFrame([("s", i, u, 10) for i, u in enumerate([0, 5_000_000, 5_000_001])], "stage string, event_id int, us long, net int")
    assert [r["rate"] for r in flow.rates(d, 5_000_000).orderBy("us").collect()] == [2.0, 2.0, 4.0]


def test_overflow_eta(spark):
    d = spark.createDataFrame([(10, 1.0), (5, 0.0), (5, -1.0), (5, 2.0)], "level int, rate double").select(scalars.overflow_eta(F.col("level"), F.col("rate"), F.lit(10)).alias("e"))
    assert [r["e"] for r in d.collect()] == [0.0, -1.0, -1.0, 2.5]


def test_schedule_boundaries(spark):
    d = spark.range(8).select(scalars.scheduled(F.col("id"), F.lit(0.0), F.lit(4.0), F.lit(2), F.lit(4)).alias("a"), scalars.scheduled(F.col("id"), F.lit(1.0), F.lit(2.0), F.lit(0), F.lit(0)).alias("b"))
    assert [r["a"] for r in d.collect()] == [0, 0, 0, 1, 2, 3, 4, 4]
    assert [r["b"] for r in d.collect()] == [2.0] * 8


@pytest.mark.parametrize("k", [4, 6, 8])
def test_linspace(spark, k):
    d = spark.range(2, 300, 7).select("id", vectors.linspace(F.lit(0), F.col("id") - 1, k).alias("x"))
    for n, x in d.collect():
        assert x == np.linspace(0, n - 1, k, dtype=int).tolist()


def test_heatmap_takes_the_largest(spark):
    p = spark.createDataFrame([(0, 5, 5, 2, 1.0), (0, 6, 5, 1, 5.0), (0, 0, 0, 2, 1.0)], "k int, x int, y int, radius int, weight double")
    got = {(x, y): v for _, x, y, v in rows(overlay.heatmap(p, 8, 8, ["k"]), "x")}
    want = {}
    for _, x, y, r, w in [tuple(q) for q in p.collect()]:
        for dx in range(-r, r + 1):
            for dy in range(-r, r + 1):
                if dx * dx + dy * dy <= r * r and 0 <= x + dx < 8 and 0 <= y + dy < 8:
                    want[x + dx, y + dy] = max(w, want.get((x + dx, y + dy), 0))
    assert got == want


def test_payload_defaults(spark):
    e = spark.createDataFrame([("a", "USER_INPUT", 1.0, None, '{"type":"mouse_click"}'), ("b", "USER_INPUT", 1.0, 0.5, '{"type":"key","key":"\'a\'"}'), ("c", "USER_INPUT", 1.0, 0.5, "not json"), ("d", "X", 1.0, 0.5, "{}"), ("e", "USER_INPUT", 2.0, 1.0, '{"type":"key","key":"Key.shift"}')], timeline.EVENT)
    p = overlay.parsed(e)
    assert rows(overlay.clicks(p), "event_id") == [("a", 1.0, "unknown", 0, 0)]
    assert rows(overlay.keys(p).select("event_id", "key", "label"), "event_id") == [("b", "a", "A"), ("e", "Key.shift", "SHIFT")]
    assert overlay.scrolls(p).count() == overlay.mouse_paths(p).count() == 0


def test_eviction_order_and_ages(spark):
    d = spark.createDataFrame([(1, "INTERESTING_RETAINED", 0, None), (2, "INTERESTING_RETAINED", 0, 0.5), (3, "INTERESTING_RETAINED", 70, 0.1), (4, "TRIAGING", 0, 0.0)], "page_id int, state string, last_activity int, novelty double")
    assert [r["page_id"] for r in scheduling.evict(d, 100, 30).collect()] == [1, 2]


def test_match_mode():
    assert [scalars.match_mode(t) for t in ("game.EXE", "a/b", "c\\d", "My Game")] == ["exe", "exe", "exe", "title"]


def test_journal_modes(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"event_id":"a","start_timestamp":1.0}\nbroken\n{"event_id":"b","window_context":{"pid":3}}\n')
    got = timeline.read_journal(spark, str(tmp_path / "j.jsonl"), strict=False)
    assert rows(got.select("event_id", "window_context.pid"), "event_id") == [("a", None), ("b", 3)]
    with pytest.raises(Exception, match="[Mm]alformed|FAILFAST"):
        timeline.read_journal(spark, str(tmp_path / "j.jsonl")).collect()


def test_recordings(spark):
    f = spark.createDataFrame([("r", "b.mp4"), ("r", "baseline_record_12.5.mp4"), ("s", "z.mp4"), ("s", "a.txt")], "folder string, name string")
    got = timeline.find_recording(f).select("folder", timeline.recording_start(F.col("name")).alias("t"))
    assert rows(got, "folder") == [("r", 12.5), ("s", 0.0)]
