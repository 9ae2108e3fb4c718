"""The registered timeline queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars, vectors
from ..operators import consolidate, flow, gestures, intervals, novelty, overlay, paging, scheduling, search, triage
from ..sources import timeline as src
from ..streaming import gauges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HOUR = 3_600_000_000

#: Logical tables of the SQL side.
TL = """tl AS (SELECT user_id AS session_id, event_id, event_type AS stream_type, epoch_us(ts) AS s, epoch_us(ts) + CASE WHEN event_type = 'click' THEN 0 ELSE round(value * 1000000)::BIGINT END AS e, value, props FROM events)"""
FLOW = """fl AS (SELECT event_type AS stage, event_id, epoch_us(ts) AS us, CASE WHEN event_id % 2 = 1 THEN -round(value * 100)::BIGINT ELSE round(value * 100)::BIGINT END AS net FROM events)"""
TICKS = """tk AS (SELECT user_id AS session_id, event_id, epoch_us(ts) AS us, sign(json_extract_string(props, '$.k')::INTEGER - 50)::INTEGER AS dy FROM events)"""
LATENTS = """lt AS (SELECT vec_id // 50 AS page, vec_id AS frame, embedding::DOUBLE[] AS v, label FROM embeddings)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


# --- intervals


@query(f"""WITH {TL}, bp AS (SELECT DISTINCT session_id, t FROM (SELECT session_id, s AS t FROM tl UNION ALL SELECT session_id, e FROM tl)),
iv AS (SELECT session_id, t AS a, lead(t) OVER (PARTITION BY session_id ORDER BY t) AS b FROM bp)
SELECT iv.session_id, a AS start_us, b AS end_us, count(*) AS n_active, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS event_ids
FROM iv JOIN tl ON tl.session_id = iv.session_id AND s <= a AND e > a WHERE b IS NOT NULL GROUP BY ALL""")
def q_topology_counts(spark, sf):
    t = intervals.topology(src.timeline(spark, sf))
    return t.select("session_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n_active", F.array_join(F.col("event_ids").cast("array<string>"), ",").alias("event_ids"))


@query(f"""WITH {TL}, d AS (SELECT session_id, event_id, s, s + 20 * (e - s) AS e FROM tl), bp AS (SELECT DISTINCT session_id, t FROM (SELECT session_id, s AS t FROM d UNION ALL SELECT session_id, e FROM d)),
iv AS (SELECT session_id, t AS a, lead(t) OVER (PARTITION BY session_id ORDER BY t) AS b FROM bp)
SELECT n_active, count(*) AS n_intervals, sum(b - a)::BIGINT AS total_us FROM (SELECT iv.session_id, a, b, count(*) AS n_active FROM iv JOIN d ON d.session_id = iv.session_id AND s <= a AND e > a WHERE b IS NOT NULL GROUP BY ALL) GROUP BY n_active""")
def q_topology_dense(spark, sf):
    t = src.timeline(spark, sf)
    dense = t.withColumn("end", F.col("start") + 20 * (F.col("end") - F.col("start")))
    return intervals.topology(dense).groupBy("n_active").agg(F.count("*").alias("n_intervals"), F.sum(F.col("end") - F.col("start")).alias("total_us"))


ISLANDS = f"""{TL}, p AS (SELECT session_id, s - {HOUR} AS a, s + {HOUR} AS b FROM tl WHERE value > 60),
m AS (SELECT *, max(b) OVER (PARTITION BY session_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR a > prev THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m),
cl AS (SELECT session_id, min(a) AS start_us, max(b) AS end_us, count(*) AS n FROM g GROUP BY session_id, k)"""


def _clips(spark, sf):
    marks = src.timeline(spark, sf).where("value > 60").select("session_id", F.col("start").alias("us"))
    return intervals.merge(intervals.pad(marks, "us", HOUR, HOUR).drop("us"))


@query(f"WITH {ISLANDS} SELECT * FROM cl")
def q_interval_merge(spark, sf):
    return _clips(spark, sf).select("session_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n")


@query(f"""WITH {ISLANDS} SELECT cl.session_id, start_us, count(*) AS n_frames, min(s) AS first_us, max(s) AS last_us FROM cl JOIN tl ON tl.session_id = cl.session_id AND s BETWEEN start_us AND end_us GROUP BY ALL""")
def q_clip_frames(spark, sf):
    frames = src.timeline(spark, sf).select("session_id", F.col("start").alias("us"))
    hit = intervals.band_join(_clips(spark, sf), frames, "us", 2 * HOUR)
    return hit.groupBy("session_id", F.col("start").alias("start_us")).agg(F.count("*").alias("n_frames"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query(f"""WITH {ISLANDS} SELECT format('clip_{{}}_{{}}', start_us // 1000000, cl.session_id) AS clip, CASE WHEN max(s) > min(s) THEN round((count(*) - 1) * 1e6 / (max(s) - min(s)), 6) ELSE 30.0 END AS fps FROM cl JOIN tl ON tl.session_id = cl.session_id AND s BETWEEN start_us AND end_us GROUP BY cl.session_id, start_us""")
def q_clip_names(spark, sf):
    frames = src.timeline(spark, sf).select("session_id", F.col("start").alias("us"))
    g = intervals.band_join(_clips(spark, sf), frames, "us", 2 * HOUR).groupBy("session_id", "start").agg(F.count("*").alias("n"), F.min("us").alias("a"), F.max("us").alias("b"))
    name = F.format_string("clip_%s_%s", F.floor(F.col("start") / 1_000_000), F.col("session_id"))
    return rounded(g.select(name.alias("clip"), paging.frame_rate(F.col("n"), F.col("a"), F.col("b"), 30.0).alias("fps")), "fps")


@query(f"WITH {TL} SELECT session_id, count(DISTINCT t) AS n_points, min(t) AS first_us, max(t) AS last_us FROM (SELECT session_id, s AS t FROM tl UNION ALL SELECT session_id, e FROM tl) GROUP BY session_id")
def q_breakpoints(spark, sf):
    b = intervals.breakpoints(src.timeline(spark, sf))
    return b.groupBy("session_id").agg(F.count("*").alias("n_points"), F.min("t").alias("first_us"), F.max("t").alias("last_us"))


@query(f"""WITH {TL}, f AS (SELECT session_id, event_id, s, value, row_number() OVER (PARTITION BY session_id ORDER BY s, event_id) - 1 AS idx FROM tl)
SELECT m.session_id, m.event_id AS mark_id, min(f.idx) AS lo, max(f.idx) AS hi FROM f m JOIN f ON f.session_id = m.session_id AND f.s BETWEEN m.s - {6 * HOUR} AND m.s + {6 * HOUR} WHERE m.value > 150 GROUP BY ALL HAVING min(f.idx) < max(f.idx)""")
def q_frames_around(spark, sf):
    w = Window.partitionBy("session_id").orderBy("start", "event_id")
    f = src.timeline(spark, sf).select("session_id", "event_id", "value", F.col("start").alias("us"), (F.row_number().over(w) - 1).cast("long").alias("idx"))
    return intervals.frames_around(f.where("value > 150").withColumnRenamed("event_id", "mark_id"), f, "us", 6 * HOUR)


@query(f"WITH {ISLANDS} SELECT session_id, start_us, rk AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_us) AS rk FROM cl) WHERE rk <= 6")
def q_queue_drop(spark, sf):
    c = scheduling.admitted(_clips(spark, sf), 4, 10, ["session_id"], ["start"])
    return c.select("session_id", F.col("start").alias("start_us"), F.col("place").cast("long").alias("place"))


# --- consolidation, filters, payloads


@query("""SELECT event_id, event_type AS stream_type, value, CASE WHEN event_id % 10 < 8 THEN 'chunk' ELSE 'journal' END AS origin, CASE WHEN event_id % 10 < 8 THEN NULL ELSE 'w' || user_id::VARCHAR END AS window_title FROM events""")
def q_journal_consolidate(spark, sf):
    e = src.events(spark, sf)
    journal = e.select("event_id", F.col("event_type").alias("stream_type"), "value", F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("window_title"))
    return consolidate.consolidate(journal.where("event_id % 10 < 8").drop("window_title"), journal)


@query("SELECT event_id, user_id AS session_id, value FROM events WHERE event_type = 'purchase'")
def q_stream_filter(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("session_id"), "value")


@query("SELECT event_type AS stream_type, count(*) AS n, round(sum(value), 2) AS total, round(max(value), 2) AS top FROM events GROUP BY event_type")
def q_typed_counts(spark, sf):
    return src.timeline(spark, sf).groupBy("stream_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.max("value"), 2).alias("top"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, coalesce(json_extract_string(props, '$.button'), 'unknown') AS button FROM events")
def q_json_payload(spark, sf):
    p = src.events(spark, sf).withColumn("p", F.from_json("props", "k int, button string"))
    return p.select("event_id", F.col("p.k").alias("k"), F.coalesce("p.button", F.lit("unknown")).alias("button"))


@query("SELECT user_id AS session_id, event_id, event_type AS stream_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def q_first_per_session(spark, sf):
    t = src.timeline(spark, sf)
    return consolidate.first_of(t, ["session_id"], ["start", "event_id"]).select("session_id", "event_id", "stream_type")


@query("""SELECT session_id, run, stream_type, count(*) AS n, min(us) AS start_us FROM (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM
(SELECT user_id AS session_id, event_id, event_type AS stream_type, epoch_us(ts) AS us, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL""")
def q_message_runs(spark, sf):
    r = overlay.runs(src.timeline(spark, sf), "session_id", "start", "event_id", "stream_type")
    return r.withColumnRenamed("start", "start_us")


@query("""SELECT c_custkey AS id, CASE WHEN length(c_name) > 12 THEN left(c_name, 12) || '...' ELSE c_name END AS title, upper(left(c_mktsegment, 1)) AS initial FROM customer WHERE length(c_name) >= 2 AND lower(c_mktsegment) NOT IN ('building', 'machinery')""")
def q_candidate_windows(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").where((F.length("c_name") >= 2) & ~F.lower("c_mktsegment").isin("building", "machinery"))
    return c.select(F.col("c_custkey").alias("id"), scalars.ellipsis(F.col("c_name"), 12).alias("title"), scalars.key_label(F.left("c_mktsegment", F.lit(1))).alias("initial"))


@query("SELECT p_partkey AS id FROM part WHERE contains(p_name, 'red') OR p_type = 'red' OR ends_with(p_name, 'red')")
def q_exe_match(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.where(scalars.matches_exe("red", F.col("p_name"), F.col("p_type"))).select(F.col("p_partkey").alias("id"))


# --- gestures


GESTURES = f"""{TICKS}, n AS (SELECT *, CASE WHEN us - lag(us) OVER w > {HOUR // 2} THEN 1 WHEN lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM tk WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS k FROM n),
t AS (SELECT *, CASE WHEN dy <> lag(dy) OVER (PARTITION BY session_id, k ORDER BY us, event_id) THEN 1 ELSE 0 END AS turn FROM g)"""


@query(f"WITH {GESTURES} SELECT session_id, k AS session_no, min(us) AS start_us, max(us) AS end_us, sum(dy)::BIGINT AS total_dy, count(*) AS n_ticks, sum(turn)::BIGINT AS reversals FROM t GROUP BY session_id, k")
def q_scroll_sessions(spark, sf):
    g = gestures.scroll_gestures(src.ticks(spark, sf), HOUR // 2)
    return g.withColumnsRenamed({"start": "start_us", "end": "end_us"})


@query(f"WITH {TICKS} SELECT session_id, sum(CASE WHEN dy <> p THEN 1 ELSE 0 END)::BIGINT AS reversals FROM (SELECT *, lag(dy) OVER (PARTITION BY session_id ORDER BY us, event_id) AS p FROM tk) GROUP BY session_id")
def q_scroll_reversals(spark, sf):
    g = gestures.scroll_gestures(src.ticks(spark, sf), 10**18)
    return g.select("session_id", "reversals")


@query("""WITH a AS (SELECT user_id AS session_id, event_id, epoch_us(ts) AS us, CASE event_type WHEN 'view' THEN 'P' ELSE 'R' END AS action FROM events WHERE event_type IN ('view', 'click')),
k AS (SELECT * FROM (SELECT *, coalesce(lag(action) OVER (PARTITION BY session_id ORDER BY us, event_id), 'R') AS was FROM a) WHERE action <> was),
h AS (SELECT *, lead(us) OVER (PARTITION BY session_id ORDER BY us, event_id) AS rel FROM k)
SELECT session_id, us AS pressed, rel AS released, rel - us AS held FROM h WHERE action = 'P' AND rel IS NOT NULL""")
def q_key_pairing(spark, sf):
    e = src.events(spark, sf).where("event_type in ('view', 'click')")
    a = e.select(F.col("user_id").alias("session_id"), "event_id", "us", F.when(F.col("event_type") == "view", "P").otherwise("R").alias("action"))
    return gestures.key_holds(a, ["session_id"])


@query("""WITH f AS (SELECT user_id AS session_id, ts, event_type = 'signup' AS focused FROM events WHERE event_type IN ('signup', 'error')),
e AS (SELECT user_id AS session_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'release' ELSE 'press' END AS kind FROM events WHERE event_type NOT IN ('signup', 'error'))
SELECT e.session_id, event_id, kind, focused FROM e ASOF LEFT JOIN f ON e.session_id = f.session_id AND e.ts >= f.ts WHERE coalesce(focused, false) OR kind = 'release'""")
def q_focus_asof(spark, sf):
    e = src.events(spark, sf).withColumnRenamed("user_id", "session_id")
    samples = e.where("event_type in ('signup', 'error')").select("session_id", "us", (F.col("event_type") == "signup").alias("focused"))
    acts = e.where("event_type not in ('signup', 'error')").select("session_id", "us", "event_id", F.when(F.col("event_type") == "purchase", "release").otherwise("press").alias("kind"))
    return gestures.focus_gate(acts, samples).select("session_id", "event_id", "kind", "focused")


@query()
def q_mouse_trajectories(spark, sf):
    e = src.events(spark, sf)
    k = F.get_json_object("props", "$.k").cast("int")
    moves = e.select(F.col("user_id").alias("session_id"), (F.col("us") / 1e6).alias("ts"), F.floor(F.col("value") * 2).cast("int").alias("x"), (k * 5).cast("int").alias("y"), F.when(k % 7 == 0, "left").alias("button"))
    return gestures.trajectories(moves)


# --- pages


@query("""SELECT session_id, (n // 16)::BIGINT AS page, count(*) AS n_frames, min(event_id) AS lo, max(event_id) AS hi FROM (SELECT user_id AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE (n // 16 + 1) * 16 <= total GROUP BY ALL""")
def q_pages(spark, sf):
    f = src.events(spark, sf).select(F.col("user_id").alias("session_id"), "event_id", "us")
    return paging.pages(f, 16).groupBy("session_id", "page").agg(F.count("*").alias("n_frames"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@query("""WITH f AS (SELECT user_id AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, count(*) OVER w AS c, epoch_us(min(ts) OVER w) AS a, epoch_us(max(ts) OVER w) AS b FROM events WINDOW w AS (PARTITION BY user_id)),
s AS (SELECT *, CASE WHEN b > a THEN (c - 1) * 1000000 / (b - a) ELSE 60.0 END AS fps FROM f), t AS (SELECT *, CASE WHEN c < 2 OR fps <= 0.00001 THEN 1 ELSE ceil(fps / 0.00001)::BIGINT END AS step FROM s)
SELECT session_id, event_id, step FROM t WHERE n % step = 0""")
def q_decimate(spark, sf):
    f = src.events(spark, sf).select(F.col("user_id").alias("session_id"), "event_id", "us")
    return paging.decimate(f, 0.00001).select("session_id", "event_id", "step")


# --- novelty


DRIFT = f"""{LATENTS}, l AS (SELECT *, lag(v) OVER (PARTITION BY page ORDER BY frame) AS p FROM lt),
dr AS (SELECT page, frame, label, CASE WHEN p IS NULL THEN 0.0 ELSE 1 - least(greatest(list_cosine_similarity(v, p), -1), 1) END AS score FROM l)"""


@query(f"WITH {DRIFT} SELECT page, frame, round(score, 6) + 0.0 AS score FROM dr")
def q_cosine_drift(spark, sf):
    return rounded(novelty.drift(src.latents(spark, sf), ["page"]).select("page", "frame", "score"), "score")


def _z_sql(frame: str) -> str:
    return f"""WITH {DRIFT}, b AS (SELECT *, (frame % 50) // 10 AS batch FROM dr),
w AS (SELECT *, count(score) OVER z AS n, avg(score) OVER z AS m, stddev_pop(score) OVER z AS s FROM b WINDOW z AS (PARTITION BY page ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND {frame}))
SELECT page, frame, round(CASE WHEN n <= 1 OR s IS NULL OR s < 1e-12 THEN 0.0 ELSE (score - m) / (s + 1e-8) END, 4) + 0.0 AS z FROM w"""


def _z(spark, sf, current):
    d = novelty.drift(src.latents(spark, sf), ["page"]).withColumn("batch", F.floor(F.pmod("frame", F.lit(50)) / 10))
    z = novelty.running_z(d, ["page"], "batch", current)
    return z.select("page", "frame", (F.round("z", 4) + F.lit(0.0)).alias("z"))


@query(_z_sql("CURRENT ROW"))
def q_running_z(spark, sf):
    return _z(spark, sf, True)


@query(_z_sql("1 PRECEDING"))
def q_naive_novelty(spark, sf):
    return _z(spark, sf, False)


@query(f"""WITH {LATENTS}, pg AS (SELECT page, count(*) AS n FROM lt GROUP BY page) SELECT page, i::INTEGER AS ordinal, (i * (n - 1)) // 5 AS idx FROM pg, range(6) r(i)""")
def q_sentinels(spark, sf):
    pages = src.latents(spark, sf).groupBy("page").agg(F.count("*").alias("n_frames"))
    return triage.sentinels(pages).select("page", "ordinal", "idx")


TRIAGE = f"""{LATENTS}, fr AS (SELECT *, page // 8 AS session_id, row_number() OVER (PARTITION BY page ORDER BY frame) - 1 AS idx, count(*) OVER (PARTITION BY page) AS n FROM lt),
sn AS (SELECT session_id, page, i AS ordinal, idx, frame, v FROM fr, range(6) r(i) WHERE idx = (i * (n - 1)) // 5),
sc AS (SELECT *, lag(v) OVER (PARTITION BY session_id ORDER BY page * 6 + ordinal) AS p FROM sn),
s2 AS (SELECT *, CASE WHEN p IS NULL THEN 0.0 ELSE 1 - least(greatest(list_cosine_similarity(v, p), -1), 1) END AS score FROM sc),
s3 AS (SELECT *, count(score) OVER z AS c, avg(score) OVER z AS m, stddev_pop(score) OVER z AS sd FROM s2 WINDOW z AS (PARTITION BY session_id ORDER BY page RANGE UNBOUNDED PRECEDING)),
s4 AS (SELECT *, CASE WHEN c <= 1 OR sd IS NULL OR sd < 1e-12 THEN 0.0 ELSE (score - m) / (sd + 1e-8) END AS z FROM s3),
s5 AS (SELECT *, lead(idx) OVER w AS next_idx, lead(z) OVER w AS nz FROM s4 WINDOW w AS (PARTITION BY session_id, page ORDER BY ordinal)),
tri AS (SELECT *, coalesce(z > 0.3 OR nz > 0.3, false) AS hot, greatest(z, nz) AS span_z FROM s5)"""


def _session():
    """Eight pages make a session, so sessions grow in number with the data."""
    return F.expr("page div 8")


def _spans(spark, sf):
    return triage.coarse_triage(src.latents(spark, sf).withColumn("session_id", _session()))


@query(f"WITH {TRIAGE} SELECT session_id, page, round(max(z), 4) + 0.0 AS max_z, max(z) > 0.3 AS interesting, sum(hot::INTEGER)::BIGINT AS n_hot FROM tri GROUP BY session_id, page")
def q_coarse_triage(spark, sf):
    t = triage.interesting(_spans(spark, sf))
    return t.withColumn("max_z", F.round("max_z", 4) + F.lit(0.0))


@query(f"WITH {TRIAGE} SELECT session_id, page, idx AS lo, next_idx AS hi, round(span_z, 4) + 0.0 AS z FROM tri WHERE hot AND next_idx IS NOT NULL")
def q_hot_regions(spark, sf):
    return _spans(spark, sf).where("hot and next_idx is not null").select("session_id", "page", F.col("idx").alias("lo"), F.col("next_idx").alias("hi"), (F.round("span_z", 4) + F.lit(0.0)).alias("z"))


@query(f"""WITH {TRIAGE}, r AS (SELECT *, bool_or(hot) OVER (PARTITION BY session_id, page) AS anyhot, row_number() OVER (PARTITION BY session_id, page ORDER BY round(span_z, 9) DESC, ordinal) AS rk FROM tri WHERE next_idx IS NOT NULL) SELECT session_id, page, ordinal::INTEGER AS ordinal, rk AS rank FROM r WHERE rk <= CASE WHEN anyhot THEN 2 ELSE 1 END""")
def q_top_spans(spark, sf):
    s = _spans(spark, sf).withColumn("span_z", F.round("span_z", 9))
    return triage.top_spans(s, 2, 1).select("session_id", "page", "ordinal", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {TRIAGE} SELECT session_id, page, frame, row_number() OVER (PARTITION BY session_id ORDER BY round(z, 9) DESC, frame) AS place FROM tri WHERE round(z, 9) > 0.3")
def q_published(spark, sf):
    p = scheduling.published(_spans(spark, sf).withColumn("z", F.round("z", 9)), 0.3, ["session_id"], "z", "frame")
    return p.select("session_id", "page", "frame", F.col("place").cast("long").alias("place"))


# The schedule's first and last values, the steps that it holds the first, and those that it then takes.
SCHEDULE = {"share": (0.05, 0.12, 2, 24), "novel": (0.75, 0.01, 4, 24)}


def _scheduled() -> dict:
    return {n: lambda step, v=v: scalars.scheduled(step, *map(F.lit, v)) for n, v in SCHEDULE.items()}


KERNELS = f"""{LATENTS}, kl AS (SELECT page // 8 AS session_id, page, frame, unnest(['first', 'last']) AS kernel, unnest([v[1:32], v[33:64]]) AS v FROM lt),
kf AS (SELECT *, row_number() OVER (PARTITION BY page, kernel ORDER BY frame) - 1 AS idx, count(*) OVER (PARTITION BY page, kernel) AS n FROM kl),
ks AS (SELECT kf.*, i AS ordinal FROM kf, range(6) r(i) WHERE idx = (i * (n - 1)) // 5),
kd AS (SELECT *, lag(v) OVER w AS p, row_number() OVER w AS nth FROM ks WINDOW w AS (PARTITION BY session_id, kernel ORDER BY page, ordinal)),
kc AS (SELECT *, CASE WHEN nth = 1 THEN 0.0 ELSE 1 - least(greatest(list_cosine_similarity(v, p), -1), 1) END AS d FROM kd),
kz AS (SELECT *, count(d) OVER b AS c, avg(d) OVER b AS m, stddev_pop(d) OVER b AS sd FROM kc WINDOW b AS (PARTITION BY session_id, kernel ORDER BY page RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kj AS (SELECT *, CASE WHEN c > 1 AND sd > 0 THEN (d - m) / (sd + 1e-8) ELSE 0.0 END AS z, coalesce(c > 1 AND sd > 0 AND d > m + 0.5 * sd, false) AS novel FROM kz),
kp AS (SELECT *, lead(idx) OVER s AS next, novel OR lead(novel) OVER s AS hot, max(z) OVER (PARTITION BY page, kernel) AS top FROM kj WINDOW s AS (PARTITION BY page, kernel ORDER BY ordinal))"""


@query(f"""WITH {KERNELS} SELECT session_id, page, round(max(top), 4) + 0.0 AS max_z, max(top) > 0.3 AS interesting, coalesce(string_agg(kernel || ':' || idx || '-' || next, ',' ORDER BY kernel, ordinal) FILTER (WHERE next IS NOT NULL AND hot AND top > 0.3), '') AS hot FROM kp GROUP BY session_id, page""")
def q_verdicts(spark, sf):
    v = search.verdicts(src.kernels(spark, sf), "naive_cos_dissimilarity", share=0.0)
    hot = F.array_join(F.transform("hot", lambda h: F.concat(h["kernel"], F.lit(":"), h["lo"], F.lit("-"), h["hi"])), ",")
    return v.select("session_id", "page", (F.round("max_z", 4) + F.lit(0.0)).alias("max_z"), "interesting", hot.alias("hot"))


@query()
def q_refine(spark, sf):
    return search.refined(src.kernels(spark, sf))


@query()
def q_hierarchical_search(spark, sf):
    return search.searched(src.kernels(spark, sf), schedule=_scheduled())


@query()
def q_search_log(spark, sf):
    return search.search_log(src.kernels(spark, sf), schedule=_scheduled())


@query()
def q_pca_mahalanobis(spark, sf):
    return rounded(novelty.pca_mahalanobis(src.latents(spark, sf)).select("page", "frame", "score"), "score")


@query()
def q_incremental_pca(spark, sf):
    return search.tracked(src.kernels(spark, sf))


@query(f"WITH {LATENTS} SELECT page, pos::INTEGER AS pos, round(avg(x), 6) + 0.0 AS x FROM (SELECT page, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM lt) GROUP BY page, pos")
def q_token_pool(spark, sf):
    p = novelty.pooled(src.latents(spark, sf), ["page"])
    return rounded(p.select("page", F.posexplode("embedding").alias("pos", "x")), "x")


@query(f"WITH {LATENTS} SELECT frame, round(list_sum(list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v))) * (x / sqrt(list_dot_product(v, v))))), 6) AS length FROM lt")
def q_normalised(spark, sf):
    n = vectors.normalise(F.col("embedding"))
    d = src.latents(spark, sf).withColumn("n", n)
    return d.select("frame", F.round(vectors.dot(F.col("n"), F.col("n")), 6).alias("length"))


# --- flow


LEVELS = f"""{FLOW}, su AS (SELECT *, sum(net) OVER (PARTITION BY stage ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS s FROM fl),
lv AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY stage ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)) AS level FROM su),
ra AS (SELECT *, sum(net) OVER w / 3600.0 AS rate, count(*) OVER w AS nw, us - min(us) OVER w AS span FROM lv WINDOW w AS (PARTITION BY stage ORDER BY us RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW))"""


@query(f"WITH {LEVELS} SELECT event_id, stage, level FROM lv")
def q_flow_level(spark, sf):
    return flow.levels(src.flow_events(spark, sf)).select("event_id", "stage", "level")


@query(f"WITH {LEVELS} SELECT event_id, stage, round(rate, 6) + 0.0 AS rate, nw AS n_window FROM ra")
def q_flow_rate(spark, sf):
    return rounded(flow.rates(src.flow_events(spark, sf), HOUR).select("event_id", "stage", "rate", "n_window"), "rate")


@query(f"WITH {LEVELS} SELECT event_id, stage FROM ra WHERE nw >= 2 AND span >= 0.8 * {HOUR // 4} AND rate > 5")
def q_unsustainable(spark, sf):
    r = flow.unsustainable(flow.rates(src.flow_events(spark, sf), HOUR), 5.0, HOUR // 4)
    return r.where("unsustainable").select("event_id", "stage")


@query(f"WITH {LEVELS} SELECT stage, level, round(rate, 6) + 0.0 AS rate, round(CASE WHEN level >= 100000000 THEN 0.0 WHEN rate <= 0 THEN -1.0 ELSE (100000000 - level) / rate END, 4) AS eta FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY us DESC, event_id DESC) AS r FROM ra) WHERE r = 1")
def q_overflow_eta(spark, sf):
    o = flow.overflow(src.flow_events(spark, sf), HOUR, 100_000_000)
    return o.withColumns({"rate": F.round("rate", 6) + F.lit(0.0), "eta": F.round("eta", 4)})


# --- scheduling


WORK = """wk AS (SELECT event_id AS page_id, CASE event_type WHEN 'view' THEN 'refine' WHEN 'click' THEN 'triage' ELSE 'evict' END AS work_type, value / 500 AS novelty, event_id % 50 = 0 AS paused, epoch_us(ts) AS created_at FROM events)"""


def _work(spark, sf):
    kind = F.when(F.col("event_type") == "view", "refine").when(F.col("event_type") == "click", "triage").otherwise("evict")
    w = src.events(spark, sf).select(F.col("event_id").alias("page_id"), kind.alias("work_type"), (F.col("value") / 500).alias("novelty"), (F.col("event_id") % 50 == 0).alias("paused"), F.col("us").alias("created_at"))
    return w.withColumn("priority", scheduling.priority(F.col("work_type"), F.col("novelty"), F.col("paused")))


PRIORITY = "CASE WHEN work_type = 'triage' THEN 0.0 WHEN work_type = 'refine' AND paused THEN 0.9 WHEN work_type = 'refine' THEN 1.0 + (1.0 - least(novelty, 1.0)) ELSE 2.0 END"


@query(f"WITH {WORK} SELECT page_id, work_type, round({PRIORITY}, 6) AS priority FROM wk ORDER BY {PRIORITY}, created_at, page_id LIMIT 25")
def q_priority_topk(spark, sf):
    return rounded(scheduling.next_work(_work(spark, sf), 25).select("page_id", "work_type", "priority"), "priority")


@query(f"WITH {WORK} SELECT page_id, round({PRIORITY}, 6) AS priority FROM wk WHERE work_type = 'refine' ORDER BY {PRIORITY}, created_at, page_id LIMIT 25")
def q_refinement_first(spark, sf):
    return rounded(scheduling.next_work(_work(spark, sf), 25, "refine").select("page_id", "priority"), "priority")


def _pages_state(spark, sf):
    state = F.element_at(F.array(*[F.lit(s) for s in scheduling.STATES]), (F.col("event_id") % 7 + 1).cast("int"))
    return src.events(spark, sf).select(F.col("event_id").alias("page_id"), state.alias("state"), F.col("us").alias("last_activity"), F.when(F.col("event_type") != "error", F.col("value")).alias("novelty"))


NOW = 1_706_745_600_000_000


@query(f"SELECT event_id AS page_id, {NOW} - epoch_us(ts) AS age FROM events WHERE event_id % 7 = 3 AND {NOW} - epoch_us(ts) > {10 * HOUR} ORDER BY age DESC, coalesce(CASE WHEN event_type <> 'error' THEN value END, 0), page_id LIMIT 2")
def q_stale_evict(spark, sf):
    return scheduling.evict(_pages_state(spark, sf), NOW, 10 * HOUR).select("page_id", "age")


@query("SELECT CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(scheduling.STATES)) + " END AS state, count(*) AS n FROM events GROUP BY 1")
def q_state_hist(spark, sf):
    return _pages_state(spark, sf).groupBy("state").agg(F.count("*").alias("n"))


STEPS = " UNION ALL ".join(f"SELECT {'NULL' if a is None else repr(a)} AS was, {b!r} AS state" for a, b in scheduling.STEPS)
NAMES = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(scheduling.STATES)) + " END"


@query(f"WITH st AS ({STEPS}), m AS (SELECT user_id AS page_id, event_id, {NAMES} AS state, lag({NAMES}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) SELECT page_id, event_id, m.state, m.was, st.state IS NOT NULL AS valid FROM m LEFT JOIN st ON st.state = m.state AND st.was IS NOT DISTINCT FROM m.was")
def q_page_replay(spark, sf):
    state = F.element_at(F.array(*[F.lit(s) for s in scheduling.STATES]), (F.col("event_id") % 7 + 1).cast("int"))
    m = src.events(spark, sf).select(F.col("user_id").alias("page_id"), "event_id", F.struct("us", "event_id").alias("seq"), state.alias("state"))
    return scheduling.replay(m).select("page_id", "event_id", "state", "was", "valid")


@query(f"SELECT user_id AS block, epoch_us(max(ts)) AS last_seen, count(*) AS n_signs FROM events GROUP BY user_id HAVING (SELECT epoch_us(max(ts)) FROM events) - epoch_us(max(ts)) > {6 * HOUR}")
def q_timeouts(spark, sf):
    b = src.events(spark, sf).select(F.col("user_id").alias("block"), "us")
    return scheduling.timeouts(b, 6 * HOUR).select("block", "last_seen", "n_signs")


def _schedule_sql(first: float, last: float, held: int, taken: int) -> str:
    return f"round(CASE WHEN step < {held} THEN {first} WHEN step < {held + taken} THEN {first} + ({last} - {first}) * (step - {held}) / {taken}.0 ELSE {last} END, 6) + 0.0"


@query(f"""WITH s AS (SELECT event_id, user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)
SELECT event_id, session_id, step, {_schedule_sql(*SCHEDULE["share"])} AS max_share, {_schedule_sql(*SCHEDULE["novel"])} AS novel, CASE WHEN step < 10 THEN 8.0 ELSE 4.0 END AS branching FROM s""")
def q_schedule(spark, sf):
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) - 1
    s = src.events(spark, sf).select("event_id", F.col("user_id").alias("session_id"), step.cast("long").alias("step"))
    at = {n: (F.round(f(F.col("step")), 6) + F.lit(0.0)).alias(a) for (n, f), a in zip(_scheduled().items(), ("max_share", "novel"), strict=True)}
    return s.select("*", *at.values(), scalars.scheduled(F.col("step"), F.lit(8.0), F.lit(4.0), F.lit(10), F.lit(0)).alias("branching"))


# --- overlay


@query(f"""WITH {TL} SELECT f.session_id, f.event_id AS frame_id, count(*) AS n_alive, max(f.s - t.e)::BIGINT AS oldest FROM tl f JOIN tl t ON t.session_id = f.session_id AND f.s >= t.s AND f.s <= t.e + {HOUR} WHERE f.stream_type = 'view' GROUP BY ALL""")
def q_overlay_alive(spark, sf):
    t = src.timeline(spark, sf)
    frames = t.where("stream_type = 'view'").select("session_id", F.col("event_id").alias("frame_id"), F.col("start").alias("us"))
    return overlay.alive(frames, t.select("session_id", "event_id", "start", "end"), 0, HOUR).groupBy("session_id", "frame_id").agg(F.count("*").alias("n_alive"), F.max("age").alias("oldest"))


@query(f"""WITH {TL} SELECT session_id, frame_id, string_agg(event_id::VARCHAR, ' ' ORDER BY rk) AS keys FROM (SELECT f.session_id, f.event_id AS frame_id, t.event_id, row_number() OVER (PARTITION BY f.event_id ORDER BY t.s DESC, t.event_id DESC) AS rk FROM tl f JOIN tl t ON t.session_id = f.session_id AND f.s >= t.s AND f.s <= t.s + {24 * HOUR} WHERE f.stream_type = 'purchase') WHERE rk <= 8 GROUP BY ALL""")
def q_last8_keys(spark, sf):
    t = src.timeline(spark, sf)
    frames = t.where("stream_type = 'purchase'").select("session_id", F.col("event_id").alias("frame_id"), F.col("start").alias("us"))
    k = overlay.last_keys(frames, t.select("session_id", "event_id", "start"), 24 * HOUR)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("event_id").cast("string").alias("id")))), lambda x: x["id"])
    return k.groupBy("session_id", "frame_id").agg(F.array_join(ids, " ").alias("keys"))


@query("""WITH p AS (SELECT DISTINCT user_id % 4 AS screen, floor(value / 5)::INTEGER AS x, json_extract_string(props, '$.k')::INTEGER AS y, CASE WHEN event_type = 'click' THEN 3 ELSE 2 END AS r, CASE WHEN event_type = 'click' THEN 5.0 ELSE 1.0 END AS w FROM events),
c AS (SELECT screen, x + dx AS x, y + dy AS y, max(w) AS value FROM p, range(-3, 4) a(dx), range(-3, 4) b(dy) WHERE dx * dx + dy * dy <= r * r GROUP BY ALL)
SELECT screen, x::INTEGER AS x, y::INTEGER AS y, value, round(value / (SELECT max(value) FROM c WHERE x BETWEEN 0 AND 99 AND y BETWEEN 0 AND 99), 6) AS norm FROM c WHERE x BETWEEN 0 AND 99 AND y BETWEEN 0 AND 99""")
def q_heatmap(spark, sf):
    e = src.events(spark, sf)
    click = F.col("event_type") == "click"
    p = e.select((F.col("user_id") % 4).alias("screen"), F.floor(F.col("value") / 5).cast("int").alias("x"), F.get_json_object("props", "$.k").cast("int").alias("y"), F.when(click, 3).otherwise(2).alias("radius"), F.when(click, 5.0).otherwise(1.0).alias("weight"))
    return overlay.normalised(overlay.heatmap(p, 100, 100, ["screen"])).withColumn("norm", F.round("norm", 6))


@query("SELECT conv_id, turn, 'Text at ' || turn::VARCHAR || ': ' || text AS line FROM conversations WHERE role = 'user' AND text IS NOT NULL AND turn IS NOT NULL")
def q_transcript(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user' and text is not null and turn is not null")
    return c.select("conv_id", "turn", F.concat(F.lit("Text at "), F.col("turn").cast("string"), F.lit(": "), F.col("text")).alias("line"))


@query("""SELECT o_orderkey AS id, CASE WHEN w * h <= 262144 THEN w ELSE floor((w / h) * floor(sqrt(262144 / (w / h))))::INTEGER END AS width, CASE WHEN w * h <= 262144 THEN h ELSE floor(sqrt(262144 / (w / h)))::INTEGER END AS height FROM (SELECT o_orderkey, (300 + o_orderkey % 1700)::INTEGER AS w, (200 + o_custkey % 1000)::INTEGER AS h FROM orders)""")
def q_downscale(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 1700 + 300).cast("int").alias("w"), (F.col("o_custkey") % 1000 + 200).cast("int").alias("h"))
    return o.withColumn("d", scalars.downscaled(F.col("w"), F.col("h"))).select("id", "d.width", "d.height")


@query("""SELECT user_id AS session_id, count(*) AS n, CASE WHEN max(ts) > min(ts) THEN round((count(*) - 1) * 1e6 / (epoch_us(max(ts)) - epoch_us(min(ts))), 9) ELSE 60.0 END AS fps FROM events GROUP BY user_id""")
def q_frame_rates(spark, sf):
    e = src.events(spark, sf).groupBy(F.col("user_id").alias("session_id")).agg(F.count("*").alias("n"), F.min("us").alias("a"), F.max("us").alias("b"))
    return e.select("session_id", "n", F.round(paging.frame_rate(F.col("n"), F.col("a"), F.col("b")), 9).alias("fps"))


# --- rules of windows, overlays and sizes


def _four(x: str) -> str:
    return f"((({x} + 50) // 100) // 10000)::VARCHAR || '.' || lpad(((({x} + 50) // 100) % 10000)::VARCHAR, 4, '0')"


@query(f"""WITH {TL}, bp AS (SELECT DISTINCT session_id, t FROM (SELECT session_id, s AS t FROM tl UNION ALL SELECT session_id, e FROM tl)),
iv AS (SELECT session_id, t AS a, lead(t) OVER (PARTITION BY session_id ORDER BY t) AS b FROM bp),
tp AS (SELECT iv.session_id, a, {_four("a")} || '-' || {_four("b")} AS interval, count(*) AS n FROM iv JOIN tl ON tl.session_id = iv.session_id AND s <= a AND e > a WHERE b IS NOT NULL GROUP BY iv.session_id, a, b)
SELECT session_id, interval, arg_max(n, a) AS n_active FROM tp GROUP BY session_id, interval""")
def q_topology_map(spark, sf):
    t = intervals.keyed(intervals.topology(src.timeline(spark, sf)))
    return t.select("session_id", "interval", F.size("event_ids").cast("long").alias("n_active"))


@query("""SELECT c_custkey AS id, c_name LIKE '%00001%' AS titled, c_acctbal >= 100 AND c_custkey % 90 >= 50 AND length(c_name) >= 2 AND lower(CASE WHEN c_custkey % 5 = 0 THEN 'Explorer.EXE' ELSE c_name END) <> 'explorer.exe' AND c_custkey % 3 > 0 AS recordable FROM customer""")
def q_windows(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    exe = F.when(F.col("c_custkey") % 5 == 0, "Explorer.EXE").otherwise(F.col("c_name"))
    ok = scalars.recordable(F.col("c_name"), exe, F.col("c_acctbal"), F.col("c_custkey") % 90, F.col("c_custkey") % 3 > 0)
    return c.select(F.col("c_custkey").alias("id"), scalars.matches_title("00001", F.col("c_name")).alias("titled"), ok.alias("recordable"))


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type AS exe, event_id % 3 AS pid FROM events), l AS (SELECT *, lag(exe) OVER w AS exe0, lag(pid) OVER w AS pid0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, coalesce(exe = exe0, false) AS program, coalesce(pid = pid0, false) AS process FROM l""")
def q_same_window(spark, sf):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = src.events(spark, sf).withColumn("win", F.struct(F.col("event_type").alias("exe_path"), (F.col("event_id") % 3).alias("pid"))).withColumn("was", F.lag("win").over(w))
    return e.select("event_id", scalars.same_program(F.col("win"), F.col("was")).alias("program"), scalars.same_process(F.col("win"), F.col("was")).alias("process"))


@query(f"""WITH {TL}, a AS (SELECT event_id, s / 1e6 AS s, e / 1e6 AS e, (s + (event_id % 9) * 500000) / 1e6 AS t FROM tl)
SELECT event_id, t - e <= 2 AS trail, t - s BETWEEN 0 AND 1 AS click, t - s BETWEEN 0 AND 2 AS key, t >= s AND t <= e + 1 AS scroll, round(greatest(0, 1 - (t - e) / 2), 6) AS trail_opacity, round(CASE WHEN t < e THEN 1 ELSE greatest(0, 1 - (t - e)) END, 6) AS scroll_opacity FROM a""")
def q_shown(spark, sf):
    s, e, t = F.col("s"), F.col("e"), F.col("t")
    a = src.timeline(spark, sf).select("event_id", (F.col("start") / 1e6).alias("s"), (F.col("end") / 1e6).alias("e"), ((F.col("start") + F.col("event_id") % 9 * 500_000) / 1e6).alias("t"))
    return rounded(a.select(
        "event_id", scalars.trail_shown(t, e, 2.0).alias("trail"), scalars.click_shown(t, s, 1.0).alias("click"), scalars.key_shown(t, s, 2.0).alias("key"), scalars.scroll_shown(t, s, e, 1.0).alias("scroll"),
        scalars.fade(t - e, 2.0).alias("trail_opacity"), scalars.scroll_fade(t - e, 1.0).alias("scroll_opacity"),
    ), "trail_opacity", "scroll_opacity")


@query("""WITH c AS (SELECT event_id, (event_id % 5) / 4.0 AS age, (event_id % 1900)::INTEGER AS x FROM events WHERE event_type = 'click'), f AS (SELECT *, greatest(0, 1 - age) AS o FROM c)
SELECT event_id, trunc(x * (1280 / 1920.0::DOUBLE))::INTEGER AS x, greatest(1, trunc(3 * o))::INTEGER AS line, greatest(3, trunc(6 * o))::INTEGER AS dot, trunc(10 + 20 * age)::INTEGER AS ring FROM f""")
def q_marks(spark, sf):
    age = F.col("event_id") % 5 / 4.0
    o = scalars.fade(age, 1.0)
    return src.events(spark, sf).where("event_type = 'click'").select(
        "event_id", scalars.scaled((F.col("event_id") % 1900).cast("int"), F.lit(1920.0), F.lit(1280.0)).alias("x"), scalars.line_width(o).alias("line"), scalars.end_radius(o).alias("dot"), scalars.ring_radius(age, 1.0).alias("ring")
    )


@query("SELECT user_id AS session_id, CASE WHEN user_id % 2 = 0 THEN 1700000000.5 ELSE min(epoch_us(ts)) / 1e6 END AS time_offset FROM events GROUP BY user_id")
def q_time_offset(spark, sf):
    e = src.events(spark, sf).groupBy(F.col("user_id").alias("session_id")).agg((F.min("us") / 1e6).alias("first"))
    start = F.when(F.col("session_id") % 2 == 0, 1_700_000_000.5).otherwise(0.0)
    return e.select("session_id", scalars.time_offset(start, F.col("first")).alias("time_offset"))


@query("""WITH o AS (SELECT o_orderkey AS id, (300 + o_orderkey % 1700)::INTEGER AS w, (200 + o_custkey % 1000)::INTEGER AS h FROM orders)
SELECT id, (w // 4 - (w // 4) % 2)::INTEGER AS quarter, (trunc(w * (480 / h::DOUBLE)) + trunc(w * (480 / h::DOUBLE)) % 2)::INTEGER AS wide, (w::BIGINT * h * 3 * 480) AS bytes, round((w % 256 / 255.0::DOUBLE - 0.5) / 0.5, 9) AS pixel FROM o""")
def q_sizes(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 1700 + 300).cast("int").alias("w"), (F.col("o_custkey") % 1000 + 200).cast("int").alias("h"))
    return o.select("id", scalars.even_quarter(F.col("w")).alias("quarter"), scalars.width_480p(F.col("w"), F.col("h")).alias("wide"), scalars.frame_bytes(F.lit(480), F.col("w"), F.col("h")).alias("bytes"), F.round(scalars.normalised_pixel(F.col("w") % 256), 9).alias("pixel"))


@query("""SELECT event_id, sha256('["' || user_id::VARCHAR || '","' || event_type || '","' || epoch_us(ts)::VARCHAR || '"]') AS natural_id FROM events""")
def q_natural_ids(spark, sf):
    return src.events(spark, sf).select("event_id", scalars.natural_id(F.col("user_id"), F.col("event_type"), F.col("us")).alias("natural_id"))


# --- buttons, focus, kernels, flow of pages


BUTTONS = ["b0", "b1", "b2"]
PRESSES = """pr AS (SELECT user_id AS session_id, event_id, ts, 'b' || (event_id % 3)::VARCHAR AS button, CASE WHEN json_extract_string(props, '$.k')::INTEGER % 2 = 0 THEN 'P' ELSE 'R' END AS action FROM events)"""
DOWN = " || ".join(f"CASE WHEN last_value(CASE WHEN button = '{b}' THEN action END IGNORE NULLS) OVER w = 'P' THEN '{b} ' ELSE '' END" for b in BUTTONS)


@query(f"WITH {PRESSES} SELECT event_id, rtrim({DOWN}) AS held FROM pr WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def q_held_buttons(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    e = src.events(spark, sf).select(F.col("user_id").alias("session_id"), "event_id", "us", F.concat(F.lit("b"), (F.col("event_id") % 3).cast("string")).alias("button"), F.when(k % 2 == 0, "P").otherwise("R").alias("action"))
    return gestures.held(e, BUTTONS).select("event_id", F.array_join("held", " ").alias("held"))


@query(f"""WITH {TICKS}, f AS (SELECT *, event_id % 4 > 0 AS focused FROM tk), g AS (SELECT *, sum(CASE WHEN focused THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY us, event_id) AS span FROM f),
h AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY session_id, span ORDER BY us, event_id) <= {6 * HOUR} THEN 0 ELSE 1 END AS fresh FROM g WHERE focused),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY us, event_id) AS gesture FROM h)
SELECT session_id, min(us) AS start_us, max(us) AS end_us, sum(dy)::BIGINT AS total_dy, count(*) AS n_ticks FROM k GROUP BY session_id, gesture""")
def q_focused_scrolls(spark, sf):
    t = src.ticks(spark, sf).withColumn("focused", F.col("event_id") % 4 > 0)
    return gestures.focused_gestures(t, 6 * HOUR).select("session_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "total_dy", "n_ticks")


@query("""WITH s AS (SELECT user_id AS page, 'k' || (event_id % 3)::VARCHAR AS kernel, value / 100 AS z FROM events)
SELECT page, max(z) AS z, bool_or(z > 1.9) AS interesting, coalesce(string_agg(DISTINCT kernel, ',' ORDER BY kernel) FILTER (z > 1.9), '') AS kernels FROM s GROUP BY page""")
def q_kernels(spark, sf):
    s = src.events(spark, sf).select(F.col("user_id").alias("page"), F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias("kernel"), (F.col("value") / 100).alias("z"))
    return triage.across_kernels(s, 1.9, ["page"]).withColumn("kernels", F.array_join("kernels", ","))


STAGE = "CASE WHEN {0} IN ('PENDING_TRIAGE', 'TRIAGING') THEN 'pending' WHEN {0} IN ('INTERESTING_RETAINED', 'REFINING') THEN 'intret' END"


@query(f"""WITH m AS (SELECT user_id AS page_id, event_id, {NAMES} AS state, lag({NAMES}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events),
s AS (SELECT page_id, event_id, {STAGE.format("was")} AS a, {STAGE.format("state")} AS b FROM m)
SELECT page_id, event_id, stage, net FROM (SELECT page_id, event_id, a AS stage, -(1000 + event_id) AS net FROM s WHERE a IS DISTINCT FROM b UNION ALL SELECT page_id, event_id, b, 1000 + event_id FROM s WHERE a IS DISTINCT FROM b) WHERE stage IS NOT NULL""")
def q_page_flow(spark, sf):
    state = F.element_at(F.array(*[F.lit(s) for s in scheduling.STATES]), (F.col("event_id") % 7 + 1).cast("int"))
    m = src.events(spark, sf).select(F.col("user_id").alias("page_id"), F.struct("us", "event_id").alias("seq"), state.alias("state"), (F.col("event_id") + 1000).alias("bytes"))
    return flow.transitions(scheduling.replay(m)).select("page_id", F.col("seq.event_id").alias("event_id"), "stage", "net")


@query(f"""WITH {LEVELS}, last AS (SELECT nw >= 2 AND span >= 0.8 * {HOUR // 4} AND rate > -100 AS u FROM ra WHERE stage = 'view' ORDER BY us DESC, event_id DESC LIMIT 1)
SELECT page_id, age FROM (SELECT event_id AS page_id, {NOW} - epoch_us(ts) AS age FROM events WHERE event_id % 7 = 3 AND {NOW} - epoch_us(ts) > {10 * HOUR} ORDER BY age DESC, page_id LIMIT 2) WHERE (SELECT u FROM last)""")
def q_shed_pages(spark, sf):
    rated = flow.rates(src.flow_events(spark, sf), HOUR)
    stale = scheduling.stale(_pages_state(spark, sf), NOW, 10 * HOUR).select("page_id", "age")
    return flow.shed(rated, stale, "view", -100.0, HOUR // 4)


@query(f"""WITH m AS (SELECT user_id AS page_id, user_id // 16 AS run, event_id, epoch_us(ts) AS us, {NAMES} AS state, lag({NAMES}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events),
ch AS (SELECT run, us, CASE WHEN state = 'INTERESTING_RETAINED' THEN 1 ELSE -1 END AS delta FROM m WHERE (state = 'INTERESTING_RETAINED') <> coalesce(was = 'INTERESTING_RETAINED', false)),
nf AS (SELECT user_id // 16 AS run, event_id, epoch_us(ts) AS us, CASE WHEN event_id % 2 = 1 THEN -round(value * 100)::BIGINT ELSE round(value * 100)::BIGINT END AS net FROM events),
rt AS (SELECT run, us, event_id, sum(net) OVER (PARTITION BY run ORDER BY us RANGE BETWEEN {24 * HOUR - 1} PRECEDING AND CURRENT ROW) / {24 * 3600.0} AS rate FROM nf),
lr AS (SELECT run, us, arg_max(rate, event_id) AS rate FROM rt GROUP BY ALL),
t AS (SELECT run, event_id, us, (SELECT coalesce(sum(delta), 0) FROM ch WHERE ch.run = d.run AND ch.us <= d.us)::BIGINT AS waiting FROM m d WHERE event_id % 5 = 0)
SELECT t.run, event_id, waiting, round(rate, 6) + 0.0 AS rate, waiting >= 3 OR (waiting >= 2 AND coalesce(rate > 0.1, false)) AS forced FROM t ASOF LEFT JOIN lr ON t.run = lr.run AND t.us >= lr.us""")
def q_forced_refinement(spark, sf):
    state = F.element_at(F.array(*[F.lit(s) for s in scheduling.STATES]), (F.col("event_id") % 7 + 1).cast("int"))
    run = F.expr("user_id div 16").alias("run")
    e = src.events(spark, sf)
    moves = scheduling.replay(e.select(F.col("user_id").alias("page_id"), run, "us", F.struct("us", "event_id").alias("seq"), state.alias("state")))
    cents = F.round(F.col("value") * 100).cast("long")
    net = e.select(run, "event_id", "us", F.when(F.pmod("event_id", F.lit(2)) == 1, -cents).otherwise(cents).alias("net"))
    rated = flow.rates(net, 24 * HOUR, key="run")
    f = scheduling.forced_refinement(e.where("event_id % 5 = 0").select(run, "event_id", "us"), scheduling.waiting(moves, ["run"]), rated, ["run"], rate=0.1)
    return f.select("run", "event_id", "waiting", (F.round("rate", 6) + F.lit(0.0)).alias("rate"), "forced")


def _named(us: str, places: int) -> str:
    """SQL for whole microseconds as seconds with decimals, half up."""
    step, unit = 10 ** (6 - places), 10**places
    return f"(({us} + {step // 2}) // {step} // {unit})::VARCHAR || '.' || lpad((({us} + {step // 2}) // {step} % {unit})::VARCHAR, {places}, '0')"


@query(f"SELECT event_id, 'clip_' || {_named('epoch_us(ts)', 2)} || '_' || event_type || '.mp4' AS clip, 'stills/' || event_type || '_' || {_named('epoch_us(ts)', 4)} || '.png' AS still FROM events")
def q_archive_names(spark, sf):
    e = src.events(spark, sf)
    return e.select("event_id", scalars.clip_name(F.col("us"), F.col("event_type")).alias("clip"), scalars.still_path(F.col("event_type"), F.col("us")).alias("still"))


@query(f"""WITH tk AS (SELECT user_id AS session_id, event_id, epoch_us(ts) AS us, sign(json_extract_string(props, '$.k')::INTEGER - 50)::INTEGER AS dy, (event_id % 3 - 1)::INTEGER AS dx FROM events),
n AS (SELECT *, CASE WHEN us - lag(us) OVER w > {HOUR // 2} OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM tk WHERE dx <> 0 OR dy <> 0 WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS k FROM n),
t AS (SELECT *, CASE WHEN dy <> lag(dy) OVER (PARTITION BY session_id, k ORDER BY us, event_id) THEN 1 ELSE 0 END AS turn FROM g)
SELECT session_id, k AS session_no, min(us) AS start_us, max(us) AS end_us, sum(dx)::BIGINT AS total_dx, sum(dy)::BIGINT AS total_dy, count(*) AS n_ticks, sum(turn)::BIGINT AS reversals FROM t GROUP BY session_id, k""")
def q_scroll_gestures(spark, sf):
    return gestures.scroll_gestures(src.ticks(spark, sf, True), HOUR // 2).withColumnsRenamed({"start": "start_us", "end": "end_us"})


INPUTS = """inp AS (SELECT event_id, user_id AS session_id, event_type, epoch_us(ts) / 1e6 AS s, json_extract_string(props, '$.k')::INTEGER AS k, event_id % 3 > 0 AS given FROM events WHERE event_type <> 'error')"""


@query(f"""WITH {INPUTS} SELECT event_id::VARCHAR AS event_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'path' WHEN 'purchase' THEN 'key' ELSE 'scroll' END AS kind,
CASE event_type WHEN 'click' THEN (CASE WHEN given THEN 'left' ELSE 'unknown' END) || '@' || k || ',' || CASE WHEN given THEN k * 2 ELSE 0 END
 WHEN 'view' THEN CASE WHEN given THEN '2' ELSE '0' END WHEN 'purchase' THEN CASE WHEN given THEN upper(chr(97 + k % 26)) ELSE 'SHIFT' END
 ELSE (CASE WHEN given THEN k ELSE 0 END) || ',' || (k - 50) END AS what, round(s, 6) AS start_s FROM inp""")
def q_typed_split(spark, sf):
    p = overlay.parsed(src.inputs(spark, sf))
    text = lambda *c: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in c])
    lists = [
        (overlay.clicks(p), "click", text(F.col("button"), "@", F.col("x"), ",", F.col("y"))), (overlay.mouse_paths(p), "path", text(F.size("points"))),
        (overlay.keys(p), "key", F.col("label")), (overlay.scrolls(p), "scroll", text(F.col("dx"), ",", F.col("dy"))),
    ]
    out = None
    for df, kind, what in lists:
        own = df.select("event_id", F.lit(kind).alias("kind"), what.alias("what"), F.round("start", 6).alias("start_s"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""WITH {INPUTS}, f AS (SELECT session_id, min(s) AS first FROM inp WHERE event_type <> 'signup' GROUP BY session_id)
SELECT u.session_id, CASE WHEN u.session_id % 5 = 0 THEN 1700000000.5 ELSE coalesce(first, 0.0) END AS time_offset FROM (SELECT DISTINCT user_id AS session_id FROM events) u LEFT JOIN f USING (session_id)""")
def q_time_offsets(spark, sf):
    i = src.inputs(spark, sf)
    recordings = i.select("session_id").distinct().withColumn("video_start", F.when(F.col("session_id") % 5 == 0, 1_700_000_000.5).otherwise(12.5))
    return overlay.time_offsets(overlay.parsed(i), recordings)


@query("""SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN k END, '0') AS of_view, coalesce(CASE WHEN event_type = 'click' THEN k END, '1') AS of_click, CASE WHEN event_type IN ('view', 'click') THEN 2 ELSE 3 END::INTEGER AS n
FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)""")
def q_merged_settings(spark, sf):
    base = F.create_map(F.lit("view"), F.lit("0"), F.lit("click"), F.lit("1"))
    m = src.events(spark, sf).select("event_id", scalars.merged(base, F.create_map("event_type", F.get_json_object("props", "$.k"))).alias("m"))
    return m.select("event_id", F.col("m")["view"].alias("of_view"), F.col("m")["click"].alias("of_click"), F.size("m").alias("n"))


@query("SELECT p_partkey AS id, (p_size * 3)::INTEGER AS width, (p_size + 100)::INTEGER AS height FROM part")
def q_split_sizes(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    size = scalars.size_of(F.concat_ws("x", F.col("p_size") * 3, F.col("p_size") + 100))
    return p.select(F.col("p_partkey").alias("id"), size["width"].alias("width"), size["height"].alias("height"))


@query(f"""WITH {TL} SELECT a.event_id, count(*) AS n_shown FROM tl a JOIN tl b ON a.session_id = b.session_id AND a.s - b.e <= {2 * HOUR} AND a.s - b.e >= -{2 * HOUR} WHERE a.value > 150 GROUP BY a.event_id""")
def q_trails(spark, sf):
    t = src.timeline(spark, sf)
    frames = t.where("value > 150").select("session_id", F.col("event_id").alias("frame_id"), F.col("start").alias("us"))
    near = intervals.band_join(t.select("session_id", F.col("end").alias("of"), (F.col("end") - 2 * HOUR).alias("start"), (F.col("end") + 2 * HOUR).alias("end")), frames, "us", 4 * HOUR)
    shown = near.where(scalars.trail_shown(F.col("us"), F.col("of"), F.lit(2 * HOUR), F.lit(2 * HOUR)))
    return shown.groupBy(F.col("frame_id").alias("event_id")).agg(F.count("*").alias("n_shown"))


SHORT = "CASE state " + " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in scheduling.SHORT.items()) + " END"
PLACE = "CASE state " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(scheduling.STATES)) + " END"


@query(f"""WITH m AS (SELECT user_id AS page_id, user_id // 16 AS run, event_id, ts, {NAMES} AS state, lag({NAMES}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events),
n AS (SELECT run, state, count(*) AS n FROM m WHERE back = 1 GROUP BY ALL),
l AS (SELECT run, sum(CASE WHEN state <> 'EVICTED' THEN n ELSE 0 END)::BIGINT AS active, sum(CASE WHEN state IN ('PENDING_TRIAGE', 'INTERESTING_RETAINED') THEN n ELSE 0 END)::BIGINT AS pending, string_agg({SHORT} || ':' || n, ' ' ORDER BY {PLACE}) AS states FROM n GROUP BY run),
d AS (SELECT run, count(*) FILTER (WHERE was = 'TRIAGING' AND state IN ('BORING_EVICTING', 'INTERESTING_RETAINED')) AS triaged, count(*) FILTER (WHERE was = 'TRIAGING' AND state = 'BORING_EVICTING') AS evicted FROM m GROUP BY run)
SELECT run, active, pending, triaged, evicted, states FROM l JOIN d USING (run)""")
def q_status(spark, sf):
    state = F.element_at(F.array(*[F.lit(s) for s in scheduling.STATES]), (F.col("event_id") % 7 + 1).cast("int"))
    m = src.events(spark, sf).select(F.col("user_id").alias("page_id"), F.expr("user_id div 16").alias("run"), F.struct("us", "event_id").alias("seq"), state.alias("state"))
    return scheduling.status(scheduling.replay(m), ["run"])


@query(f"WITH {TRIAGE}, e AS (SELECT *, lead(frame) OVER w AS nf FROM tri WINDOW w AS (PARTITION BY session_id, page ORDER BY ordinal)) SELECT session_id, page, idx AS lo, CASE WHEN round(z, 9) > round(nz, 9) THEN frame ELSE nf END AS peak FROM e WHERE hot AND next_idx IS NOT NULL")
def q_span_peaks(spark, sf):
    return triage.peaks(_spans(spark, sf).withColumn("z", F.round("z", 9))).select("session_id", "page", F.col("idx").alias("lo"), "peak")


@query("""WITH e AS (SELECT user_id AS session_id, floor(value * 2)::INTEGER AS x, json_extract_string(props, '$.k')::INTEGER * 5 AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT session_id, list(x ORDER BY n) AS xs, list(y ORDER BY n) AS ys FROM e WHERE n <= 1 + session_id % 24 GROUP BY session_id),
d AS (SELECT *, len(xs) AS k, list_sum(list_transform(range(1, len(xs)), lambda i: sqrt((xs[i + 1] - xs[i]) ** 2 + (ys[i + 1] - ys[i]) ** 2))) AS way, sqrt((xs[1] - xs[-1]) ** 2 + (ys[1] - ys[-1]) ** 2) AS direct FROM p)
SELECT session_id, k AS n_points, round(coalesce(way, 0), 6) + 0.0 AS distance, round(CASE WHEN k < 3 OR direct < 1 OR way = 0 THEN 1.0 ELSE direct / way END, 6) + 0.0 AS linearity, k >= 2 AND coalesce(way, 0) >= 10 AS kept,
 array_to_string(list_transform(range(0, k, 5), lambda i: xs[i + 1] || ',' || ys[i + 1]), ' ') AS sampled FROM d""")
def q_path_shapes(spark, sf):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = src.events(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 1 + user_id % 24")
    at = F.array(F.floor(F.col("value") * 2).cast("int"), F.get_json_object("props", "$.k").cast("int") * 5)
    p = e.groupBy(F.col("user_id").alias("session_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", at.alias("at")))), lambda x: x["at"]).alias("p"))
    way = vectors.path_length(F.col("p"))
    sampled = F.array_join(F.transform(vectors.strided(F.col("p"), 5), lambda q: F.concat_ws(",", q[0], q[1])), " ")
    out = p.select("session_id", F.size("p").cast("long").alias("n_points"), way.alias("distance"), vectors.linearity(F.col("p")).alias("linearity"), ((F.size("p") >= 2) & (way >= 10)).alias("kept"), sampled.alias("sampled"))
    return rounded(out, "distance", "linearity")


@query("SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1)::BIGINT AS place, ((row_number() OVER (ORDER BY ts, event_id) - 1) // 500)::BIGINT AS chunk FROM events")
def q_chunk_numbers(spark, sf):
    n = paging.numbered(src.events(spark, sf).select("event_id", "us"), ["us", "event_id"], F.floor(F.col("us") / (24 * HOUR)))
    return n.select("event_id", F.col("_at").alias("place"), F.floor(F.col("_at") / 500).alias("chunk"))


@query(f"""WITH s AS (SELECT user_id AS block, epoch_us(ts) AS us, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts), {NOW}) - epoch_us(ts) > {48 * HOUR} AS silent FROM events),
r AS (SELECT *, sum(silent::INTEGER) OVER (PARTITION BY block ORDER BY us ROWS UNBOUNDED PRECEDING) - silent::INTEGER AS run FROM s)
SELECT block, max(us) AS last_seen, count(*) AS n_signs FROM r GROUP BY block, run HAVING bool_or(silent)""")
def q_silences(spark, sf):
    return scheduling.silences(src.events(spark, sf).select(F.col("user_id").alias("block"), "us"), 48 * HOUR, NOW)


@query(f"""WITH m AS (SELECT user_id AS page_id, {NAMES} AS state, lag({NAMES}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT page_id, count(*) AS moves, count(*) FILTER (WHERE was = 'TRIAGING' AND state IN ('BORING_EVICTING', 'INTERESTING_RETAINED')) AS triaged, count(*) FILTER (WHERE was = 'TRIAGING' AND state = 'INTERESTING_RETAINED') AS retained,
count(*) FILTER (WHERE state = 'BORING_EVICTING' AND coalesce(was, '') <> 'BORING_EVICTING') AS evicted_boring, count(*) FILTER (WHERE state = 'EVICTED' AND coalesce(was, '') <> 'EVICTED') AS evicted FROM m GROUP BY page_id""")
def q_counters(spark, sf):
    state = F.element_at(F.array(*[F.lit(s) for s in scheduling.STATES]), (F.col("event_id") % 7 + 1).cast("int"))
    m = src.events(spark, sf).select(F.col("user_id").alias("page_id"), F.struct("us", "event_id").alias("seq"), state.alias("state"))
    return scheduling.replay(m).groupBy("page_id").agg(*gauges.counters())
