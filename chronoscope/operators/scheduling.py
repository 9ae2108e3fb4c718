"""Priorities, eviction and the life of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import refinement_priority

# States of a page and the steps between them.
STATES = ["PENDING_TRIAGE", "TRIAGING", "BORING_EVICTING", "INTERESTING_RETAINED", "REFINING", "ENCODING_INTERESTING", "EVICTED"]
STEPS = [
    (None, "PENDING_TRIAGE"), ("PENDING_TRIAGE", "TRIAGING"), ("TRIAGING", "BORING_EVICTING"), ("TRIAGING", "INTERESTING_RETAINED"),
    ("INTERESTING_RETAINED", "REFINING"), ("REFINING", "INTERESTING_RETAINED"), ("REFINING", "ENCODING_INTERESTING"), ("INTERESTING_RETAINED", "BORING_EVICTING"), ("ENCODING_INTERESTING", "EVICTED"), ("BORING_EVICTING", "EVICTED"),
]


def priority(work, novelty, paused=None):
    """Triage first, then paused refinement, refinement by novelty, eviction last."""
    held = F.lit(False) if paused is None else paused
    return F.when(work == "triage", 0.0).when((work == "refine") & held, 0.9).when(work == "refine", refinement_priority(novelty)).otherwise(2.0)


def next_work(items: DataFrame, n: int = 1, only: str | None = None) -> DataFrame:
    """The ``n`` items to do first; ties go by age, then page."""
    i = items if only is None else items.where(F.col("work_type") == only)
    return i.orderBy("priority", "created_at", "page_id").limit(n)


def waiting(moves: DataFrame, key: list[str]) -> DataFrame:
    """``key, us, delta`` of replayed moves: a page that begins to be retained waits (1), one that no longer is stops (-1)."""
    kept = lambda c: F.coalesce(F.col(c) == "INTERESTING_RETAINED", F.lit(False))
    return moves.where(kept("state") != kept("was")).select(*key, "us", F.when(kept("state"), 1).otherwise(-1).alias("delta"))


def forced_refinement(times: DataFrame, changes: DataFrame, rated: DataFrame, key: list[str], many: int = 3, some: int = 2, rate: float = 10 * 1024**2) -> DataFrame:
    """Adds ``waiting``, ``rate`` and ``forced`` to each of ``times``: whether refinement must go before triage.

    It must if ``many`` pages wait, or ``some`` while what they hold grows faster
    than ``rate``. ``changes`` has ``us, delta``, ``rated`` has ``us, event_id,
    rate``; those of a time count at that time, the last rate by ``event_id``.
    No change yet is none waiting, no rate yet is a rate of null, which forces
    nothing. One sort of all three by key and time.
    """
    every = times.withColumn("_side", F.lit(2)).unionByName(changes.select(*key, "us", "delta", F.lit(0).alias("_side")), allowMissingColumns=True)
    every = every.unionByName(rated.select(*key, "us", F.col("event_id").alias("_tie"), F.col("rate").alias("_rate"), F.lit(1).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("us", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = every.withColumns({"waiting": F.coalesce(F.sum("delta").over(w), F.lit(0)), "rate": F.last("_rate", ignorenulls=True).over(w)}).where("_side = 2")
    forced = (F.col("waiting") >= many) | ((F.col("waiting") >= some) & F.coalesce(F.col("rate") > rate, F.lit(False)))
    return out.withColumn("forced", forced).drop("_side", "_tie", "_rate", "delta")


#: The states as a status line writes them.
SHORT = dict(zip(STATES, ["PendT", "Triage", "BorEvict", "IntRet", "Refine", "EncInt", "Evict"], strict=True))


def status(moves: DataFrame, key: list[str]) -> DataFrame:
    """``active, pending, triaged, evicted, states`` of each key's pages after replayed moves.

    Active pages are not evicted yet, pending ones wait for triage or are kept;
    ``triaged`` counts triage's decisions and ``evicted`` those for boring pages;
    ``states`` lists how many pages are in each state that has any, in the
    states' order.
    """
    last = moves.groupBy(*key, "page_id").agg(F.max_by("state", "seq").alias("state"))
    now = last.groupBy(*key).agg(*[F.count_if(F.col("state") == s).alias(SHORT[s]) for s in STATES])
    decided = (F.col("was") == "TRIAGING") & F.col("state").isin("BORING_EVICTING", "INTERESTING_RETAINED")
    done = moves.groupBy(*key).agg(F.count_if(decided).alias("triaged"), F.count_if(decided & (F.col("state") == "BORING_EVICTING")).alias("evicted"))
    parts = [F.when(F.col(n) > 0, F.concat(F.lit(f"{n}:"), F.col(n).cast("string"))) for n in SHORT.values()]
    active = sum((F.col(n) for n in list(SHORT.values())[1:-1]), F.col("PendT"))
    return now.join(done, key).select(*key, active.alias("active"), (F.col("PendT") + F.col("IntRet")).alias("pending"), "triaged", "evicted", F.concat_ws(" ", *parts).alias("states"))


def stale(pages: DataFrame, now: int, max_age: int) -> DataFrame:
    """Retained pages that nothing has touched for longer than ``max_age``, with their age."""
    p = pages.withColumn("age", F.lit(now) - F.col("last_activity"))
    return p.where((F.col("state") == "INTERESTING_RETAINED") & (F.col("age") > max_age))


def evict(pages: DataFrame, now: int, max_age: int, n: int = 2) -> DataFrame:
    """The ``n`` stale pages to evict: oldest first, then least novel."""
    return stale(pages, now, max_age).orderBy(F.desc("age"), F.coalesce("novelty", F.lit(0.0)), "page_id").limit(n)


def replay(moves: DataFrame) -> DataFrame:
    """State changes with the state before each and whether the step is one that exists."""
    spark = moves.sparkSession
    steps = spark.createDataFrame(STEPS, "was string, state string").withColumn("valid", F.lit(True))
    w = Window.partitionBy("page_id").orderBy("seq")
    m = moves.withColumn("was", F.lag("state").over(w)).alias("m")
    s = F.broadcast(steps).alias("s")
    return m.join(s, F.col("m.was").eqNullSafe(F.col("s.was")) & (F.col("m.state") == F.col("s.state")), "left").select("m.*", F.coalesce("s.valid", F.lit(False)).alias("valid"))


def timeouts(blocks: DataFrame, limit: int, at: str = "us") -> DataFrame:
    """Blocks whose last sign of life is older than ``limit`` at the latest time of all."""
    last = blocks.groupBy("block").agg(F.max(at).alias("last_seen"), F.count("*").alias("n_signs"))
    return last.withColumn("now", blocks.agg(F.max(at)).scalar()).where(F.col("now") - F.col("last_seen") > limit)


def silences(signs: DataFrame, limit: float, end: float, at: str = "us") -> DataFrame:
    """``block, last_seen, n_signs`` for each time a block gave no sign for longer than ``limit``, up to ``end``; signs are counted since the silence before."""
    w = Window.partitionBy("block").orderBy(at)
    after = F.coalesce(F.lead(at).over(w), F.lit(end))
    s = signs.select("block", at, (after - F.col(at) > limit).alias("_silent"))
    s = s.withColumn("_run", F.sum(F.col("_silent").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_silent").cast("int"))
    return s.groupBy("block", "_run").agg(F.max(at).alias("last_seen"), F.count("*").alias("n_signs"), F.bool_or("_silent").alias("_ends")).where("_ends").drop("_run", "_ends")


def admitted(jobs: DataFrame, depth: int, capacity: int, key: list[str], order: list[str]) -> DataFrame:
    """The jobs that a queue of ``depth`` waiting still takes, in order; the rest are shed."""
    w = Window.partitionBy(*key).orderBy(*order)
    return jobs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= capacity - depth)


def published(events: DataFrame, threshold: float, key: list[str], z: str = "z", seq: str = "seq") -> DataFrame:
    """Events above the threshold with their place in the order of falling z, then of arrival."""
    w = Window.partitionBy(*key).orderBy(F.desc(z), seq)
    return events.where(F.col(z) > threshold).withColumn("place", F.row_number().over(w))
