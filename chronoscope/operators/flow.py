"""Flow of bytes through stages: levels, rates, overflow and sustained overload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import overflow_eta

#: Microseconds that one group of a running sum covers.
BUCKET = 3_600_000_000


def levels(flow: DataFrame, key: str = "stage", at: str = "us", tie: str = "event_id", bucket_us: int = BUCKET) -> DataFrame:
    """Adds ``level``: the running sum that never falls below 0, in closed form from the plain running sum and its least value.

    Sums run within buckets of time, so that a stage's rows are many groups; a
    bucket's total and least sum carry over to those after it.
    """
    f = flow.withColumn("_b", F.floor(F.col(at) / bucket_us))
    w = Window.partitionBy(key, "_b").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("_s", F.sum("net").over(w)).withColumn("_m", F.min("_s").over(w))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = f.groupBy(key, "_b").agg(F.sum("net").alias("_total"), F.min("_s").alias("_low"))
    sums = sums.withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    sums = sums.withColumn("_least", F.coalesce(F.min(F.col("_start") + F.col("_low")).over(before), F.lit(0)))
    out = f.join(sums.select(key, "_b", "_start", "_least"), [key, "_b"])
    level = F.col("_start") + F.col("_s") - F.least(F.lit(0), F.col("_least"), F.col("_start") + F.col("_m"))
    return out.withColumn("level", level).select(*flow.columns, "level")


def rates(flow: DataFrame, window_us: int, key: str = "stage", at: str = "us", bucket_us: int = BUCKET) -> DataFrame:
    """Adds ``rate``: net bytes (whole numbers) a second over the window that ends now, its older end left out; also its rows and its span.

    Every row of the window counts, however many there are. Rows are grouped by
    buckets of time, and those that a later bucket's windows still see are read there too.
    A row enters the sums at its time and leaves them a window later, so a group takes
    one pass however many rows a window has; a row that leaves names the time after
    its own, and the latest one named is where the window begins.
    """
    size = max(bucket_us, window_us)
    bucket = lambda t: F.floor(t / size)
    f = flow.withColumn("_own", bucket(F.col(at)))
    f = f.withColumn("_b", F.explode(F.sequence("_own", bucket(F.col(at) + (window_us - 1)))))
    f = f.withColumn("_next", F.lead(at).over(Window.partitionBy(key, "_b").orderBy(at)))
    change = lambda t, sign, begins: F.struct(t.alias("_t"), F.lit(sign).alias("_n"), begins.alias("_begins"))
    leaves = F.col(at) + window_us
    enters = F.array(change(F.col(at).cast("long"), 1, F.lit(None).cast("long")))
    both = F.concat(enters, F.array(change(leaves.cast("long"), -1, F.col("_next").cast("long"))))
    f = f.select("*", F.inline(F.when(bucket(leaves) == F.col("_b"), both).otherwise(enters)))
    w = Window.partitionBy(key, "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.sum(F.when(F.col("net").isNotNull(), F.col("_n"))).over(w)
    net = F.when(known > 0, F.sum(F.col("net") * F.col("_n")).over(w))
    begins = F.coalesce(F.max("_begins").over(w), F.min("_t").over(w))
    f = f.withColumns({"rate": net / (window_us / 1_000_000), "n_window": F.sum("_n").over(w), "span_us": F.col(at) - begins})
    return f.where("_n = 1 and _own = _b").drop("_own", "_b", "_next", "_t", "_n", "_begins")


def transitions(moves: DataFrame, size: str = "bytes") -> DataFrame:
    """``page_id, seq, stage, net`` of pages that change state: a page's bytes enter the pending and the retained stage and leave them again."""
    held = lambda c: F.when(F.col(c).isin("PENDING_TRIAGE", "TRIAGING"), "pending").when(F.col(c).isin("INTERESTING_RETAINED", "REFINING"), "intret")
    m = moves.withColumns({"_from": held("was"), "_to": held("state")}).where(~F.col("_from").eqNullSafe(F.col("_to")))
    each = F.array(F.struct(F.col("_from").alias("stage"), (-F.col(size)).alias("net")), F.struct(F.col("_to").alias("stage"), F.col(size).alias("net")))
    return m.select("page_id", "seq", F.inline(each)).where("stage is not null")


def shed(rated: DataFrame, stale_pages: DataFrame, stage: str, threshold: float, least_us: int, n: int = 2) -> DataFrame:
    """The ``n`` oldest stale pages, if the stage's last rate shows that it fills too fast."""
    last = rated.where(F.col("stage") == stage).orderBy(F.desc("us"), F.desc("event_id")).limit(1)
    now = unsustainable(last, threshold, least_us).agg(F.coalesce(F.bool_or("unsustainable"), F.lit(False)))
    oldest = stale_pages.orderBy(F.desc("age"), "page_id").limit(n)
    return oldest.where(now.scalar())


def unsustainable(rated: DataFrame, threshold: float, least_us: int) -> DataFrame:
    """Adds ``unsustainable``: two events or more, over four fifths of the least time, faster than the threshold."""
    return rated.withColumn("unsustainable", (F.col("n_window") >= 2) & (F.col("span_us") >= 0.8 * least_us) & (F.col("rate") > threshold))


def overflow(flow: DataFrame, window_us: int, capacity: int) -> DataFrame:
    """Each stage's last level and rate, and the seconds until it is full."""
    last = Window.partitionBy("stage").orderBy(F.desc("us"), F.desc("event_id"))
    now = rates(levels(flow), window_us).withColumn("_r", F.row_number().over(last)).where("_r = 1")
    return now.select("stage", "level", "rate", overflow_eta(F.col("level"), F.col("rate"), F.lit(capacity)).alias("eta"))
