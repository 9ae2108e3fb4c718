"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio against the corpus.

Two multinomials over hashed 1- and 2-grams are estimated: one from trusted
documents, one from all documents. A document's score is the mean over its
n-grams of log p_trusted - log p_corpus, so its length does not matter. The
fewer documents are trusted, the more of a plain text's n-grams are unseen and
the lower it scores, so the threshold is set between the labels: trusted
documents are scored as if each were not trusted, and bad ones as they are.
Everything runs as DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, once, stored, words

SYMBOLS = "#*$%&|<>"
#: Cells of the hashed multinomials: the size of what is broadcast is fixed by it.
CELLS = 1 << 15
#: Pseudo-count of each cell, in words of the target.
ALPHA = 1.0
#: A document passes from this mean log ratio on where labels of one kind are missing; see ``parting``.
THRESHOLD = -0.08
#: Scores are counted in so many steps a unit, so that the threshold follows from counts alone.
STEPS = 4096
#: Up to so many trusted ids are broadcast; more are joined by a shuffle of ids and texts.
MARKS = 2_000_000
#: The share of good documents that may fall below the threshold, and of bad ones that may lie above the edge of their scores.
LOST = 0.01


def grams(ws: Column, cells: int) -> Column:
    """The cells of a word array's 1- and 2-grams, each occurrence once."""
    one = F.transform(ws, lambda w: F.pmod(F.xxhash64(w), F.lit(cells)).cast("int"))
    two = F.transform(F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(F.get(ws, i), w), F.lit(cells)).cast("int"))
    return F.concat(one, two)


def base_columns(docs: DataFrame, text: str = "_text", ws: str = "_ws") -> DataFrame:
    """Adds the base counts, from a text and its word array.

    Words of repeated 3-word windows are found without grouping rows: where a
    text's windows aren't all different, they are sorted by fingerprint within
    their array, those equal to a neighbour give their places, and sorted places
    cover min(3, gap) words each.
    """
    t = F.col(text)
    plain = t
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    w = F.col(ws)
    hashes = F.transform(F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))), lambda c, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), c))
    docs = once(
        docs, n_words=F.size(ws).cast("long"), word_chars=F.length(F.array_join(ws, "")).cast("long"),
        n_symbols=(F.length(t) - F.length(plain)).cast("long"), _lines=lines, _hash=hashes,
    )
    h = F.col("_hash")
    found = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    docs = once(docs, _win=found).drop("_hash")
    s = F.col("_win")
    twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, i + 1)["h"]).eqNullSafe(True))
    docs = once(docs, _at=F.sort_array(F.transform(twice, lambda x: x["p"])))
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return once(docs, n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long")).drop("_lines", "_win", "_at")


def trusted(labels: DataFrame) -> DataFrame:
    """The ids of all documents of good quality; null labels and ids are none."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def marked(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``docs`` with ``_good``: whether the document is in the target; texts move only where its ids are too many to broadcast."""
    marks = target.select(F.col("doc_id").alias("_id"))
    marks = F.broadcast(marks) if target.count() <= MARKS else marks.hint("shuffle_hash")  # texts are dealt by id, not sorted
    return docs.join(marks, F.col("doc_id") == F.col("_id"), "left").withColumn("_good", F.col("_id").isNotNull()).drop("_id")


def cell_counts(docs: DataFrame, target: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row with arrays of ``cells`` counts, ``n`` over every document and ``t`` over the target, and their sums ``all_n`` and ``all_t``."""
    each = once(marked(docs.select("doc_id", "text"), target), _ws=words(F.col("text")))
    each = each.select(F.explode(grams(F.col("_ws"), cells)).alias("cell"), F.col("_good").cast("int").alias("good"))
    counts = each.groupBy("cell").agg(F.count("*").alias("n"), F.sum("good").alias("t"))
    full = docs.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left")
    rows = full.agg(F.sort_array(F.collect_list(F.struct("cell", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0)).alias("t")))).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    return rows.select(F.col("c.n").alias("n"), F.col("c.t").alias("t"), "all_n", "all_t")


def log_ratio(t: Column, n: Column, all_t: Column, all_n: Column, alpha: float = ALPHA) -> Column:
    """With the corpus scaled to the target's size, both have the same pseudo-counts and the same total."""
    scale = F.coalesce(all_t / F.nullif(all_n, F.lit(0)), F.lit(0.0))
    return F.log((t + alpha) / (n * scale + alpha))


def mean_ratio(items: Column, ratios: Column) -> Column:
    """The mean of the ratios of an array's cells; null for an empty one."""
    return F.aggregate(items, F.lit(0.0), lambda a, g: a + F.get(ratios, g)) / F.nullif(F.size(items), F.lit(0))


def held_out(cells: Column, size: Column, t: Column, n: Column, all_t: int, all_n: int) -> Column:
    """The score that a document of the target would have outside it: its own n-grams leave the target, not the corpus.

    ``cells`` are its runs of equal cells: ``c`` the cell, ``own`` its count; ``size`` counts all n-grams.
    """
    each = F.transform(cells, lambda r: r["own"] * log_ratio(F.get(t, r["c"]) - r["own"], F.get(n, r["c"]), all_t - size, F.lit(all_n)))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.nullif(size, F.lit(0))


def scored(docs: DataFrame, labels: DataFrame, cells: int = CELLS) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``score`` and ``_held`` added, the score with the document's own n-grams held out of the target."""
    target = stored(trusted(labels), "quality-trusted")
    counts = stored(cell_counts(docs, target, cells), "quality-counts")
    sums = counts.select("all_t", "all_n").first()
    ratios = counts.select(F.transform(F.arrays_zip("t", "n"), lambda x: log_ratio(x["t"], x["n"], F.col("all_t"), F.col("all_n"))))
    out = base_columns(once(marked(docs, target), _text=F.coalesce("text", F.lit("")), _ws=words(F.col("text"))))
    out = once(out, _grams=grams(F.col("_ws"), cells)).drop("_text", "_ws")
    # each array of the model is a column used once, right where it is made: the optimiser puts it in its place, and it is part of no row
    out = out.withColumn("_ratios", ratios.scalar()).withColumn("score", mean_ratio(F.col("_grams"), F.col("_ratios"))).drop("_ratios")
    out = once(out, _sorted=F.when(F.col("_good"), F.sort_array("_grams"))).drop("_grams")
    s = F.col("_sorted")
    out = once(out, _starts=F.filter(F.transform(s, lambda x, i: F.when(x.eqNullSafe(F.get(s, i - 1)), None).otherwise(i)), lambda i: i.isNotNull()))
    at = F.col("_starts")
    runs = F.transform(at, lambda p, i: F.struct(F.get(s, p).alias("c"), (F.coalesce(F.get(at, i + 1), F.size(s)) - p).alias("own")))
    out = once(out, _runs=runs, _size=F.size(s)).drop("_sorted", "_starts")
    out = out.withColumns({"_t": counts.select("t").scalar(), "_n": counts.select("n").scalar()})
    out = out.withColumn("_held", F.when(F.col("_good"), held_out(F.col("_runs"), F.col("_size"), F.col("_t"), F.col("_n"), sums["all_t"], sums["all_n"])).otherwise(F.col("score"))).drop("_runs", "_size", "_good", "_t", "_n")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.withColumn("base_failed", failed)


def parting(scores: DataFrame, labels: DataFrame, lost: float = LOST) -> DataFrame:
    """One row with the threshold between the labels, among documents that the base rules pass.

    It is midway between the score below which ``lost`` of the good documents
    lie, held out, and the one above which ``lost`` of the bad ones lie; where
    these overlap it is the former, so plain text stays if there is too little
    to tell it from junk. Scores are counted in steps, of which there are few
    whatever the table's size, and a step's lower edge stands for good scores in
    it, its upper one for bad ones: the threshold is the same for any layout.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_q"))
    each = scores.where(~F.col("base_failed") & F.col("_held").isNotNull()).select("doc_id", "_held").join(known, "doc_id")
    steps = each.groupBy("_q", F.floor(F.col("_held") * STEPS).alias("_step")).agg(F.count("*").alias("_n"))
    of_kind = Window.partitionBy("_q")
    steps = steps.withColumns({"_so_far": F.sum("_n").over(of_kind.orderBy("_step")), "_all": F.sum("_n").over(of_kind)})
    first = lambda q, share: F.min(F.when((F.col("_q") == q) & (F.col("_so_far") >= F.col("_all") * share), F.col("_step")))
    edges = steps.agg((first(1, lost) / STEPS).alias("low"), ((first(0, 1 - lost) + 1) / STEPS).alias("high"))
    alone = F.least(F.col("low"), F.lit(THRESHOLD))
    return edges.select(F.when(F.col("low").isNull() | F.col("high").isNull(), alone).when(F.col("high") < F.col("low"), (F.col("low") + F.col("high")) / 2).otherwise(F.col("low")))


def verdicts(scores: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """``scores`` with ``kept`` added; without a threshold they are stored, and what they show of the labels gives it."""
    if threshold is None:
        scores = stored(scores, "quality-scores")
        limit = parting(scores, labels).scalar()
    else:
        limit = F.lit(threshold)
    return scores.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= limit, F.lit(False))).drop("_held")


#: The columns that ``judge`` adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def judge(docs: DataFrame, labels: DataFrame, cells: int = CELLS, threshold: float | None = None) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``score`` and ``kept`` added.

    Null and empty texts have no words, fail the base rules and have no score;
    without trusted labels all ratios are 0; a long text is one row, judged
    whole; rows that repeat are judged alike; no rows give no rows; other columns
    pass through whatever their names, those of a name that is added are replaced.
    """
    other = [c for c in docs.columns if c not in ("doc_id", "text", *ADDED)]
    packed = docs.select("doc_id", "text", *([F.struct(*[F.col(f"`{c}`") for c in other]).alias("_rest")] if other else []))
    out = verdicts(scored(packed, labels, cells), labels, threshold)
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`") for c in docs.columns if c not in ADDED], *ADDED)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for each document, and the score."""
    out = verdicts(scored(docs.select("doc_id", "text"), labels).drop("text"), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
