"""Spelling variants: words one error apart, by automata over both ends.

A pair of words that differ by one inserted, deleted or replaced code point
agrees in the first half of either word or else in its last half. Words meet by
these halves: each shard of halves builds a minimal acyclic automaton of its
words, forwards for first halves and of reversed words for last ones. A word
follows its half exactly and completes the rest with one error. States know how
many words lie below each edge, so a path adds up to the word's number in
sorted order, and numbers lead to counts.

A pair that agrees in the first half is found forwards; backwards it is left
out. Where too many words share a half, they are split into blocks, and the
words that ask for this half ask all its blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, stored

#: Letters of a word; code points and occurrences that a word has at least; a form has so many times its variant's occurrences.
LETTERS, LEAST_CHARS, LEAST_N, TIMES = "[A-Za-z\\u00C0-\\u00FF]+", 6, 5, 5
#: One of so many occurrences loses a code point (0: none does).
SLIPS = 199
#: Words of a half in one automaton at most; words of a shard on average.
BLOCK, SHARD = 100_000, 20_000
FOUND = "word string, n_near long, best_n long, best string"


class Automaton:
    """The minimal acyclic automaton of sorted different words, whose paths give each word's number."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.below: list[int] = []
        known: dict[tuple, int] = {}

        def settled(state: list) -> int:
            """The number of a state that gets no more edges: an equal one is reused."""
            final, edges = state
            key = (final, tuple(edges.items()))
            if (k := known.get(key)) is None:
                k, skip, made = len(self.edges), int(final), {}
                for c, to in edges.items():
                    made[c] = (to, skip)
                    skip += self.below[to]
                self.edges.append(made)
                self.final.append(final)
                self.below.append(skip)
                known[key] = k
            return k

        open_: list[list] = [[False, {}]]  # the states of the last word's path
        last = ""
        for word in words:
            common = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                common += 1
            for k in range(len(last), common, -1):
                open_[k - 1][1][last[k - 1]] = settled(open_.pop())
            open_ += [[False, {}] for _ in word[common:]]
            open_[-1][0] = True
            last = word
        for k in range(len(last), 0, -1):
            open_[k - 1][1][last[k - 1]] = settled(open_.pop())
        self.start = settled(open_[0])

    def follow(self, state: int, at: int, rest: str) -> tuple[int, int] | None:
        """The state and the number so far after ``rest``."""
        edges = self.edges
        for c in rest:
            if (to := edges[state].get(c)) is None:
                return None
            state, at = to[0], at + to[1]
        return state, at

    def number(self, word: str) -> int | None:
        got = self.follow(self.start, 0, word)
        return got[1] if got is not None and self.final[got[0]] else None

    def one_error(self, half: str, rest: str) -> set[int]:
        """Numbers of the words that begin with ``half`` and go on with one error in ``rest``."""
        out: set[int] = set()
        if (got := self.follow(self.start, 0, half)) is None:
            return out
        (state, at), n = got, len(rest)
        for k in range(n + 1):
            c, after = (rest[k], rest[k + 1 :]) if k < n else ("", "")
            tries = []
            if k < n and after[:1] != c:  # of equal code points in a row, the last goes
                tries.append((state, at, after))
            for d, (to, skip) in self.edges[state].items():
                if d != c:  # inserting the same code point does as much behind it
                    if k < n:
                        tries.append((to, at + skip, after))
                    tries.append((to, at + skip, rest[k:]))
            for s, a, r in tries:
                got = self.follow(s, a, r)
                if got is not None and self.final[got[0]]:
                    out.add(got[1])
            if k < n:
                if (to := self.edges[state].get(c)) is None:
                    break
                state, at = to[0], at + to[1]
        return out


def word_counts(docs: DataFrame, slips: int = SLIPS, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N) -> DataFrame:
    """``word, n``: runs of letters with A to Z in lower case, of at least so many code points and occurrences.

    If ``slips`` divides the hash of a run and its document's id, the run loses
    the code point that the hash points at. Null and empty texts have no runs, a
    null id is hashed as if empty, rows that repeat count each, a long text is
    one row, other columns are not read, and no rows give no words.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("_run"))
    runs = runs.where(F.length("_run") >= least_chars).select("_id", F.translate("_run", UPPER, LOWER).alias("_run"))
    word = F.col("_run")
    if slips:
        h = F.crc32(F.concat("_id", F.lit(":"), "_run"))
        at = (h % F.length("_run")).cast("int")
        word = F.when(h % slips == 0, F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))).otherwise(word)
    counts = runs.groupBy(word.alias("word")).agg(F.count("*").alias("n"), F.max(F.length(word)).alias("_chars"))  # the length as a maximum, so that its test isn't moved below the count
    return counts.where((F.col("n") >= least_n) & (F.col("_chars") >= least_chars)).select("word", "n")


def _halves(words: DataFrame) -> DataFrame:
    """``word, n, back, half, asks``: the halves by which a word is found, and those by which it asks.

    A word of one code point less or more splits elsewhere, so a word is found
    by each first half of a word of such a length that it could be near.
    """
    n = F.length("word")
    near = F.array(n - 1, n, n + 1)
    firsts = F.array_distinct(F.transform(near, lambda x: F.floor(x / 2).cast("int")))
    lasts = F.array_distinct(F.transform(near, lambda x: F.ceil(x / 2).cast("int")))
    struct = lambda back, own, half: lambda k: F.struct(F.lit(back).alias("back"), half(k).alias("half"), (k == own).alias("asks"))
    forward = F.transform(firsts, struct(False, F.floor(n / 2).cast("int"), lambda k: F.substring(F.col("word"), F.lit(1), k)))
    backward = F.transform(lasts, struct(True, F.ceil(n / 2).cast("int"), lambda k: F.substring(F.col("word"), n - k + 1, k)))
    return words.select("word", "n", F.inline(F.concat(forward, backward)))


def _sharded(words: DataFrame, shards: int, block: int) -> DataFrame:
    """Halves with ``shard``, ``blocks`` of the half, and ``asked``, the block that an asking row asks (null: the row is one that is found)."""
    h = _halves(words)
    large = h.groupBy("back", "half").agg(F.count("*").alias("_m")).where(F.col("_m") > block).select("back", "half", F.ceil(F.col("_m") / block).cast("int").alias("_b"))
    h = h.join(large, ["back", "half"], "left").withColumn("blocks", F.coalesce("_b", F.lit(1))).drop("_b")
    found = h.withColumn("asked", F.lit(None).cast("int")).withColumn("_block", F.pmod(F.crc32("word"), F.col("blocks")).cast("int"))
    asks = h.where("asks").withColumn("asked", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("_block", F.col("asked"))
    both = found.unionByName(asks)
    return both.select("word", "n", "back", F.pmod(F.xxhash64("half", "_block"), F.lit(shards)).alias("shard"), "blocks", "asked")


def _near(key, table) -> Iterator[tuple[str, int, list[str], list[int]]]:
    """Each asking word with the words of this shard that are near it and whose counts it is to learn."""
    back = key[0].as_py()
    turn = (lambda w: w[::-1]) if back else str
    rows = list(zip(*(table.column(c).to_pylist() for c in ("word", "n", "blocks", "asked")), strict=True))
    count = {turn(w): n for w, n, _, asked in rows if asked is None}
    words = sorted(count)
    automaton = Automaton(words)
    for w, n, blocks, asked in rows:
        if asked is None:
            continue
        own = turn(w)
        cut = (len(own) + back) // 2
        got = [words[k] for k in automaton.one_error(own[:cut], own[cut:])]
        first = w[: len(w) // 2]
        near = [v for v in map(turn, got) if (blocks == 1 or zlib.crc32(v.encode()) % blocks == asked) and not (back and v.startswith(first))]
        if near:
            yield w, n, near, [count[turn(v)] for v in near]


def _pairs(key, table):
    out = [(w, v) for w, _, near, _ in _near(key, table) for v in near]
    return pa.table({"word": pa.array([w for w, _ in out], pa.string()), "near": pa.array([v for _, v in out], pa.string())})


def _best(key, table):
    out = []
    for w, _, near, counts in _near(key, table):
        n, best = min((-n, v) for n, v in zip(counts, near, strict=True))
        out.append((w, len(near), -n, best))
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.table({"word": pa.array(cols[0], pa.string()), "n_near": pa.array(cols[1], pa.int64()), "best_n": pa.array(cols[2], pa.int64()), "best": pa.array(cols[3], pa.string())})


def _grouped(words: DataFrame, block: int, shard: int):
    spark = words.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * words.count() // shard))
    return _sharded(words, shards, block).groupBy("back", "shard")


def pairs(words: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``word, near``: each word of ``word, n`` with each other one that differs by exactly one inserted, deleted or replaced code point."""
    return _grouped(words, block, shard).applyInArrow(_pairs, "word string, near string")


def nearest(words: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``word, n_near, best_n, best`` of each word that has near words; ``best`` is the one of most occurrences, of ties the first in code-point order."""
    found = _grouped(words, block, shard).applyInArrow(_best, FOUND)
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("_b"))
    return out.select("word", "n_near", (-F.col("_b.m")).alias("best_n"), F.col("_b.w").alias("best"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """``word, root`` from ``word, form``: forms followed to the last, at most ``steps`` of them, by doubling."""
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(steps, 1))))):
        out = stored(out, "roots")
        to = out.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        out = out.join(to, out["root"] == to["_w"], "left").select("word", F.coalesce("_r", "root").alias("root"))
    return out


def variants(docs: DataFrame, slips: int = SLIPS, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of all documents; see ``word_counts`` for nulls, repeats and empty tables.

    A form has at least ``times`` the occurrences of its variant, so forms end
    after as many steps as ``times`` has powers below the largest count.
    """
    words = stored(word_counts(docs, slips, least_chars, least_n), "words")
    most = words.agg(F.max("n")).first()[0] or 1
    near = words.join(nearest(words), "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "near-words")
    last = roots(near.where("form is not null"), int(math.log(most, times)) + 1)
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each word."""
    return variants(docs)
