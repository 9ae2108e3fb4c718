"""MinHash near-duplicates with tensored banding, verified on full sets.

A document's set is that of its distinct word shingles. Two collections of t
hashes each (a hash joins ``ROWS`` minhash values) are computed; every pair of
one hash from either collection is the key of a table, so t * t tables cost
2 * t hashes. Equal sets are one class from the start; classes
that share a key are candidates and are verified on their whole sets.

A table's bucket is never expanded into all its pairs: each member meets the
bucket's first. Verified links give components. Where a candidate pair is in two
components, all classes of both then meet the most typical of those that share
a rare shingle with them, and what is still apart meets in an exact
prefix-filtered join, so that no link of a large bucket is lost and none has to
be capped: of two similar classes in a bucket, each is in a component that such
a pair leaves.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .components import components
from .packed import deal, group_starts, merged, ranges, rows
from .shared import spread, stored

#: Minhash values in each hash, and the chance at most that a pair just at the threshold shares no key.
ROWS, MISS = 2, 1e-4
BLOOM_BITS = 1 << 26


def collection_size(percent: int) -> int:
    """Hashes in each of the two collections: with similarity s, t of them share a key with probability (1 - (1 - s^ROWS)^t)^2."""
    return math.ceil(math.log(MISS / 2) / math.log(1 - (percent / 100) ** ROWS)) if percent < 100 else 1


def shingle_sets(b: pa.RecordBatch, k: int, column: str = "text"):
    """Blocks of rows of a batch: (first row, sets as one array, a second fingerprint of each shingle, n + 1 bounds). Each set is sorted; shingles are one if both fingerprints agree."""
    data, off = wh.text_buffers(b.column(b.schema.names.index(column)))
    for i, j in wh.pieces(off):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, bounds = wh.word_bounds(d, o, "space")
        n = np.diff(bounds)
        row = wh.row_of(bounds)
        whole = np.flatnonzero(np.arange(len(s)) + k <= bounds[1:][row]) if len(s) else np.zeros(0, np.int64)
        short = np.flatnonzero((n > 0) & (n < k))  # the whole sequence is the one shingle
        w, w2 = (_shingles(wh.word_hashes(d, s, e, seed, fold=True), k, whole, bounds, n, short) for seed in (0, 1))
        row = np.concatenate([row[whole], short])
        order = np.lexsort((w, row))
        w, w2, row = w[order], w2[order], row[order]
        if len(w):
            near = (w[1:] == w[:-1]) & (row[1:] == row[:-1])
            if (near & (w2[1:] != w2[:-1])).any():  # shingles that differ agree in their first fingerprint
                order = np.lexsort((w2, w, row))
                w, w2, row = w[order], w2[order], row[order]
            keep = np.ones(len(w), bool)
            keep[1:] = (w[1:] != w[:-1]) | (w2[1:] != w2[:-1]) | (row[1:] != row[:-1])
            w, w2, row = w[keep], w2[keep], row[keep]
        yield i, w, w2, np.searchsorted(row, np.arange(j - i + 1))


def _shingles(h: np.ndarray, k: int, whole: np.ndarray, bounds: np.ndarray, n: np.ndarray, short: np.ndarray) -> np.ndarray:
    few = [wh.window_hashes(h[bounds[r] : bounds[r + 1]], int(n[r]), seed=1)[0] for r in short]
    return np.concatenate([wh.window_hashes(h, k)[whole], np.array(few, wh.U)])


def set_print(w: np.ndarray, w2: np.ndarray) -> bytes:
    """The name of a set: BLAKE2 over two independent fingerprints of each shingle."""
    return hashlib.blake2b(w.tobytes() + w2.tobytes(), digest_size=16).digest()


def half_keys(sets: np.ndarray, bounds: np.ndarray, t: int, rows: int = ROWS) -> np.ndarray:
    """For each set (none empty), its 2 * t hashes of ``rows`` minhash values each."""
    out = np.zeros((len(bounds) - 1, 2 * t), wh.U)
    for c in range(2 * t):
        for r in range(rows):
            seed = wh.U((c * rows + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            x = (sets ^ seed) * wh.U(0xD6E8FEB86659FD93)
            x ^= x >> wh.U(32)
            x *= wh.U(0xBF58476D1CE4E5B9)
            out[:, c] = wh.mix(out[:, c] * wh.U(31) + np.minimum.reduceat(x, bounds[:-1]))
    return out


PACKED = "bucket long, k binary, v binary"
SKETCH = "doc_id long, row long, n_shingles long, print binary, halves binary"


def _sketch(k: int, t: int):
    """Size, print and half keys of each document's set."""

    def run(batches):
        for b in batches:
            n, prints, halves = np.zeros(b.num_rows, np.int64), [None] * b.num_rows, [None] * b.num_rows
            for i, sets, second, bounds in shingle_sets(b, k):
                full = np.flatnonzero(np.diff(bounds) > 0)
                if not len(full):
                    continue
                n[i : i + len(bounds) - 1] = np.diff(bounds)
                h = half_keys(sets, np.append(bounds[full], len(sets)), t)
                for at, r in enumerate(full):
                    x, y = bounds[r], bounds[r + 1]
                    prints[i + r] = set_print(sets[x:y], second[x:y])
                    halves[i + r] = h[at].tobytes()
            ids, row = (b.column(b.schema.names.index(c)) for c in ("doc_id", "row"))
            yield pa.RecordBatch.from_arrays([ids, row, pa.array(n), pa.array(prints, pa.binary()), pa.array(halves, pa.binary())], ["doc_id", "row", "n_shingles", "print", "halves"])

    return run


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def _stars(keys: np.ndarray, reps: np.ndarray):
    """Sorted keys with the least of each key's members, and pairs of it with every other."""
    order = np.lexsort((reps, keys))
    keys, reps = keys[order], reps[order]
    start = group_starts(keys)
    leader = np.repeat(reps[start], np.diff(np.append(start, len(keys))))
    other = leader != reps
    return keys[start], reps[start], leader[other], reps[other]


def _table_keys(batches):
    """Keys of all tables and the classes that have them, by a task's blocks of rows."""
    for b in batches:
        for at in range(0, b.num_rows, 20_000):
            x = b.slice(at, 20_000)
            reps = x.column(x.schema.names.index("rep")).to_numpy(zero_copy_only=False)
            half = np.frombuffer(b"".join(x.column(x.schema.names.index("halves")).to_pylist()), wh.U).reshape(len(reps), -1)
            t = half.shape[1] // 2
            tables = [wh.mix(half[:, i] * wh.U(31) + half[:, t + j] + wh.U((i * t + j + 1) * 0x9E3779B9)) for i in range(t) for j in range(t)]
            yield np.concatenate(tables), np.tile(reps, t * t)


def _near(inside: bool, n: int):
    """Pairs that meet within a block of a task, or what the block sends to the buckets."""

    def run(batches):
        for keys, reps in _table_keys(batches):
            keys, reps, a, b = _stars(keys, reps)
            if inside:
                if len(a):
                    yield _pairs_batch(a, b)
            else:
                yield rows(["k", "v"], list(deal(keys, [reps], n)))

    return run


def _meet(t: pa.Table) -> pa.Table:
    _, _, a, b = _stars(merged(t, "k", wh.U), merged(t, "v", np.int64))
    return pa.Table.from_batches([_pairs_batch(a, b)])


def candidates(classes: DataFrame, n: int) -> DataFrame:
    """``a, b``: each class that shares a key with others, with the first of them."""
    local = classes.select("rep", "halves").mapInArrow(_near(True, n), "a long, b long")
    met = classes.select("rep", "halves").mapInArrow(_near(False, n), PACKED).groupBy("bucket").applyInArrow(_meet, "a long, b long")
    return local.unionByName(met).distinct()


def _sets(table, k: int):
    """The sets of documents that a filter of fixed size may hold, with their texts."""

    def run(batches):
        bits = table.value
        for b in batches:
            at = b.column(b.schema.names.index("_slot")).to_numpy(zero_copy_only=False)
            b = b.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            for i, sets, second, bounds in shingle_sets(b, k):
                cut = list(zip(bounds[:-1], bounds[1:], strict=True))
                out = [pa.array([set_print(sets[x:y], second[x:y]) for x, y in cut], pa.binary()), pa.array(np.diff(bounds).astype(np.int64)), pa.array([sets[x:y].tobytes() for x, y in cut], pa.binary())]
                yield pa.RecordBatch.from_arrays([*out, b.column(b.schema.names.index("text")).slice(i, len(cut))], ["print", "n", "items", "text"])

    return run


def slot(c: str):
    return F.pmod(F.xxhash64(c), F.lit(BLOOM_BITS))


def bitmap(ids: DataFrame, c: str) -> np.ndarray:
    """A bitmap of hashed ids; its size is fixed, so it may be broadcast."""
    s = ids.select((slot(c) + 1).alias("s")).select(F.bitmap_bucket_number("s").alias("b"), F.bitmap_bit_position("s").alias("p"))
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in s.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect():
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def word_set(text: str, k: int) -> set[tuple[bytes, ...]]:
    """A text's shingles as words."""
    ws = text.encode().translate(_FOLD).split()
    return set(zip(*(ws[i:] for i in range(k)), strict=False)) if len(ws) >= k else {tuple(ws)}


def _similar(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _verified(percent: int, k: int):
    """The pairs that are similar by their fingerprints and then by their words."""

    def run(batches):
        for x in batches:
            keep = []
            for p, q, s, t in zip(*(x.column(c) for c in ("items_a", "items_b", "text_a", "text_b")), strict=True):
                p, q = np.frombuffer(p.as_py(), wh.U), np.frombuffer(q.as_py(), wh.U)
                same = _similar(len(p), len(q), len(np.intersect1d(p, q, assume_unique=True)), percent)
                if same:
                    u, v = word_set(s.as_py(), k), word_set(t.as_py(), k)
                    same = _similar(len(u), len(v), len(u & v), percent)
                keep.append(same)
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str, *more: str) -> DataFrame:
    left = sets.select(F.col("rep").alias(a), *(F.col(c).alias(f"{c}_a") for c in ("items", *more)))
    right = sets.select(F.col("rep").alias(b), *(F.col(c).alias(f"{c}_b") for c in ("items", *more)))
    return pairs.join(left, a).join(right, b)


def verify(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    size = sets.select("rep", "n")
    sized = pairs.join(size.toDF("a", "n_a"), "a").join(size.toDF("b", "n_b"), "b")
    fit = sized.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b")
    whole = _with_sets(fit, sets, "a", "b", "text").select("a", "b", "items_a", "items_b", "text_a", "text_b")
    return whole.mapInArrow(_verified(percent, k), "a long, b long")


def _tokens(n: int):
    def run(batches):
        for x in batches:
            sets = [np.frombuffer(v, wh.U) for v in x.column(x.schema.names.index("items")).to_pylist()]
            reps = x.column(x.schema.names.index("rep")).to_numpy(zero_copy_only=False)
            if len(sets):
                yield rows(["k", "v"], list(deal(np.concatenate(sets), [np.repeat(reps, [len(s) for s in sets])], n)))

    return run


def _shared_tokens(t: pa.Table) -> pa.Table:
    """For each class, its tokens that other classes have too, with how many do."""
    keys, reps = merged(t, "k", wh.U), merged(t, "v", np.int64)
    order = np.argsort(keys, kind="stable")
    keys, reps = keys[order], reps[order]
    start = group_starts(keys)
    df = np.repeat(np.diff(np.append(start, len(keys))), np.diff(np.append(start, len(keys))))
    keep = df > 1
    keys, reps, df = keys[keep], reps[keep], df[keep]
    order = np.argsort(reps, kind="stable")
    keys, reps, df = keys[order], reps[order], df[order].astype(np.int32)
    start = group_starts(reps)
    cut = ranges(start, len(reps))
    return pa.table({"rep": pa.array(reps[start]), "k": pa.array([keys[i:j].tobytes() for i, j in cut], pa.binary()), "d": pa.array([df[i:j].tobytes() for i, j in cut], pa.binary())})


def _prefixes(percent: int):
    """The tokens of each class's prefix in the order of rarity that others have too, with the class's size and its tokens that no other has."""

    def run(batches):
        for x in batches:
            out = []
            for rep, n, k, d in zip(*(x.column(x.schema.names.index(c)).to_pylist() for c in ("rep", "n", "k", "d")), strict=True):
                keys, df = np.frombuffer(b"".join(k), wh.U), np.frombuffer(b"".join(d), np.int32)
                own = n - len(keys)
                room = n + (-n * percent // 100) + 1 - own  # the order begins with tokens that no other class has
                if room > 0:
                    out.append((rep, n, own, keys[np.lexsort((keys, df))[:room]].view(np.int64)))
            if out:
                reps, sizes, owns, toks = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (reps, sizes, owns)), pa.array(toks, pa.list_(pa.int64()))], ["rep", "n", "q", "toks"])

    return run


def prefixes(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``rep, n, q, toks``: each class's size, how many of its tokens no other class has, and its prefix tokens that others have."""
    mine = sets.join(apart, "rep", "left_semi")
    n = spread(sets.sparkSession, 16 * (mine.agg(F.sum("n")).first()[0] or 0))
    tokens = mine.select("rep", "items").mapInArrow(_tokens(n), PACKED)
    shared = tokens.groupBy("bucket").applyInArrow(_shared_tokens, "rep long, k binary, d binary")
    lists = shared.groupBy("rep").agg(F.collect_list(F.struct("k", "d")).alias("x")).select("rep", F.col("x.k").alias("k"), F.col("x.d").alias("d"))
    return lists.join(sets.select("rep", "n"), "rep").select("rep", "n", "k", "d").mapInArrow(_prefixes(percent), "rep long, n long, q long, toks array<long>")


def leaders(first: DataFrame) -> DataFrame:
    """``rep, lead`` for each class and each most typical one of those that share a prefix token with it: that with the least share of tokens of its own. ``best`` marks the most typical of all."""
    rows = first.select("rep", F.struct((F.col("q") / F.col("n")).alias("share"), F.col("rep")).alias("me"), F.explode("toks").alias("tok"))
    by = rows.groupBy("tok").agg(F.min("me").alias("lead"))
    met = rows.join(by, "tok").select("rep", "lead").distinct()
    best = met.groupBy("rep").agg(F.min("lead").alias("first"))
    return met.join(best, "rep").select("rep", F.col("lead.rep").alias("lead"), (F.col("lead") == F.col("first")).alias("best"))


#: Longs of bits that tell what a class lacks of its leader.
LACKS = 4


def _against_lead(batches):
    """A row for each prefix token of a class, with what its set has in common with its leader's.

    ``a`` tokens are the leader's too; ``x`` are not, nor in the prefix, but
    other classes have them; ``inside`` tells that the token is the leader's.
    ``lacks`` has a bit set for each hash of a token that only the leader has.
    """
    for t in batches:
        cols: dict[str, list] = {c: [] for c in ("tok", "rep", "n", "q", "lead", "a", "x", "inside", "lacks")}
        for rep, n, q, toks, lead, p, r in zip(*(t.column(t.schema.names.index(c)) for c in ("rep", "n", "q", "toks", "lead", "items_a", "items_b")), strict=True):
            mine, other = np.frombuffer(p.as_py(), wh.U), np.frombuffer(r.as_py(), wh.U)
            tok = toks.values.to_numpy(zero_copy_only=False)
            lacks = other[~np.isin(other, mine, assume_unique=True)]
            a = len(other) - len(lacks)
            bits = np.zeros(64 * LACKS, np.uint8)
            bits[((lacks >> wh.U(7)) % wh.U(64 * LACKS)).astype(np.int64)] = 1
            inside = np.isin(tok.view(wh.U), other)
            k, alone = len(tok), 0 if rep.as_py() == lead.as_py() else q.as_py()
            x = max(0, n.as_py() - a - alone - int((~inside).sum()))
            for c, v in (("rep", rep.as_py()), ("n", n.as_py()), ("q", q.as_py()), ("lead", lead.as_py()), ("a", a), ("x", x), ("lacks", np.packbits(bits).view(np.int64).tolist())):
                cols[c] += [v] * k
            cols["tok"] += tok.tolist()
            cols["inside"] += inside.tolist()
        kinds = {"inside": pa.bool_(), "lacks": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in cols.items()], list(cols))


def profiled(first: DataFrame, lead: DataFrame, sets: DataFrame) -> DataFrame:
    """The profile of each class at each of its prefix tokens."""
    one = first.join(lead.where("best").select("rep", "lead"), "rep")
    return _with_sets(one, sets, "rep", "lead").mapInArrow(_against_lead, "tok long, rep long, n long, q long, lead long, a long, x long, inside boolean, lacks array<long>")


def _most(u, v, each: bool):
    """What two classes' sets have in common at most, by their profiles; ``each`` tells that these are of single classes."""
    hidden = F.least(u("x_hi") + v("x_hi"), F.greatest(u("n_hi") - u("a_lo"), F.lit(0)), F.greatest(v("n_hi") - v("a_lo"), F.lit(0)))
    own = F.least(u("n_hi") - u("q_lo"), v("n_hi") - v("q_lo"))
    only = (lambda x, y: sum(F.bit_count(y("lacks")[k].bitwiseAND(F.bitwise_not(x("lacks")[k]))) for k in range(LACKS))) if each else lambda x, y: 0
    theirs = F.least(u("a_hi") - only(u, v), v("a_hi") - only(v, u))  # of the leader's tokens; bits that one alone has are tokens that it alone lacks
    beside = F.when(u("inside"), hidden).otherwise(F.least(u("o_hi"), v("o_hi")))  # at a token that their leader lacks, any that it lacks may be common
    return F.when(u("lead") == v("lead"), F.least(own, theirs + beside)).otherwise(own)


def _may(u, v, percent: int, each: bool = False):
    """Whether any two classes of such profiles may be similar; profiles have bounds of ``n``, ``a``, ``x``, ``o`` and ``q``."""
    most = _most(u, v, each)
    return most * 100 >= (u("n_lo") + v("n_lo") - most) * percent


_BOUNDS = {"n_lo": F.min, "n_hi": F.max, "a_lo": F.min, "a_hi": F.max, "x_hi": F.max, "o_hi": F.max, "q_lo": F.min}

#: Profiles are rounded to cells in steps of 1 in this many; the coarser, the more pairs of classes just below the threshold are looked at.
STEPS = 200


def _named(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(c + suffix) for c in df.columns if c not in keys))


def prefix_pairs(rows: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes in different components that share a token of both prefixes and may be similar; every similar pair is among them.

    Of two classes with one leader, those that share a prefix token which it
    lacks meet there; the others share at most what both have of it, and
    tokens that a prefix doesn't show. Whether two may be similar depends on
    their profiles alone. Profiles are rounded to cells, of which a token has
    a bounded number for each leader, however many classes have it: cells are
    paired first, components of cells that pass next, and classes of these last,
    each pair at one token alone.
    """
    rows = rows.join(comp, "rep")
    rows = rows.withColumn("o", F.greatest(F.col("n") - F.col("a") - F.col("q"), F.lit(0)))  # others have them, the leader doesn't; 0 for the leader itself
    share = lambda c: F.floor(F.col(c) * STEPS / F.col("n"))
    rows = rows.withColumn("cell", F.xxhash64("lead", "inside", F.floor(F.log("n") * STEPS), share("a"), share("q"), share("x")))
    rows = rows.select("tok", "cell", "comp", "rep", "lead", "inside", "lacks", *(F.col(c[0]).alias(c) for c in _BOUNDS))
    rows = stored(rows, "profiles")
    cells = rows.groupBy("tok", "cell", "lead", "inside").agg(*(f(c).alias(c) for c, f in _BOUNDS.items()), F.min("comp").alias("least"), F.max("comp").alias("last"))
    u, v = (lambda c: F.col(f"{c}_1")), (lambda c: F.col(f"{c}_2"))
    met = _named(cells, ["tok"], "_1").join(_named(cells, ["tok"], "_2"), "tok")
    several = (u("least") != v("least")) | (u("least") != u("last")) | (v("least") != v("last"))
    met = met.where((u("cell") <= v("cell")) & several & _may(u, v, percent)).select("tok", "cell_1", "cell_2").distinct()
    groups = rows.select("tok", "cell", "comp").distinct()
    met = met.join(groups.toDF("tok", "cell_1", "comp_1"), ["tok", "cell_1"]).join(groups.toDF("tok", "cell_2", "comp_2"), ["tok", "cell_2"])
    met = stored(met.where("comp_1 < comp_2 or cell_1 <> cell_2 and comp_1 <> comp_2"), "cells")
    lists = rows.groupBy("rep").agg(F.collect_list(F.when(~F.col("inside"), F.col("tok"))).alias("outs"), F.collect_list(F.when(F.col("inside"), F.col("tok"))).alias("ins"))
    some = rows.join(met.select("tok", F.col("cell_2").alias("cell"), F.col("comp_2").alias("comp")).distinct(), ["tok", "cell", "comp"], "left_semi")
    left = met.join(_named(rows, ["tok"], "_1"), ["tok", "cell_1", "comp_1"]).join(_named(lists, [], "_1"), "rep_1")
    right = _named(some.join(lists, "rep"), ["tok"], "_2")
    met = left.join(right, ["tok", "cell_2", "comp_2"]).where(_may(u, v, percent, True) & (F.col("tok") == _meeting(u, v)))
    return met.select(F.least("rep_1", "rep_2").alias("a"), F.greatest("rep_1", "rep_2").alias("b")).distinct()


def _meeting(u, v):
    """The one token at which two classes meet: of those that both prefixes share, the least that a common leader lacks, else the least."""
    shared = lambda x, y: F.array_min(F.array_intersect(x, y))
    every = shared(F.concat(u("outs"), u("ins")), F.concat(v("outs"), v("ins")))
    return F.when(u("lead") == v("lead"), F.coalesce(shared(u("outs"), v("outs")), shared(u("ins"), v("ins")))).otherwise(every)


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (each class's component, and other columns) after links between classes join components."""
    name = comp.select("rep", "comp")
    edges = links.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return renamed(comp, edges)


def renamed(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """``comp`` after edges between components join these."""
    merged_ = components(edges).toDF("comp", "_least")
    return stored(comp.join(merged_, "comp", "left").withColumn("comp", F.coalesce("_least", "comp")).select(comp.columns), "components")


def judged(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, row, n_shingles, component_id`` for each row of ``docs``; ``row`` is a hash of its text."""
    spark = docs.sparkSession
    t = collection_size(percent)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    base = stored(known.mapInArrow(_sketch(k, t), SKETCH), "sketches")
    full = base.where("doc_id is not null and n_shingles > 0")
    classes = full.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.min("halves").alias("halves"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    n = spread(spark, 16 * t * t * classes.count())
    pairs = stored(candidates(classes, n), "candidates")
    inside = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    inside = stored(classes.select("rep", "print", "doc_id").join(inside, "rep", "left_semi"), "inside")
    table = spark.sparkContext.broadcast(bitmap(inside, "doc_id"))
    some = known.where("doc_id is not null").withColumn("_slot", slot("doc_id")).mapInArrow(_sets(table, k), "print binary, n long, items binary, text string")
    sets = stored(some.join(inside.select("print", "rep"), "print").drop("print").dropDuplicates(["rep"]), "sets")
    comp = renamed(sets.select("rep", F.col("rep").alias("comp")), verify(pairs, sets, k, percent))  # each class is its own component still
    parted = pairs.join(comp.toDF("a", "x"), "a").join(comp.toDF("b", "y"), "b").where("x <> y")
    open_ = parted.select(F.explode(F.array("x", "y")).alias("comp")).distinct()
    apart = stored(comp.join(open_, "comp", "left_semi").select("rep"), "apart")
    if not apart.isEmpty():
        first = stored(prefixes(apart, sets, percent), "prefixes")
        lead = stored(leaders(first), "leaders")
        typical = lead.where("rep <> lead").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
        typical = stored(typical.join(pairs, ["a", "b"], "left_anti"), "typical")
        comp = joined(comp, verify(typical, sets, k, percent))
        rest = prefix_pairs(profiled(first, lead, sets), comp, percent)
        rest = stored(rest.join(pairs.unionByName(typical), ["a", "b"], "left_anti"), "rest")
        comp = joined(comp, verify(rest, sets, k, percent))

    member = stored(base.drop("halves").join(classes.select("print", "rep"), "print", "left").drop("print"), "members")
    ids = member.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"))
    texts = ids.where("a <> z").join(member.select("doc_id", "rep"), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    comp = classes.select("rep", "doc_id").join(comp, "rep", "left").select("rep", "doc_id", F.coalesce("comp", "rep").alias("comp"))
    comp = joined(comp, texts.distinct())
    least = comp.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    names = comp.join(least, "comp").select("rep", "component_id")
    return member.join(names, "rep", "left").select("doc_id", "row", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Sets are of ``k``-word shingles; links are at ``percent`` of the union or
    more. Texts without words, null ones too, are linked with nothing. Rows of
    one id are one document: each of its texts gives it links, and its rows
    have one component. Rows that repeat are given alike; rows without an id
    are kept and have no component. An empty table gives no rows; a long text's
    set is whole. Columns but ``doc_id`` and ``text`` are not read.
    """
    out = judged(docs, k, percent).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def survivors(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that of least id and then of the least hash of its text, and all rows without an id.

    Of rows equal in id and text any one stays. Columns whose names begin with
    ``_nd_`` are not for the caller.
    """
    best = judged(docs, k, percent).where("doc_id = component_id").groupBy("doc_id").agg(F.min("row").alias("_nd_row"))
    best = best.withColumnRenamed("doc_id", "_nd_id")
    own = docs.withColumn("_nd_id", F.col("doc_id").cast("long")).withColumn("_nd_row", F.xxhash64("text"))
    kept = own.where("_nd_id is not null").join(best, ["_nd_id", "_nd_row"], "left_semi").dropDuplicates(["_nd_id", "_nd_row"])
    return kept.unionByName(own.where("_nd_id is null")).select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document: 3-word shingles, 85 percent."""
    return near_duplicates(docs.select("doc_id", "text"), k=3, percent=85)
