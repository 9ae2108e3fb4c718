"""Toxicity: a factorisation machine over hashed terms.

A document's terms are its distinct words and the beginnings of longer ones,
hashed to cells. On a bounded sample of labelled rows Spark counts in how many
documents of either label each cell occurs; the cells that tell most are the
machine's inputs. It has a weight and a short vector for each, so it learns how
pairs of terms interact beyond the sum of their weights. It is trained by
iterative parameter mixing: in each round every part of the
sample, whose rows depend on their ids alone, is gone over from the common
parameters, and the driver averages the results, whose size is fixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import wordhash as wh
from .shared import stored

#: Labelled rows at most that the machine is fitted on: those whose hashed doc_id is smallest.
SAMPLE = 30_000
CELLS, INPUTS, FACTORS = 1 << 18, 2048, 4
#: Lengths in bytes of the beginnings of words that are terms too.
STEMS = (4, 5, 6)
#: Parts of the sample, rounds and passes over a part in each round.
PARTS, ROUNDS, PASSES = 4, 10, 3
RATE, DECAY, BATCH = 0.15, 1e-4, 32
#: How much more a toxic row counts than another, as these are rare.
WEIGHT = 4.0


def terms(b: pa.RecordBatch):
    """(first row, rows, cells) of the blocks of a batch, each cell once for each row."""
    data, off = wh.text_buffers(b.column(b.schema.names.index("text")))
    for i, j in wh.pieces(off):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, bounds = wh.word_bounds(d, o, "alnum")
        row = wh.row_of(bounds) * CELLS
        found = [row + (wh.word_hashes(d, s, e, fold=True) & wh.U(CELLS - 1)).astype(np.int64)]
        for k in STEMS:
            long = e - s > k
            found.append(row[long] + (wh.word_hashes(d, s[long], s[long] + k, seed=k, fold=True) & wh.U(CELLS - 1)).astype(np.int64))
        both = np.unique(np.concatenate(found))
        yield i, both // CELLS, both % CELLS


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``limit`` labelled documents that are not held out."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("doc_id", "text", "toxic")


def _cell_rows(batches):
    for b in batches:
        ids, y = (b.column(b.schema.names.index(c)) for c in ("doc_id", "toxic"))
        for i, row, cell in terms(b):
            start = np.searchsorted(row, np.arange(int(row[-1]) + 2 if len(row) else 1))
            n = len(start) - 1
            if n:
                yield pa.RecordBatch.from_arrays([ids.slice(i, n).cast(pa.int64()), y.slice(i, n), pa.array([cell[x:z].astype(np.int32).tobytes() for x, z in zip(start[:-1], start[1:], strict=True)], pa.binary())], ["doc_id", "toxic", "cells"])


def _tally(batches):
    n = np.zeros((2, CELLS + 1), np.int64)
    for b in batches:
        for y, c in zip(*(b.column(b.schema.names.index(k)).to_pylist() for k in ("toxic", "cells")), strict=True):
            n[y, np.frombuffer(c, np.int32)] += 1
            n[y, CELLS] += 1
    at = np.flatnonzero(n.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], ["cell", "n0", "n1"])


def inputs(rows: DataFrame) -> np.ndarray:
    """The cells whose documents differ most in label, at most ``INPUTS``, by the G statistic; where there are no more, all that three documents have."""
    n = rows.mapInArrow(_tally, "cell long, n0 long, n1 long").groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = n.where(f"cell = {CELLS}").first()
    if total is None:
        return np.zeros(0, np.int64)
    all0, all1 = total["n0"] + 1, total["n1"] + 1
    part = lambda c, a: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("n0") + F.col("n1")) * a / (all0 + all1)))).otherwise(0.0)
    best = n.where(f"cell < {CELLS} and n0 + n1 > 2").withColumn("g", part("n0", all0) + part("n1", all1)).orderBy(F.desc("g"), "cell").limit(INPUTS)
    return np.sort(np.array([r["cell"] for r in best.select("cell").collect()], np.int64))


def places(cells: np.ndarray) -> np.ndarray:
    """For each cell its place among the inputs; all others have the last one, whose weight and factors are 0."""
    out = np.full(CELLS, len(cells), np.int64)
    out[cells] = np.arange(len(cells))
    return out


def raw_scores(cells: np.ndarray, start: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
    """The machine's sums for rows whose cells begin at ``start``, none empty, and the sums of their factors."""
    x = v[cells]
    s = np.add.reduceat(x, start)
    return w0 + np.add.reduceat(w[cells], start) + 0.5 * ((s**2).sum(axis=1) - np.add.reduceat((x**2).sum(axis=1), start)), s


def fresh(n: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The parameters that training begins with, for ``n`` inputs and a last one that stays 0."""
    v = np.random.default_rng(0).normal(0, 0.05, (n + 1, FACTORS))
    v[n] = 0
    return -2.0, np.zeros(n + 1), v


PACKED = "part int, sizes binary, cells binary, y binary"


def _pack(chosen):
    """A part's rows in the order of their ids and terms, as one row: how many inputs each has, these, and the labels."""

    def run(t: pa.Table) -> pa.Table:
        n, place = len(chosen.value), places(chosen.value)
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("doc_id", "cells", "toxic")), strict=True))
        xs = [place[np.frombuffer(c, np.int32)] for _, c, _ in rows]
        xs = [x[x < n] if (x < n).any() else x[:1] for x in xs]
        packed = (np.array([len(x) for x in xs], np.int32), np.concatenate(xs).astype(np.int32), np.array([y for _, _, y in rows], np.int8))
        return pa.table({"part": t.column("part").slice(0, 1), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("sizes", "cells", "y"), packed, strict=True)}})

    return run


def _train(state, seed: int):
    """One round on each part that a task has: AdaGrad over the part's rows from the common parameters."""

    def run(batches):
        for b in batches:
            for part, sizes, cells, y in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("part", "sizes", "cells", "y")), strict=True):
                ends = np.cumsum(np.frombuffer(sizes, np.int32))
                p = _epochs(np.split(np.frombuffer(cells, np.int32), ends[:-1]), np.frombuffer(y, np.int8).astype(np.float64), *state.value, seed)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(ends)], pa.int64()), pa.array([p], pa.binary())], ["part", "n", "p"])

    return run


def _epochs(xs: list[np.ndarray], y: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray, seed: int) -> bytes:
    """The parameters after some passes over rows."""
    w, v = w.copy(), v.copy()
    g0, gw, gv = 1e-2, np.full_like(w, 1e-2), np.full_like(v, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        order = rng.permutation(len(xs))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            size = np.array([len(xs[p]) for p in pick])
            start = np.cumsum(size) - size
            cells = np.concatenate([xs[p] for p in pick])
            z, s = raw_scores(cells, start, w0, w, v)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * np.where(y[pick] > 0, WEIGHT, 1.0) / len(pick)
            each = np.repeat(d, size)
            mine, back = np.unique(cells, return_inverse=True)
            sums = np.bincount(back, each)
            dw = sums + DECAY * w[mine]
            pulled = np.repeat(d[:, None] * s, size, axis=0)
            dv = np.stack([np.bincount(back, pulled[:, f]) for f in range(FACTORS)], axis=1) - v[mine] * sums[:, None] + DECAY * v[mine]
            own = mine < len(w) - 1
            mine, dw, dv = mine[own], dw[own], dv[own]
            g0 += d.sum() ** 2
            gw[mine] += dw**2
            gv[mine] += dv**2
            w0 -= RATE * d.sum() / g0**0.5
            w[mine] -= RATE * dw / gw[mine] ** 0.5
            v[mine] -= 0.3 * RATE * dv / gv[mine] ** 0.5
    return np.concatenate([[w0], w, v.ravel()]).astype(np.float32).tobytes()


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE):
    """The machine's inputs and parameters; without labelled rows it has no inputs."""
    spark = docs.sparkSession
    rows = sample(docs, labels, limit).mapInArrow(_cell_rows, "doc_id long, toxic int, cells binary").where(F.octet_length("cells") > 0)
    rows = stored(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")), "toxic-sample")
    chosen = inputs(rows)
    w0, w, v = fresh(len(chosen))
    rows = stored(rows.groupBy("part").applyInArrow(_pack(spark.sparkContext.broadcast(chosen)), PACKED), "toxic-parts")
    for k in range(ROUNDS):
        state = spark.sparkContext.broadcast((w0, w, v))
        got = rows.mapInArrow(_train(state, k), "part int, n long, p binary").collect()
        if not got:
            break
        got = [(r["n"], np.frombuffer(r["p"], np.float32).astype(np.float64)) for r in sorted(got, key=lambda r: r["part"])]
        p = sum(n * p for n, p in got) / sum(n for n, _ in got)
        w0, w, v = float(p[0]), p[1 : 1 + len(w)], p[1 + len(w) :].reshape(v.shape)
    return chosen, w0, w, v


def _score(model, schema: pa.Schema):
    def run(batches):
        chosen, w0, w, v = model.value
        place = places(chosen)
        for b in batches:
            z = np.full(b.num_rows, w0, np.float64)
            for i, row, cell in terms(b):
                if len(row):
                    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    z[i + row[start]] = raw_scores(place[cell], start, w0, w, v)[0]
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(n)).cast(schema.field(n).type) for n in schema.names[:-1]), pa.array(score)], schema=schema)

    return run


def score(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """``docs`` without ``text`` and with ``score`` added, from 0 to 1.

    Null and empty texts have no terms and get the machine's base rate; a long
    text counts whole; rows that repeat get equal scores, and scores don't
    depend on how rows are dealt; an empty table gives no rows; labels other than 0 and 1 are not used, and of
    several labels of one document the larger counts. Other columns pass through, one named
    ``score`` is replaced.
    """
    docs = docs.drop("score")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != "text"), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_score(model, to_arrow_schema(schema)), schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    s = score(docs.select("doc_id", "text"), labels)
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
