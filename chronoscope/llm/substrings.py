"""Substring deduplication by recompression.

Rounds of recompression name runs of equal words, then pairs of neighbouring
symbols, by fingerprints that are the same in every document. Whether two
neighbours are joined depends only on themselves, so equal passages get equal
symbols but near their ends; each symbol knows the span of words that decided
it. A window of words that holds such a span can only repeat if that symbol
repeats, so symbols found in one document alone rule out nearly all windows.
The remaining windows are verified by 96-bit fingerprints, 64 bits from one hash
of each word and 32 from another that is independent of it, and each learns the
least document that has it.

Documents are dealt into cells by their ids, as many as keep a cell's size. Spark shuffles the texts once, and
then packed arrays: symbols to buckets, shared symbols back to their cells,
windows to buckets, and windows with their least document back to the cells. A
symbol or window that fills the corpus travels once for each cell.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import wordhash as wh
from .packed import deal, group_starts, merged, ranges, rows
from .shared import spread

#: Rounds of pair naming, and words that a symbol spans at least to be tested.
ROUNDS, SPAN = 3, 3
SYMBOLS = "bucket long, cell long, k binary"
WINDOWS = "bucket long, cell long, k binary, k2 binary, lo binary, more binary"
LEAST = "_cell long, k binary, k2 binary, lo binary"


class Symbols:
    """A block of documents' symbols: name, words spanned, and the span of words that decided each."""

    def __init__(self, h: np.ndarray, bounds: np.ndarray):
        at = np.arange(len(h))
        self.name, self.row = h, wh.row_of(bounds)
        self.start, self.end = at, at + 1
        self.lo, self.hi = at, at + 1

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """What lies before and after each symbol, as the bounds of what decided it; the edge of a document counts as a word outside."""
        same = self.row[1:] == self.row[:-1]
        before, after = self.start - 1, self.end + 1
        before[1:] = np.where(same, self.lo[:-1], before[1:])
        after[:-1] = np.where(same, self.hi[1:], after[:-1])
        return before, after

    def _merge(self, first: np.ndarray, last: np.ndarray, name, lo, hi) -> None:
        self.name, self.row = name, self.row[first]
        self.start, self.end, self.lo, self.hi = self.start[first], self.end[last], lo, hi

    def name_runs(self) -> None:
        before, after = self._neighbours()
        first = group_starts(self.name, self.row)
        last = np.append(first[1:], len(self.name)) - 1 if len(first) else first
        length = (last - first + 1).astype(wh.U)
        name = np.where(length > 1, wh.mix(self.name[first] * wh.U(0x9E3779B97F4A7C15) + length), self.name[first])
        lo = np.minimum(np.minimum(before[first], self.lo[first]), self.lo[last])
        hi = np.maximum(np.maximum(after[last], self.hi[last]), self.hi[first])
        self._merge(first, last, name, lo, hi)

    def name_pairs(self, seed: int) -> None:
        """Joins a left symbol with a right one that follows; the side of each is a bit of its name."""
        n = len(self.name)
        if not n:
            return
        before, after = self._neighbours()
        right = (wh.mix(self.name + wh.U(seed * 0x2545F491)) & wh.U(1)).astype(bool)
        pair = np.zeros(n, bool)
        pair[:-1] = ~right[:-1] & right[1:] & (self.row[:-1] == self.row[1:])
        second = np.zeros(n, bool)
        second[1:] = pair[:-1]
        first = np.flatnonzero(~second)
        last = first + pair[first]
        name = np.where(pair[first], wh.mix(self.name[first] * wh.U(0xC2B2AE3D27D4EB4F) + self.name[last] + wh.U(seed)), self.name[first])
        lo, hi = np.minimum(self.lo[first], self.lo[last]), np.maximum(self.hi[first], self.hi[last])
        alone = ~pair[first]
        lo = np.where(alone & right[first], np.minimum(lo, before[first]), lo)
        hi = np.where(alone & ~right[first], np.maximum(hi, after[first]), hi)
        self._merge(first, last, name, lo, hi)

    def tested(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names, rows and deciding spans of the symbols that a window may hold."""
        keep = (self.hi - self.lo <= width) & (self.end - self.start >= SPAN)
        return self.name[keep], self.row[keep], self.lo[keep], self.hi[keep]


def blocks(b: pa.RecordBatch):
    """(first row, word fingerprints by two functions, word bounds, bytes and where rows and words begin and end) of the blocks of a batch."""
    data, off = wh.text_buffers(b.column(b.schema.names.index("text")))
    for i, j in wh.pieces(off):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, bounds = wh.word_bounds(d, o, "space")
        yield i, (wh.word_hashes(d, s, e), wh.word_hashes(d, s, e, seed=1)), bounds, (d, o)


def symbols(h: tuple[np.ndarray, np.ndarray], bounds: np.ndarray) -> Symbols:
    s = Symbols(h[0], bounds)
    s.name_runs()
    for k in range(ROUNDS):
        s.name_pairs(k + 1)
    return s


def _documents(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Each row's id and whether it has one; rows without one take no part."""
    ids = b.column(b.schema.names.index("doc_id"))
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)


def _symbol_rows(width: int, n: int):
    """Each cell's distinct symbols; the lowest bit tells that two documents of the cell have it."""

    def run(batches):
        for b in batches:
            cells = b.column(b.schema.names.index("_cell")).to_numpy(zero_copy_only=False)
            ids, valid = _documents(b)
            got = []
            for i, h, bounds, _ in blocks(b):
                name, row, _, _ = symbols(h, bounds).tested(width)
                keep = valid[i + row]
                got.append((name[keep], cells[i + row[keep]], ids[i + row[keep]]))
            name, cell, doc = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, wh.U), np.zeros(0, np.int64), np.zeros(0, np.int64))
            order = np.lexsort((doc, name, cell))
            name, cell, doc = name[order] & ~wh.U(1), cell[order], doc[order]
            start = group_starts(name, cell)
            if not len(start):
                continue
            last = np.append(start[1:], len(name)) - 1
            name, cell, more = name[start], cell[start], (doc[start] != doc[last]).astype(wh.U)
            each = np.append(group_starts(cell), len(cell))
            for x, y in zip(each[:-1], each[1:], strict=True):
                yield rows(["k"], list(deal(name[x:y] | more[x:y], [], n)), cell=int(cell[x]))

    return run


def _cells(t: pa.Table, width: int) -> np.ndarray:
    """The cell of each packed value; ``width`` is the bytes of a key."""
    size = [len(x) // width for x in t.column("k").to_pylist()]
    return np.repeat(t.column("cell").to_numpy(), size)


def _by_cell(cell: np.ndarray, **columns: np.ndarray) -> pa.Table:
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    start = group_starts(cell)
    cut = ranges(start, len(cell))
    packed = {c: pa.array([v[order[i:j]].tobytes() for i, j in cut], pa.binary()) for c, v in columns.items()}
    return pa.table({"_cell": pa.array(cell[start], pa.int64()), **packed})


def _shared_symbols(t: pa.Table) -> pa.Table:
    """Symbols of two documents or more, for each cell that has them."""
    key, cell = merged(t, "k", wh.U), _cells(t, 8)
    name = key >> wh.U(1)
    order = np.argsort(name, kind="stable")
    name, key, cell = name[order], key[order], cell[order]
    start = group_starts(name)
    size = np.diff(np.append(start, len(name)))
    # one cell's batches may report a symbol more than once, perhaps for one document: that only keeps a window in the race
    keep = np.repeat((size > 1) | ((key[start] & wh.U(1)) > 0), size)
    return _by_cell(cell[keep], k=key[keep] & ~wh.U(1))


def _possible(h: tuple[np.ndarray, np.ndarray], bounds: np.ndarray, shared: np.ndarray, width: int) -> np.ndarray:
    """First words of the windows that hold no unshared symbol."""
    n = len(h[0])
    name, _, lo, hi = symbols(h, bounds).tested(width)
    name = name & ~wh.U(1)
    at = np.minimum(np.searchsorted(shared, name), max(len(shared) - 1, 0))
    alone = shared[at] != name if len(shared) else np.ones(len(name), bool)
    # windows that start in [hi - width, lo] hold the span
    ruled = np.zeros(n + 1, np.int64)
    np.add.at(ruled, np.maximum(hi[alone] - width, 0), 1)
    np.add.at(ruled, lo[alone] + 1, -1)
    out = np.cumsum(ruled[:n]) == 0
    row = wh.row_of(bounds)
    return np.flatnonzero(out & (np.arange(n) + width <= bounds[1:][row])) if n else np.zeros(0, np.int64)


def fingerprints(h: tuple[np.ndarray, np.ndarray], at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of 64 and of 32 more bits of the windows that start at ``at``, each from its own hash of the words."""
    flat = [np.full(len(at), 0x9E3779B97F4A7C15 * k % (1 << 64), wh.U) for k in (1, 2)]
    for j in range(width):
        for k, m in ((0, 0xFF51AFD7ED558CCD), (1, 0xC4CEB9FE1A85EC53)):
            flat[k] = (flat[k] ^ (flat[k] >> wh.U(29))) * wh.U(m) + h[k][at + j]
    return wh.mix(flat[0]), (wh.mix(flat[1]) >> wh.U(32)).astype(np.uint32)


def _window_rows(width: int, n: int):
    """For one cell: its windows that may repeat, each with the cell's least and largest document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        shared = np.unique(merged(right, "k", wh.U))
        got = []
        for b in left.combine_chunks().to_batches():
            ids, valid = _documents(b)
            for i, h, bounds, _ in blocks(b):
                at = _possible(h, bounds, shared, width)
                row = wh.row_of(bounds)[at] + i
                at, row = at[valid[row]], row[valid[row]]
                got.append((*fingerprints(h, at, width), ids[row]))
        if got:
            key, key2, doc = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((doc, key2, key))
            key, key2, doc = key[order], key2[order], doc[order]
            start = group_starts(key, key2)
            if len(start):
                last = np.append(start[1:], len(doc)) - 1
                out = list(deal(key[start], [key2[start], doc[start], doc[last] - doc[start]], n))
        cell = left.column("_cell")[0].as_py() if left.num_rows else 0
        return pa.Table.from_batches([rows(["k", "k2", "lo", "more"], out, cell=cell)])

    return run


def _least(t: pa.Table) -> pa.Table:
    """For each cell, its windows that a smaller document than its largest has, with the least document."""
    key, key2, cell = merged(t, "k", wh.U), merged(t, "k2", np.uint32), _cells(t, 8)
    lo = merged(t, "lo", np.int64)
    hi = lo + merged(t, "more", np.int64)
    order = np.lexsort((lo, key2, key))
    key, key2, lo, hi, cell = key[order], key2[order], lo[order], hi[order], cell[order]
    start = group_starts(key, key2)
    least = np.repeat(lo[start], np.diff(np.append(start, len(lo)))) if len(start) else lo
    keep = least < hi
    return _by_cell(cell[keep], k=key[keep], k2=key2[keep], lo=least[keep])


def _covered(width: int, finish, schema: pa.Schema):
    """For one cell: marks the words of windows that a smaller document has, and passes each block on to ``finish``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, key2, least = merged(right, "k", wh.U), merged(right, "k2", np.uint32), merged(right, "lo", np.int64)
        order = np.lexsort((key2, key))
        key, key2, least = key[order], key2[order], least[order]
        twice = bool((key[1:] == key[:-1]).any())
        out = []
        for b in left.combine_chunks().to_batches():
            ids, valid = _documents(b)
            new: list = []
            for i, h, bounds, raw in blocks(b):
                gone = np.zeros(len(h[0]) + 1, np.int64)
                row = wh.row_of(bounds)
                if len(key) and len(h[0]):
                    at = np.flatnonzero((np.arange(len(h[0])) + width <= bounds[1:][row]) & valid[i + row])
                    f, f2 = fingerprints(h, at, width)
                    lo = np.minimum(np.searchsorted(key, f), len(key) - 1)
                    seen = np.flatnonzero(key[lo] == f)
                    at, f, f2, lo = at[seen], f[seen], f2[seen], lo[seen]
                    while twice and len(lo):  # past other windows of the same 64 bits
                        on = (key2[lo] != f2) & (np.append(key[1:], ~key[-1:])[lo] == f)
                        if not on.any():
                            break
                        lo = lo + on
                    hits = at[(key2[lo] == f2) & (least[lo] < ids[i + row[at]])]
                    np.add.at(gone, hits, 1)
                    np.add.at(gone, hits + width, -1)
                new += finish(bounds, np.cumsum(gone[:-1]) > 0, raw)
            out.append(_result(b, new, schema))
        return pa.Table.from_batches(out, schema)

    return run


def _result(b: pa.RecordBatch, new: list, schema: pa.Schema) -> pa.RecordBatch:
    made = dict(zip(("_n_words", "_n_removed", "_kept"), zip(*new, strict=True), strict=True)) if new else {}
    return pa.RecordBatch.from_arrays([pa.array(made.get(f.name, []), f.type) if f.name in ("_n_words", "_n_removed", "_kept") else b.column(b.schema.names.index(f.name)).cast(f.type) for f in schema], schema=schema)


def _kept_words(bounds, gone, raw):
    """(words, removed words, kept words joined by one space) of each row of a block."""
    d, o = raw
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[bounds])
    for r in range(len(bounds) - 1):
        ws = d[o[r] : o[r + 1]].tobytes().split()
        if removed[r]:
            ws = compress(ws, ~gone[bounds[r] : bounds[r + 1]])
        yield int(bounds[r + 1] - bounds[r]), int(removed[r]), b" ".join(ws).decode()


def _digested(bounds, gone, raw):
    for n, k, text in _kept_words(bounds, gone, raw):
        yield n, k, hashlib.sha256(text.encode()).hexdigest()


def deduplicate(docs: DataFrame, width: int = 13, digests: bool = False, cells: int | None = None) -> DataFrame:
    """``docs`` with ``_n_words``, ``_n_removed`` and ``_kept`` added: the words left, joined by one space (with ``digests`` their SHA-256).

    A word goes if a window of ``width`` words over it also starts in a
    document of smaller id; windows are those of the input. Null and empty
    texts have no words; texts of fewer words than a window keep all; a long
    text is read in one piece; rows of one id don't count against each other;
    rows without an id keep all and count against none. An empty table gives no
    rows. Other columns pass through, whatever their names; those of a name
    that is added are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("_n_words", "_n_removed", "_kept")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells, n = cells or spread(spark, size), spread(spark, 2 * size)
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    d = docs.select("doc_id", "text", *([F.struct(*(F.col(f"`{c}`") for c in extra)).alias("rest")] if extra else []))
    dealt = d.withColumn("_cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells))).repartition(cells, "_cell")
    found = dealt.mapInArrow(_symbol_rows(width, n), SYMBOLS)
    shared = found.groupBy("bucket").applyInArrow(_shared_symbols, "_cell long, k binary")
    by_cell = dealt.groupBy("_cell")
    windows = by_cell.cogroup(shared.groupBy("_cell")).applyInArrow(_window_rows(width, n), WINDOWS)
    least = windows.groupBy("bucket").applyInArrow(_least, LEAST)
    added = [T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_kept", T.StringType())]
    schema = T.StructType([*d.schema.fields, *added])
    finish = _digested if digests else _kept_words
    out = by_cell.cogroup(least.groupBy("_cell")).applyInArrow(_covered(width, finish, to_arrow_schema(schema)), schema)
    return out.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in docs.columns), "_n_words", "_n_removed", "_kept")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    out = deduplicate(docs.select("doc_id", "text"), digests=True)
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("kept_sha256"))
