"""Benchmark decontamination: a prefix-filtered set join with exact verification.

Every item gives windows of ``width`` consecutive words (an item of fewer
words is one window). A document holds a window only if it holds all of its
words, so the window's rarest word alone is a sufficient prefix: only
occurrences of such words are looked at. A positional bound drops those too
close to an end of the document for the window to fit, and the rest are
verified on the words themselves.

Spark counts, over all documents, how often each benchmark word occurs, and
picks each window's rarest word. The windows are broadcast in blocks of at
most ``BLOCK_WORDS`` words; a benchmark beyond one block takes more passes,
each of which sees every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .shared import ascii_lower

#: Words of benchmark windows that one broadcast holds at most (about 64 bytes each).
BLOCK_WORDS = 1_000_000
#: Words of all else: controls, punctuation and upper case are left out after lower-casing.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def item_windows(benchmark: DataFrame, width: int = 13, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, win, words``: every window of every item; items without words have none."""
    w = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    items = benchmark.select(F.col(item_col).alias("item"), w.alias("ws")).where(F.size("ws") > 0)
    return items.select("item", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("ws") - width, F.lit(0))), lambda i: F.slice("ws", i + 1, width))).alias("win", "words"))


def _vocabulary_counter(vocab):
    """Counts, per task, of the words in a sorted array of fingerprints."""

    def run(batches):
        keys = vocab.value
        n = np.zeros(len(keys), np.int64)
        for b in batches:
            data, off = wh.text_buffers(b.column(0))
            for i, j in wh.pieces(off):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                s, e, _ = wh.word_bounds(d, o, "alnum")
                h = wh.word_hashes(d, s, e, fold=True)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                n += np.bincount(at[keys[at] == h], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    return run


def fingerprints(texts: list[str]) -> np.ndarray:
    """The fingerprint of each string, as of a word."""
    data, off = wh.text_buffers(pa.array(texts, pa.string()))
    return wh.word_hashes(data, off[:-1], off[1:], fold=True)


def rare_first(windows: DataFrame, texts: DataFrame, spark) -> list[tuple]:
    """(item, words, offset of the rarest word) for each distinct window of a block.

    ``windows`` is one block, so what the driver holds here is bounded by
    ``BLOCK_WORDS``.
    """
    rows = windows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).collect()
    vocab = sorted({w for r in rows for w in r["words"]})
    if not vocab:
        return []
    fp = fingerprints(vocab)
    keys = np.unique(fp)
    counted = texts.mapInArrow(_vocabulary_counter(spark.sparkContext.broadcast(keys)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    freq = {r["key"]: r["n"] for r in counted.collect()}
    df = {w: freq.get(int(k), 0) for w, k in zip(vocab, fp.view(np.int64), strict=True)}
    out = []
    for r in rows:
        ws = r["words"]
        out.append((r["items"], ws, min(range(len(ws)), key=lambda i: (df[ws[i]], ws[i], i))))
    return out


class Index:
    """Windows of a block by the fingerprint of their rarest word."""

    def __init__(self, windows: list[tuple]):
        items, words, offsets = zip(*windows, strict=True)
        key = fingerprints([ws[o] for ws, o in zip(words, offsets, strict=True)])
        order = np.argsort(key, kind="stable")
        self.keys, self.first = np.unique(key[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.items = [items[i] for i in order]
        self.words = [" ".join(words[i]).encode() for i in order]
        self.offset = np.array([offsets[i] for i in order])
        self.length = np.array([len(words[i]) for i in order])
        h = fingerprints([w for ws in words for w in ws])
        ends = np.cumsum([len(ws) for ws in words])
        whole = np.array([chain(h[e - len(ws) : e]) for e, ws in zip(ends, words, strict=True)], wh.U)
        self.whole = whole[order]


def chain(h: np.ndarray) -> int:
    return int(wh.window_hashes(h, len(h))[0])


def _hits(d: bytes, starts, ends, h, bounds, index: Index):
    """(row, first word, window) of every occurrence of a window in the rows of a piece."""
    at = np.minimum(np.searchsorted(index.keys, h), len(index.keys) - 1)
    pos = np.flatnonzero(index.keys[at] == h)
    if not len(pos):
        return
    # one candidate for each window that has this word as its rarest
    at = at[pos]
    n = index.last[at] - index.first[at]
    rep = np.repeat(pos, n)
    win = np.repeat(index.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first, length = rep - index.offset[win], index.length[win]
    row = np.searchsorted(bounds, rep, "right") - 1
    fits = (first >= bounds[row]) & (first + length <= bounds[row + 1])
    first, win, row, length = first[fits], win[fits], row[fits], length[fits]
    for k in np.unique(length):
        same = np.flatnonzero(length == k)
        acc = wh.window_hashes(h[first[same][:, None] + np.arange(k)].T.copy(), int(k))[0]
        for i in same[acc == index.whole[win[same]]]:
            f = int(first[i])
            text = b" ".join(d[starts[x] : ends[x]].tobytes().lower() for x in range(f, f + int(k)))
            if text == index.words[win[i]]:
                yield int(row[i]), f, int(win[i])


def _marker(block):
    """Adds a block's hits to the packed bits of hit words and the list of items."""

    def run(batches):
        index = Index(block.value) if block.value else None
        for b in batches:
            names = b.schema.names
            data, off = wh.text_buffers(b.column(names.index("_text")))
            old_bits, old_items = b.column(names.index("_bits")).to_pylist(), b.column(names.index("_items")).to_pylist()
            total = np.zeros(b.num_rows, np.int64)
            for i, j in wh.pieces(off):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                s, e, bounds = wh.word_bounds(d, o, "alnum")
                total[i:j] = np.diff(bounds)
                if index is None:
                    continue
                h = wh.word_hashes(d, s, e, fold=True)
                found: dict[int, list[tuple[int, int]]] = {}
                for row, f, win in _hits(d, s, e, h, bounds, index):
                    found.setdefault(row, []).append((f, win))
                for row, hits in found.items():
                    bits = np.zeros(int(bounds[row + 1] - bounds[row]), np.uint8)
                    if old_bits[i + row]:
                        bits |= np.unpackbits(np.frombuffer(old_bits[i + row], np.uint8), count=len(bits))
                    items = set(old_items[i + row] or ())
                    for f, win in hits:
                        at = f - int(bounds[row])
                        bits[at : at + int(index.length[win])] = 1
                        items.update(index.items[win])
                    old_bits[i + row], old_items[i + row] = np.packbits(bits).tobytes(), sorted(items)
            cols = {n: b.column(k) for k, n in enumerate(names)}
            cols |= {"_bits": pa.array(old_bits, pa.binary()), "_items": pa.array(old_items, b.schema.field("_items").type), "_n": pa.array(total)}
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return run


def mark(docs: DataFrame, benchmark: DataFrame, width: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` and ``items`` (sorted array) added.

    Null and empty texts have no words and no hits; an empty benchmark gives
    no hits, and no documents give no rows; a long text is one row, marked whole;
    rows that repeat are judged one by one; all other columns pass through
    whatever their names, those of a name that is added are replaced.
    """
    spark = docs.sparkSession
    windows = item_windows(benchmark, width, item_col, item_text_col)
    item_type = windows.schema["item"].dataType
    total = windows.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "items")]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_kept"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.lit(None).cast("binary").alias("_bits"), F.lit(None).cast(f"array<{item_type.simpleString()}>").alias("_items"), F.lit(0).cast("long").alias("_n"))
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    for k in range(blocks):
        block = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k)
        found = rare_first(block, texts, spark)
        out = out.mapInArrow(_marker(spark.sparkContext.broadcast(found)), out.schema)
    return out.select(*[F.col(f"_kept.`{c}`") for c in kept], F.col("_n").alias("n_words"), _popcount("_bits").alias("n_hit"), F.coalesce("_items", F.array().cast(f"array<{item_type.simpleString()}>")).alias("items"))


def _popcount(c: str):
    """Set bits of a binary column, by its hexadecimal digits."""
    digits = F.hex(F.col(c))
    weights = {1: "1248", 2: "3569AC", 3: "7BDE", 4: "F"}
    return F.coalesce(sum((F.length(digits) - F.length(F.translate(digits, d, ""))) * k for k, d in weights.items()), F.lit(0)).cast("long")


def contaminated():
    """The contract's rule on ``n_hit`` and ``n_words``."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    joined = F.array_join(F.sort_array(F.col("items").cast("array<string>")), ",")
    m = mark(docs.select("doc_id", "text"), benchmark)
    return m.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), contaminated().alias("contaminated"))

