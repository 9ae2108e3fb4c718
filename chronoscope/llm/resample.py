"""Importance resampling towards a target distribution, by a dictionary of distinct n-grams.

Documents are dealt to cells of bounded size. A cell sends each of its distinct
n-gram strings once, with its count, to the part of the dictionary that the
string belongs to. There strings are counted over all cells, each distinct one
is hashed once, and its counts are added to its bucket. The part answers each
cell with the buckets of its strings in the order in which they came, so no
string travels back; cells then add up the gains of their documents' n-grams.

All of it is one Spark plan: the exchanges of documents and of answers are each
read twice. What is broadcast is one row with a number for each bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as wh
from .shared import stored

#: Words in an n-gram at most; buckets; documents drawn of a hundred; words that a document needs to be drawn; the seed of the noise.
GRAMS, BUCKETS, PERCENT, LEAST_WORDS, SEED = 2, 10_000, 25, 20, 7
#: Bytes of text in a cell.
CELL = 6 << 20
#: What each byte becomes: letters A to Z in lower case, what separates words 0.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 0 for b in range(256)], np.uint8)
SENT = "part long, cell long, target boolean, strings binary, sizes binary, counts binary"
ANSWERS = "cell long, part long, data binary, first int"
WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other as binary values, and how many there are before each text and in all."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = FOLD[np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = data != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    at = np.flatnonzero(begins)
    kept = data[inside]
    bounds = np.append(np.cumsum(inside)[at] - 1, len(kept)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(kept.tobytes())])
    return words, np.searchsorted(at, offsets)


class Cell:
    """The distinct n-grams of a cell, in an order that depends on its set of strings alone."""

    def __init__(self, texts: pa.Array, grams: int, parts: int):
        words, self.bounds = words_of(texts)
        coded = words.dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        vocabulary = coded.dictionary.take(order)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        of = rank[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        strings, hashes = vocabulary, wh.mix(np.fromiter(map(zlib.crc32, vocabulary.to_pylist()), np.uint64, len(vocabulary)))
        word_hashes = hashes
        #: For each length: which distinct string begins at each word that has as many words after it, and where these are.
        self.occurrences = [(of, np.arange(len(of)))]
        found, seen, counts, part = [strings], len(strings), [np.bincount(of, minlength=len(strings))], [hashes]
        cur, at, names = of, np.arange(len(of)), strings
        for k in range(1, grams):
            fits = np.flatnonzero((at + k < len(of)) & (row[np.minimum(at + k, max(len(of) - 1, 0))] == row[at])) if len(of) else at
            keys, inverse, n = np.unique(cur[fits] * max(len(vocabulary), 1) + of[at[fits] + k], return_inverse=True, return_counts=True)
            a, b = np.divmod(keys, max(len(vocabulary), 1))
            names = pc.binary_join_element_wise(names.take(pa.array(a)), vocabulary.take(pa.array(b)), b" ")
            hashes = wh.mix(hashes[a] * wh.U(0x9E3779B97F4A7C15) + word_hashes[b])
            cur, at = inverse, at[fits]
            self.occurrences.append((seen + inverse, at))
            found.append(names)
            counts.append(n)
            part.append(hashes)
            seen += len(keys)
        part = (np.concatenate(part) % wh.U(parts)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")
        self.counts = np.concatenate(counts)[self.order]
        self.strings = pa.concat_arrays(found).take(pa.array(self.order))
        self.starts = np.searchsorted(part[self.order], np.arange(parts + 1))


def _zipped(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(x, asbytes=True)


def _unzipped(x: bytes) -> bytes:
    return pa.Codec("zstd").decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, after a byte that tells how many."""
    width = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _send(grams: int, parts: int, target: bool):
    def run(key, table):
        cell = Cell(table.column("text").combine_chunks(), grams, parts)
        ends = np.frombuffer(cell.strings.buffers()[1], np.int32)[cell.strings.offset : cell.strings.offset + len(cell.strings) + 1]
        data = cell.strings.buffers()[2]
        rows = []
        for p, (i, j) in enumerate(zip(cell.starts, cell.starts[1:], strict=False)):
            if i < j or p == 0:  # part 0 is always asked, as it answers with the gains too
                held = data[int(ends[i]) : int(ends[j])] if i < j else b""
                rows.append((p, *map(_zipped, (bytes(held), _narrow(np.diff(ends[i : j + 1])), _narrow(cell.counts[i:j])))))
        cols = list(zip(*rows, strict=True))
        n = len(rows)
        return pa.table({"part": pa.array(cols[0], pa.int64()), "cell": pa.array([key[0].as_py()] * n, pa.int64()), "target": pa.array([target] * n), **{c: pa.array(x, pa.binary()) for c, x in zip(("strings", "sizes", "counts"), cols[1:], strict=True)}})

    return run


def _hashed(strings: pa.Array, buckets: int) -> np.ndarray:
    """The bucket of each string."""
    out = np.empty(len(strings), "<u2" if buckets <= 1 << 16 else "<u4")
    for at in range(0, len(strings), 1 << 16):
        some = strings.slice(at, 1 << 16).to_pylist()
        out[at : at + len(some)] = np.fromiter(map(zlib.crc32, some), np.uint32, len(some)) % buckets
    return out


def _dictionary(buckets: int):
    """Counts a part's strings over all cells, hashes each once, adds up its buckets, and answers the cells; a cell below 0 is none, and holds the part's sums."""

    def run(key, table):
        part = key[0].as_py()
        cells, target = table.column("cell").to_pylist(), table.column("target").to_pylist()
        sizes = [_numbers(_unzipped(x.as_py())) for x in table.column("sizes")]
        counts = [_numbers(_unzipped(x.as_py())) for x in table.column("counts")]
        data = b"".join(_unzipped(x.as_py()) for x in table.column("strings"))
        bounds = np.r_[0, np.cumsum(np.concatenate(sizes), dtype=np.int64)]
        coded = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data)]).dictionary_encode()
        of = coded.indices.to_numpy()
        del data
        code = _hashed(coded.dictionary, buckets)
        ends = np.cumsum([len(s) for s in sizes])
        sums = np.zeros((2, buckets), "<i8")
        for kind in (False, True):
            mine = [k for k, t in enumerate(target) if t == kind]
            if mine:
                n = np.bincount(np.concatenate([of[ends[k] - len(sizes[k]) : ends[k]] for k in mine]), np.concatenate([counts[k] for k in mine]), len(code))  # of each string, exact below 2 ** 53
                sums[int(kind)] = np.bincount(code, n, buckets)
        asked = [k for k, t in enumerate(target) if not t]
        own = [code[of[ends[k] - len(sizes[k]) : ends[k]]].tobytes() for k in asked]
        m = len(asked)
        return pa.table({
            "cell": pa.array([*(cells[k] for k in asked), -1 - part], pa.int64()), "part": pa.array([part] * (m + 1), pa.int64()),
            "data": pa.array([*own, sums.tobytes()], pa.binary()), "first": pa.array([int(part == 0)] * (m + 1), pa.int32()),
        })

    return run


def _sums(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            for cell, x in zip(*(b.column(b.schema.names.index(c)) for c in ("cell", "data")), strict=True):
                if cell.as_py() < 0:
                    total += np.frombuffer(x.as_py(), "<i8").reshape(2, buckets)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])], ["code", "s", "t"])

    return run


def _weigh(grams: int, parts: int, buckets: int):
    def run(key, docs, answers):
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_features": pa.array([], pa.int64()), "weight": pa.array([], pa.int64())})
        cell = Cell(docs.column("text").combine_chunks(), grams, parts)
        gains, codes, kind = None, np.zeros(len(cell.order), np.int64), "<u2" if buckets <= 1 << 16 else "<u4"
        for p, own, made in zip(*(answers.column(c).to_pylist() for c in ("part", "data", "gains")), strict=True):
            codes[cell.order[cell.starts[p] : cell.starts[p + 1]]] = np.frombuffer(own, kind)
            if made is not None:
                gains = np.zeros(buckets, np.int64)
                gains[[x["code"] for x in made]] = [x["gain"] for x in made]
        if gains is None:
            raise ValueError(f"cell {key[0]} got no gains")
        of_string, n_words = gains[codes], np.diff(cell.bounds)
        total, n = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
        for which, at in cell.occurrences:
            run_ = np.r_[0, np.cumsum(of_string[which])]
            cuts = np.searchsorted(at, cell.bounds)
            total += np.diff(run_[cuts])
            n += np.diff(cuts)
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(n_words.astype(np.int64)), "n_features": pa.array(n), "weight": pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))})

    return run


def weights(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each document: the floored mean gain of its n-grams.

    A bucket's gain tells how much likelier an n-gram of it is among ``target``
    (its ``text`` column) than among ``docs``. Null and empty texts have no
    features and weight 0; a long text is one row of a cell; rows that repeat
    are documents of their own; other columns are not returned. No documents
    give no rows; an empty target gives every bucket the gain of its count.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = max(2 * n, -(-size // CELL))

    def dealt(df: DataFrame, first, key: list[str], many: int) -> DataFrame:
        cell = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in key]), F.lit(many))
        return df.select(first.cast("long").alias("doc_id"), "text", cell.alias("cell")).repartition(n, "cell")

    own = dealt(docs, F.col("doc_id"), ["doc_id", "text"], cells)
    theirs = dealt(target, F.lit(None), [c for c, kind in target.dtypes if "map<" not in kind], max(n, -(-(target.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CELL)))
    sent = own.groupBy("cell").applyInArrow(_send(grams, n, False), SENT).unionByName(theirs.groupBy("cell").applyInArrow(_send(grams, n, True), SENT))
    answers = sent.groupBy("part").applyInArrow(_dictionary(buckets), ANSWERS).repartition(n, "cell")
    sums = answers.mapInArrow(_sums(buckets), "code int, s long, t long").groupBy("code").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = sums.agg(F.sum("s").alias("_s"), F.sum("t").alias("_t"), F.collect_list(F.struct("code", "s", "t")).alias("_all"), (F.least(F.count("*"), F.lit(0)) + 1).cast("int").alias("first"))  # 1 even where there are no features
    m = float(buckets)
    gain = lambda x: F.floor(1000 * F.log(((x["t"] + 1).cast("double") * (F.col("_s") + m)) / ((x["s"] + 1).cast("double") * (F.col("_t") + m))))
    gains = whole.select("first", F.transform("_all", lambda x: F.struct(x["code"].alias("code"), gain(x).alias("gain"))).alias("gains"))
    told = answers.join(F.broadcast(gains), "first", "left").select("cell", "part", "data", "gains")
    return own.groupBy("cell").cogroup(told.groupBy("cell")).applyInArrow(_weigh(grams, n, buckets), WEIGHED)


def noise(doc_id, seed: int = SEED):
    """A Gumbel variate in thousandths, from the hash of the seed and the document's id (null: empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank`` to the ``percent`` of rows with at least ``least`` words that have the highest ``score``, else null.

    Rows are counted by score, and scores' counts are added up in two levels;
    only rows of one score are ever sorted together. Ties go to the smaller id;
    rows equal in both are told apart by ``n_features``.
    """
    able = scored.where(F.col("n_words") >= least)
    drawn = percent * able.count() // 100
    counts = able.groupBy("score").agg(F.count("*").alias("_n")).withColumn("_hi", F.floor(F.col("score") / 256))
    above = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    coarse = counts.groupBy("_hi").agg(F.sum("_n").alias("_m"))
    coarse = coarse.select("_hi", F.coalesce(F.sum("_m").over(above(Window.orderBy(F.desc("_hi")))), F.lit(0)).alias("_far"))
    near = F.coalesce(F.sum("_n").over(above(Window.partitionBy("_hi").orderBy(F.desc("score")))), F.lit(0))
    before = counts.withColumn("_near", near).join(coarse, "_hi").select("score", (F.col("_far") + F.col("_near")).alias("_before"))
    joined = scored.join(before, "score", "left").withColumn("_in", (F.col("n_words") >= least) & (F.col("_before") < drawn))
    top, rest = joined.where("_in"), joined.where("not coalesce(_in, false)")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features"))
    top = top.withColumn("rank", F.when(place <= drawn, place))
    return top.unionByName(rest.withColumn("rank", F.lit(None).cast("long"))).drop("_before", "_in")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``weights`` with ``score``, weight plus noise, and ``rank`` among what is drawn (null: not drawn); see there for nulls, repeats and empty tables."""
    scored = weights(docs, target).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(stored(scored, "scores"), percent)


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
