"""Token ids as bit-packed binary files, for vectorised and random reads.

Each id takes the bits that the vocabulary needs. Ids are packed in blocks of a
fixed number of ids; a file ends with the byte offset of each block and, for
each document, its key and the place of its first id. A reader unpacks any
stretch of ids with numpy from the blocks that hold it.

Layout of a file, all integers little-endian: the header (magic, bits of an id,
ids of a block, as ``<8sII``), the blocks, the index (block offsets as u64;
documents' keys as i64, whether each key is null as u8, and first ids as u64),
and the tail (documents, ids, place of the index, magic, as ``<QQQ8s``).

Documents are dealt to tasks by ranges of their keys and sorted within them, so
files follow one another in ascending key order. Each attempt of a task writes
files of its own to the shared folder; only those in the manifest that Spark
commits are ever read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, stored

TOKENIZER, END = "byte_bpe_50k.json", 2
MAGIC, HEADER, TAIL = b"BITTOKS1", "<8sII", "<QQQ8s"
#: Ids of a block (a multiple of 8, so that blocks are whole bytes); of a stretch that one reader takes, and of a file, at least.
BLOCK, STRETCH, FILE = 1 << 15, 1 << 22, 1 << 27
#: Documents of a file at most: a writer and a reader hold their keys and places.
DOCUMENTS = 1 << 20
#: Parts of texts that a worker keeps encoded in each of two generations, and the longest such part in characters.
CACHED, CACHED_CHARS = 200_000, 48
#: Bytes of texts that are encoded together.
TOGETHER = 1 << 22
#: Characters that any library may take for white space, for a character class.
WHITE = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Widths whose packed ids are numpy's own integers.
WHOLE = (8, 16, 32)
MANIFEST = "path string, part int, seq int, doc long, docs long, at long, ids long"


def width_of(size: int) -> int:
    """Least bits that hold every id of a vocabulary of ``size`` ids."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, the lowest bit first, filled up to a whole byte."""
    if width in WHOLE:
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    if width in WHOLE:
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A byte-level tokenizer without a normalizer never merges across the place
    between a character that isn't white space and a space after it, so a text
    falls apart there and parts met again come from a cache. Whether that holds
    is read from the tokenizer's file; otherwise whole texts go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said["pre_tokenizer"] or {}
        plain = all(" " not in a["content"] and not (a["lstrip"] or a["rstrip"] or a["single_word"]) for a in said["added_tokens"])
        self.parts = plain and said["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and not said["model"].get("dropout")
        if self.parts:  # the bytes of each id: a special token's are those of its content, any other's are one for each of its characters
            special = {a["id"] for a in said["added_tokens"]}
            self.sizes = np.zeros(self.t.get_vocab_size(), np.int64)
            for token, i in self.t.get_vocab().items():
                self.sizes[i] = len(token.encode()) if i in special else len(token)
        self.cut = re.compile(f"(?<=[^{WHITE}]) ")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, parts: list[str]) -> list[bytes]:
        """Ids of each part and the space before it: all go to the library as one text, whose ids are dealt out by their bytes."""
        (ids,) = self.library([" " + " ".join(parts)])
        ends = np.cumsum(self.sizes[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(p.encode()) + 1 for p in parts])) + 1
        data, out, at = ids.tobytes(), [], 0
        for z in (4 * cuts).tolist():
            out.append(data[at:z])
            at = z
        return out

    def split(self, texts: pa.Array) -> pa.ListArray:
        """Each text up to its first place to part, then what stands between these places, each without its space."""
        lists = pc.split_pattern(texts, " ")
        odd = np.flatnonzero(pc.match_substring_regex(texts, f"[{WHITE}] ").to_numpy(zero_copy_only=False))
        if not len(odd):
            return lists
        own = pa.array([self.cut.split(t) for t in texts.take(pa.array(odd)).to_pylist()], lists.type)
        order = np.arange(len(texts))
        order[odd] = len(texts) + np.arange(len(odd))
        return pa.concat_arrays([lists, own]).take(pa.array(order))

    def known(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts, from the cache or else from the library."""
        if len(self.new) > CACHED:
            self.old, self.new = self.new, {}
        out = list(map(self.new.get, parts))
        missing = [k for k, v in enumerate(out) if v is None]
        if self.old:
            for k in missing:
                if (v := self.old.get(parts[k])) is not None:
                    out[k] = self.new[parts[k]] = v
            missing = [k for k in missing if out[k] is None]
        if missing:
            rest = [parts[k] for k in missing]
            for k, p, v in zip(missing, rest, self.joined(rest), strict=True):
                out[k] = v
                if len(p) <= CACHED_CHARS:
                    self.new[p] = v
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, none of them null."""
        if not self.parts or not len(texts):
            return self.library(texts.to_pylist())
        lists = self.split(texts)
        offsets, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
        heads = self.library(flat.take(pa.array(offsets[:-1])).to_pylist())
        coded = flat.dictionary_encode()
        at, values = coded.indices.to_numpy(), self.known(coded.dictionary.to_pylist())
        ids, sizes = np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int32, len(values)) // 4
        starts, n = (np.cumsum(sizes, dtype=np.int32) - sizes)[at], sizes[at]
        n[offsets[:-1]] = 0  # a head has no space before it, and is encoded by itself
        ends = np.cumsum(n, dtype=np.int32)
        all_ids = ids[np.repeat(starts - ends + n, n) + np.arange(ends[-1], dtype=np.int32)]
        bounds = np.r_[0, ends[offsets[1:] - 1]].tolist()
        return [np.concatenate([h, all_ids[i:j]]) for h, i, j in zip(heads, bounds, bounds[1:], strict=False)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Ids of each text (null: empty), encoded a bounded number of bytes at a time; a longer text is one by itself."""
    e, texts = encoder(path), pc.fill_null(texts, "")
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
        yield from e.encode(texts.slice(at, to - at))
        at = to


class Writer:
    """Files that one attempt of a task writes, and the stretches of them."""

    def __init__(self, folder: str, part: int, width: int):
        self.folder, self.part, self.width = folder, part, width
        self.fs, self.root = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.out, self.seq, self.done = None, 0, []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.bits"
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.out.write(struct.pack(HEADER, MAGIC, self.width, BLOCK))
            self.held, self.n_held, self.at, self.offsets, self.keys, self.starts, self.mark = [], 0, 0, [], [], [], (0, 0)
        self.keys.append(key)
        self.starts.append(self.at)
        self.at += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self.flush(self.n_held // BLOCK)
        if self.at - self.mark[1] >= STRETCH:
            self.stretch()
        if self.at >= FILE or len(self.keys) >= DOCUMENTS:
            self.close()

    def flush(self, blocks: int) -> None:
        ids = np.concatenate(self.held)
        for k in range(blocks):
            self.block(ids[k * BLOCK : (k + 1) * BLOCK])
        self.held = [ids[blocks * BLOCK :].copy()]
        self.n_held = len(self.held[0])

    def block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.out.tell())
        self.out.write(pack(ids, self.width))

    def stretch(self) -> None:
        doc, at = self.mark
        if len(self.keys) > doc:
            self.done.append((f"{self.folder}/{self.name}", self.part, self.seq, doc, len(self.keys) - doc, at, self.at - at))
            self.seq, self.mark = self.seq + 1, (len(self.keys), self.at)

    def close(self) -> None:
        if self.out is None:
            return
        self.stretch()
        if self.n_held:
            self.block(np.concatenate(self.held))
        index = self.out.tell()
        self.out.write(np.asarray(self.offsets, "<u8").tobytes())
        self.out.write(np.asarray([k or 0 for k in self.keys], "<i8").tobytes())
        self.out.write(np.asarray([k is None for k in self.keys], np.uint8).tobytes())
        self.out.write(np.asarray(self.starts, "<u8").tobytes())
        self.out.write(struct.pack(TAIL, len(self.keys), self.at, index, MAGIC))
        self.out.close()
        self.out = None


class TokenFile:
    """Random access to a file: only the index and the blocks asked for are read."""

    def __init__(self, path: str):
        fs, name = pa.fs.FileSystem.from_uri(path)
        self.f = fs.open_input_file(name)
        magic, self.width, self.block = struct.unpack(HEADER, self.f.read(struct.calcsize(HEADER)))
        size, tail = self.f.size(), struct.calcsize(TAIL)
        self.f.seek(size - tail)
        self.docs, self.n, index, again = struct.unpack(TAIL, self.f.read(tail))
        if magic != MAGIC or again != MAGIC:
            raise ValueError(f"{path} is no whole token file")
        self.f.seek(index)
        take = lambda n, kind: np.frombuffer(self.f.read(n * np.dtype(kind).itemsize), kind)
        self.offsets = take(-(-self.n // self.block), "<u8")
        self.keys, self.null, self.starts = take(self.docs, "<i8"), take(self.docs, "u1").astype(bool), np.append(take(self.docs, "<u8"), np.uint64(self.n))
        self.end = index

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from place ``start`` on, up to ``stop``."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError(f"{start}:{stop} of {self.n} ids")
        if start == stop:
            return np.zeros(0, "<u4")
        a, b = start // self.block, -(-stop // self.block)
        self.f.seek(int(self.offsets[a]))
        data = self.f.read((int(self.offsets[b]) if b < len(self.offsets) else self.end) - int(self.offsets[a]))
        return unpack(data, self.width, min(b * self.block, self.n) - a * self.block)[start - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's document number ``k``, its end id included."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.f.close()


def _write(folder: str, path: str, width: int, end: int | None):
    def run(batches):
        from pyspark import TaskContext

        out, last = Writer(folder, TaskContext.get().partitionId(), width), np.asarray([] if end is None else [end], "<u4")
        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), encoded(b.column(1), path), strict=True):
                if len(ids) and int(ids.max()) >> width:
                    raise ValueError(f"id {ids.max()} needs more than {width} bits")
                out.add(key, np.concatenate([ids, last]))
        out.close()
        cols = list(zip(*out.done, strict=True)) or [()] * 7
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    return run


def write(docs: DataFrame, path: str | None = None, folder: str | None = None, end: int | None = END) -> DataFrame:
    """Writes the ids of ``doc_id, text`` in ascending order of ids of documents, and returns the manifest of stretches.

    A null text is empty and holds the end id alone; null ids of documents come
    first; rows of one id are all written, in the order of their texts' hashes;
    a long text is encoded whole; other columns are not written. No rows give an
    empty manifest and no file.
    """
    from tokenizers import Tokenizer

    spark, path = docs.sparkSession, path or public_tokenizers.path(TOKENIZER)
    folder = folder or shared_dir(spark, "tokens")
    width = width_of(max(Tokenizer.from_file(path).get_vocab_size(), (end or 0) + 1))
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie")).repartitionByRange(n, "doc_id", "tie")
    return stored(keyed.sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(_write(folder, path, width, end), MANIFEST), "tokens-manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids of all stretches before each.

    Parts are summed first, so that one window holds a row for each part and the
    other one only the stretches of a part.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before(Window.orderBy("part"))), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum("ids").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    return manifest.withColumn("_own", own).join(parts, "part").withColumn("start", F.col("_base") + F.col("_own")).drop("_base", "_own")


def _read(with_ids: bool):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        for b in batches:
            for path, doc, docs, at, start in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                f, rows, held = TokenFile(path), [], 0
                first, lo, got = int(f.starts[doc]), 0, np.zeros(0, "<u4")
                for k in range(doc, doc + docs):
                    a, z, crc, ids = int(f.starts[k]), int(f.starts[k + 1]), 0, []
                    while a < z:
                        if not lo <= a < lo + len(got):
                            lo, got = a, f.ids(a, min(f.n, (a // f.block + 32) * f.block))
                        piece = got[a - lo : z - lo]
                        crc = zlib.crc32(piece.tobytes(), crc)
                        ids += [piece] if with_ids else []
                        a += len(piece)
                    rows.append((None if f.null[k] else int(f.keys[k]), start + int(f.starts[k]) - first, z - int(f.starts[k]), crc, *([np.concatenate(ids).astype(np.int32) if ids else []] if with_ids else [])))
                    held += 64 + (z - int(f.starts[k])) * 4 * with_ids
                    if held > 1 << 22:
                        yield batch(rows)
                        rows, held = [], 0
                f.close()
                if rows:
                    yield batch(rows)

    return run


def read(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document of the files, and its ``ids`` unless they aren't wanted; an empty manifest gives no rows."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s = placed(manifest).select("path", "doc", "docs", "at", "start").repartition(n, "path", "doc")
    return s.mapInArrow(_read(ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document, from the files."""
    return read(write(docs.select("doc_id", "text")), ids=False)
