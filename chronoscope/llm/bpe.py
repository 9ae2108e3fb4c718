"""BPE encoding with content-defined chunk reuse, and decoding.

Texts are cut into chunks where a rolling hash of their bytes says so, so that
documents that share a passage share its chunks. A chunk found more than once
in the corpus is encoded once, by the document that owns it; its ids travel to
the other documents that have it. Chunks found once are encoded where they are.
The joins between chunks are then repaired: the words around a join are encoded
again, in a window that grows until its ids agree exactly with those on both
sides.

A Bloom filter of fixed size tells, on the map side, which documents may hold
shared chunks. All others are finished in their scan; only those travel, with
the keys and ends of their chunks.

Reuse needs a tokenizer that treats words between white space alone, and the
cache of words one whose parts of words are known; both are read from its file.
With any other tokenizer whole texts go to the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash as wh
from .shared import stored

TOKENIZER = "word_bpe_49k.json"
#: Chunks have at least this many bytes, and ``1 << AVERAGE_BITS`` more on average.
LEAST, AVERAGE_BITS = 64, 9
MOST = 1 << 16
#: Bits of the Bloom filter: 16 MB, whatever the corpus; where it fills up, more documents travel.
BLOOM_BITS = 1 << 27
#: Words that a worker keeps encoded in each of two generations, and the longest such word in bytes.
CACHED, CACHED_BYTES = 150_000, 64
#: Words that go to the library as one text.
JOINED = 512
CHUNKS = "key binary, slot long, doc_id {id}, n long"
ROLLED = 16


def _ends(data: np.ndarray) -> np.ndarray:
    """Where the rolling hash ends a chunk, in pieces of bounded size."""
    out, values = [], wh.byte_values(11)
    for at in range(0, len(data), wh.PIECE):
        lo = max(0, at - ROLLED)
        h = values[data[lo : at + wh.PIECE]]
        m, step = wh.U(0x9E3779B97F4A7C15), 1
        while step < ROLLED:  # a polynomial over the last bytes, by doubling
            h[step:] = h[step:] + h[:-step] * m
            m, step = wh.U(int(m) * int(m) % (1 << 64)), step * 2
        may = np.flatnonzero((wh.mix(h) >> wh.U(64 - AVERAGE_BITS)) == 0) + 1 + lo
        out.append(may[may > at])
    ends = np.concatenate(out) if out else np.zeros(0, np.int64)
    return ends[(ends == len(data)) | ((data[np.minimum(ends, len(data) - 1)] & 0xC0) != 0x80)]  # never within a character


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each row of a piece, the byte positions where its chunks end."""
    at = _ends(data)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        last, ends = a, []
        for c in at[np.searchsorted(at, a + LEAST) : np.searchsorted(at, b)]:
            while c - last > MOST:
                last = _boundary(data, last + MOST)
                ends.append(last)
            if c - last >= LEAST:
                ends.append(int(c))
                last = c
        while b - last > MOST:
            last = _boundary(data, last + MOST)
            ends.append(last)
        if b > last:
            ends.append(int(b))
        out.append(np.array(ends, np.int64))
    return out


def _boundary(data: np.ndarray, at: int) -> int:
    while data[at] & 0xC0 == 0x80:
        at -= 1
    return int(at)


def texts(b: pa.RecordBatch, column: str = "text"):
    """(row, text bytes) of each row of a batch; null is empty."""
    data, off = wh.text_buffers(b.column(b.schema.names.index(column)))
    for row in range(len(off) - 1):
        yield row, data[off[row] : off[row + 1]].tobytes()


def chunks(b: pa.RecordBatch, column: str = "text"):
    """(row, text bytes, chunk keys, chunk ends) of each row of a batch."""
    data, off = wh.text_buffers(b.column(b.schema.names.index(column)))
    for i, j in wh.pieces(off):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        for k, ends in enumerate(cuts(d, o)):
            a = int(o[k])
            raw = d[a : int(o[k + 1])].tobytes()
            e = (ends - a).tolist()
            yield i + k, raw, [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip([0, *e], e, strict=False)], e


def _slots(keys: list[bytes]) -> np.ndarray:
    """The place of each key in the Bloom filter."""
    return np.frombuffer(b"".join(keys), np.int64)[::2] % BLOOM_BITS


def _maybe(table: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """Which keys the filter may hold."""
    at = _slots(keys)
    return (table[at >> 3] >> (at & 7) & 1).astype(bool)


def _chunk_rows(batches):
    """Each document's distinct chunks; ones it holds twice count twice."""
    for b in batches:
        rows, keys, n = [], [], []
        for row, _, parts, _ in chunks(b):
            count: dict[bytes, int] = {}
            for k in parts:
                count[k] = count.get(k, 0) + 1
            keys += count
            n += count.values()
            rows += [row] * len(count)
        if rows:
            ids = b.column(b.schema.names.index("doc_id")).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(_slots(keys)), ids, pa.array(n, pa.int64())], ["key", "slot", "doc_id", "n"])


LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: What the tokenizer treats alone within plain words: letters, digits one by one, and punctuation.
PARTS = re.compile(f"[{LATIN}]+|[0-9]|[!-&(-/:-@[-`{{-~]+| ")
#: The bytes of plain words: ASCII without the apostrophe, and letters of two bytes.
PLAIN = bytes(x for x in range(0x21, 0x7F) if x != 0x27) + bytes([0xC3, *range(0x80, 0xC0)])
#: What else words may not hold that go to the library together: the signs among those letters, and the mark of a special token.
APART = re.compile(b"\xc3\x97|\xc3\xb7|<\\|")
# The normaliser and the splitting pattern for which the above holds.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Encoder:
    """The library's tokenizer, with a cache of words.

    Where both its normaliser and its pre-tokeniser work within words between
    ASCII white space (``by_words``), a text's ids are those of such words in
    turn, and a plain word's are those of its letters, digits and punctuation.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        n = self.t.get_vocab_size(with_added_tokens=True)
        self.decimal = [str(i) for i in range(n)]
        self.token = [self.t.id_to_token(i) for i in range(n)]
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        mark = made["model"].get("end_of_word_suffix")
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        words = steps[0].get("pattern") == {"Regex": SPLIT} and [x.get("add_prefix_space") for x in steps[1:]] == [False]
        added = all(x["content"].startswith("<|") and not x["normalized"] and not x["lstrip"] and not x["rstrip"] for x in made["added_tokens"])
        self.by_words = bool(mark and words and added and made["normalizer"] == NORMAL and not made["post_processor"])
        self.ends_word = np.array([bool(mark) and (x or "").endswith(mark) for x in self.token])
        self.joins_tokens = made.get("decoder") is None

    def library(self, text: str) -> bytes:
        (made,) = self.t.encode_batch_fast([text], add_special_tokens=False)
        return np.array(made.ids, "<u4").tobytes()

    def whole(self, raw: bytes) -> bytes:
        return self.library(raw.decode())

    def encode(self, raw: bytes) -> bytes:
        """The ids of a text as packed 32-bit integers."""
        if not self.by_words:
            return self.whole(raw)
        ws = raw.split()
        got = list(map(self.young.get, ws))
        if None in got:
            fresh = self.learn({w for w, g in zip(ws, got, strict=True) if g is None})
            got = [fresh[w] if g is None else g for w, g in zip(ws, got, strict=True)]
        return b"".join(got)

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words that aren't among the young: from the older ones, or the library."""
        out = {w: g for w in words if (g := self.old.get(w)) is not None}
        new = [w for w in words if w not in out] if out else list(words)
        plain = [w for w in new if not w.translate(None, PLAIN)]
        if APART.search(b" ".join(plain)):
            plain = [w for w in plain if not APART.search(w)]
        for at in range(0, len(plain), JOINED):
            out |= self.together(plain[at : at + JOINED])
        for w in new:
            if w not in out:
                out[w] = self.whole(w)
        self.young.update(out if max(map(len, words)) <= CACHED_BYTES else {w: g for w, g in out.items() if len(w) <= CACHED_BYTES})
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        return out

    def together(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of plain words that make one text: each of their parts ends with a token that ends a word."""
        text = b" ".join(words).decode()
        gaps = np.flatnonzero([p == " " for p in PARTS.findall(text + " ")])
        parts = gaps - np.arange(len(gaps))  # parts up to each word's end
        ids = np.frombuffer(self.library(text), "<u4")
        cut = np.flatnonzero(self.ends_word[ids]) + 1 if len(ids) else ids
        if len(gaps) != len(words) or len(cut) != parts[-1]:
            return {w: self.whole(w) for w in words}
        packed, e = ids.tobytes(), (4 * cut[parts - 1]).tolist()
        return {w: packed[x:y] for w, x, y in zip(words, [0, *e], e, strict=False)}

    def stitch(self, raw: bytes, keys: list[bytes], ends: list[int], have: dict[bytes, bytes]) -> bytes:
        """The ids of a whole text from those of its chunks; ``have`` holds some chunks' ids."""
        done, out, k = 0, [], 0
        while k < len(keys):
            right = have.get(keys[k])
            while right is None and k + 1 < len(keys) and keys[k + 1] not in have:  # one stretch, without a join
                k += 1
            while k + 1 < len(keys) and not _breaks(raw, done, ends[k]):  # within a longer word
                k, right = k + 1, None
            if right is None:
                right = self.encode(raw[done : ends[k]])
            if done:
                self.repair(raw, done, ends[k], out, right)
            else:
                out.append(right)
            done, k = ends[k], k + 1
        return b"".join(out)

    def repair(self, raw: bytes, at: int, end: int, out: list[bytes], right: bytes) -> None:
        """Makes ``out`` the ids of ``raw[:end]``, from exact ids of ``raw[:at]`` in it and of ``raw[at:end]``; only its last pieces are touched."""
        n, left = 1, b""
        while True:
            a, b = _back(raw, at, n + 1), _forth(raw, at, end, n + 1)
            tail, head = self.encode(raw[a:at]), self.encode(raw[at:b])
            window = self.whole(raw[a:b])
            kept_l, kept_r = self.encode(raw[a : _back(raw, at, 1)]), self.encode(raw[_forth(raw, at, end, 1) : b])
            while len(left) < len(tail) and out:
                left = out.pop() + left
            if left.endswith(tail) and right.startswith(head) and window.startswith(kept_l) and window.endswith(kept_r):
                out += [left[: len(left) - len(tail)], window, right[len(head) :]]
                return
            if a == 0 and b == end:
                out[:] = [window]
                return
            n *= 2

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decode() gives; a tokenizer without a decoder joins tokens by spaces."""
        if not self.joins_tokens:
            return self.t.decode(ids.tolist(), skip_special_tokens=False)
        token = self.token
        return " ".join([token[i] for i in ids.tolist()])

    def spelled(self, ids: np.ndarray) -> str:
        """The ids in decimal, joined by one space."""
        return " ".join([self.decimal[i] for i in ids.tolist()])


SPACES = b" \t\n\x0b\x0c\r"


def _breaks(raw: bytes, a: int, b: int) -> bool:
    return len(raw[a:b].split(None, 1)) > 1 or raw[a] in SPACES or raw[b - 1] in SPACES


def _back(raw: bytes, at: int, n: int) -> int:
    """Where the last ``n`` words before ``at`` begin."""
    size = 64 * n
    while True:
        lo = max(0, at - size)
        i = at
        for _ in range(n):
            while i > lo and raw[i - 1] in SPACES:
                i -= 1
            while i > lo and raw[i - 1] not in SPACES:
                i -= 1
        if i > lo or lo == 0:
            return i
        size *= 4


def _forth(raw: bytes, at: int, end: int, n: int) -> int:
    """Where the first ``n`` words after ``at`` end; a word cut at ``at`` counts."""
    i = at
    for _ in range(n):
        while i < end and raw[i] in SPACES:
            i += 1
        while i < end and raw[i] not in SPACES:
            i += 1
    return i


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def bloom(shared: DataFrame) -> np.ndarray:
    """A bitmap of the shared keys' slots; its size is fixed."""
    bits = shared.select((F.col("slot") + 1).alias("s")).select(F.bitmap_bucket_number("s").alias("b"), F.bitmap_bit_position("s").alias("p"))
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in bits.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect():
        m = np.frombuffer(r["m"], np.uint8)
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = m
    return out


def _travels(filter_, fields: list[str]):
    """The rows that may hold shared chunks, with their chunks' keys and ends; rows without an id never travel."""

    def run(batches):
        table = filter_.value
        for b in batches:
            ids = b.column(b.schema.names.index("doc_id"))
            rows, keys, ends = [], [], []
            for row, _, k, e in chunks(b):
                if k and ids[row].is_valid and _maybe(table, k).any():
                    rows.append(row)
                    keys.append(b"".join(k))
                    ends.append(e)
            kept = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(kept.schema.names.index(n)) for n in fields), pa.array(keys, pa.binary()), pa.array(ends, pa.list_(pa.int64()))], [*fields, "keys", "ends"])

    return run


def _keys(packed: bytes) -> list[bytes]:
    return [packed[i : i + 16] for i in range(0, len(packed), 16)]


def _uses(filter_):
    """The chunks of each travelling document that the filter may hold, once each."""

    def run(batches):
        table = filter_.value
        for b in batches:
            rows, keys = [], []
            for row, packed in enumerate(b.column(b.schema.names.index("keys")).to_pylist()):
                mine = _keys(packed)
                mine = list({k for k, m in zip(mine, _maybe(table, mine).tolist(), strict=True) if m})
                keys += mine
                rows += [row] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(b.schema.names.index("doc_id")).take(pa.array(rows, pa.int64()))], ["key", "doc_id"])

    return run


def _encode_owned(path: str):
    """Ids of the chunks that a document owns."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            column = lambda c: b.column(b.schema.names.index(c))  # noqa: E731, B023
            owned, packed, ends = column("owned"), column("keys"), column("ends")
            keys, out = [], []
            for row, raw in texts(b):
                want, e = set(owned[row].as_py()), ends[row].as_py()
                for key, x, y in zip(_keys(packed[row].as_py()), [0, *e], e, strict=False):
                    if key in want:
                        want.discard(key)
                        keys.append(key)
                        out.append(enc.encode(raw[x:y]))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["key", "ids"])

    return run


#: What encode() can add, with its type.
RESULTS = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
TYPES = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def _finish(path: str, names: list[str], wanted: list[str], filter_=None):
    """Adds the results to each row; some text's worth of rows at a time.

    Without a filter, rows have the keys and ends of their chunks and, in
    ``have``, the ids of shared ones. With it, rows that travel by it are left out.
    """

    def result(b: pa.RecordBatch, rows: list[int], new: list[dict]) -> pa.RecordBatch:
        part = b.take(pa.array(rows, pa.int64()))
        made = [pa.array([x[w] for x in new], RESULTS[w]) for w in wanted]
        return pa.RecordBatch.from_arrays([*(part.column(b.schema.names.index(n)) for n in names), *made], [*names, *wanted])

    def packed_ids(enc: Encoder, b: pa.RecordBatch):
        column = lambda c: b.column(b.schema.names.index(c))
        if filter_ is None:
            keys, ends, have = column("keys"), column("ends"), column("have")
            for row, raw in texts(b):
                known = {x["k"]: x["ids"] for x in have[row].as_py() or ()}
                yield row, raw, enc.stitch(raw, _keys(keys[row].as_py()), ends[row].as_py(), known)
        elif not enc.by_words:
            for row, raw in texts(b):
                yield row, raw, enc.whole(raw)
        else:
            ids = column("doc_id")
            for row, raw, keys, _ in chunks(b):
                if not (keys and ids[row].is_valid and _maybe(filter_.value, keys).any()):
                    yield row, raw, enc.encode(raw)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            rows, new, held = [], [], 0
            for row, raw, packed in packed_ids(enc, b):
                ids = np.frombuffer(packed, "<u4")
                text = enc.decode(ids) if any(w.startswith("decoded") for w in wanted) else ""
                every = {"ids": lambda: ids, "decoded": lambda: text, "n_tokens": lambda: len(ids), "ids_sha256": lambda: _sha(enc.spelled(ids)), "decoded_sha256": lambda: _sha(text)}  # noqa: B023
                rows.append(row)
                new.append({w: every[w]() for w in wanted})
                held += len(raw) + 200
                if held > wh.PIECE:
                    yield result(b, rows, new)
                    rows, new, held = [], [], 0
            if new:
                yield result(b, rows, new)

    return run


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def encode(docs: DataFrame, path: str | None = None, wanted: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``docs`` with the ``wanted`` results in place of ``text``: any of ``RESULTS``.

    Null and empty texts have no ids and decode to the empty string; a long
    text is cut in pieces and its joins are repaired in time that follows its
    length; rows that repeat, also under one id, each get their own result;
    rows without an id are encoded without reuse; an empty table gives no rows.
    Other columns pass through, whatever their names, those of a wanted name
    are replaced.
    """
    docs = docs.drop(*wanted)
    spark, path = docs.sparkSession, path or public_tokenizers.path(TOKENIZER)
    by_words = encoder(path).by_words
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    d = docs.select("doc_id", "text", *([F.struct(*(F.col(f"`{c}`") for c in extra)).alias("rest")] if extra else []))
    id_type = d.schema["doc_id"].dataType.simpleString()
    known = d.select("doc_id", "text").where(F.col("doc_id").isNotNull() if by_words else F.lit(False))
    rows = known.mapInArrow(_chunk_rows, CHUNKS.format(id=id_type))
    shared = stored(rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("slot").alias("slot"), F.min("doc_id").alias("owner")).where("n > 1").drop("n"), "bpe-shared")
    table = spark.sparkContext.broadcast(bloom(shared))

    fields = [f for f in d.schema.fields if f.name != "text"]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, *(T.StructField(w, TYPES[w]) for w in wanted)])
    alone = d.mapInArrow(_finish(path, names, list(wanted), table), schema)
    with_chunks = T.StructType([*d.schema.fields, T.StructField("keys", T.BinaryType()), T.StructField("ends", T.ArrayType(T.LongType()))])
    moving = d.where(F.lit(by_words)).mapInArrow(_travels(table, d.columns), with_chunks).withColumn("key_id", F.col("doc_id")).where("key_id is not null").repartition("key_id")
    owned = shared.groupBy(F.col("owner").alias("key_id")).agg(F.collect_list("key").alias("owned"))
    encoded = moving.join(owned, "key_id").mapInArrow(_encode_owned(path), "key binary, ids binary").dropDuplicates(["key"])
    found = moving.mapInArrow(_uses(table), f"key binary, doc_id {id_type}").join(encoded, "key")
    have = found.groupBy(F.col("doc_id").alias("key_id")).agg(F.collect_set(F.struct(F.col("key").alias("k"), "ids")).alias("have"))
    out = alone.unionByName(moving.join(have, "key_id", "left").mapInArrow(_finish(path, names, list(wanted)), schema))
    return out.select(*(F.col(c) if c == "doc_id" else F.col(f"rest.`{c}`") for c in docs.columns if c != "text"), *wanted)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns for each document."""
    return encode(docs.select("doc_id", "text"), path, ("n_tokens", "ids_sha256", "decoded_sha256"))
