"""WARC archives as chunked record tables.

A payload travels as rows of record id and chunk number, so neither side of the
Python boundary holds a whole record: the writer compresses chunk after chunk
into one gzip member for each record, the reader inflates members block by block
and gives chunks back with the SHA-1 of the payload so far.

Which records revisit another is decided on ids and digests alone. Archives go
to the folder that all machines share; each attempt of a task writes files of
its own, and only those in the manifest that Spark commits are ever read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, stored

#: Bytes of a chunk; of payloads from which on equal ones are revisits; of an archive, and of a stretch of it that one reader takes.
CHUNK, REVISIT_FROM, ARCHIVE, STRETCH = 1 << 16, 1000, 1 << 28, 1 << 22
#: Up to so many revisits are broadcast; more meet the pages by a join that moves payloads.
REVISITS = 500_000
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "path string, start long, length long, records long"
RECORDS = "record_id string, record_type string, uri string, refers_to string, chunk long, last boolean, size long, sha1 string, stated string, stated_size long, payload binary"


def record_id(c):
    """The id of a record as a URI, from a page's id."""
    return F.concat(F.lit("urn:x-page:"), c.cast("string"))


def revisits(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """``page_id, sha1, refers_to`` of records whose payload a record of larger id has too."""
    light = pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").alias("n")).where((F.col("n") >= least) & F.col("page_id").isNotNull())
    first = light.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    return light.join(first, "sha1").where("page_id < refers_to").select("page_id", "sha1", "refers_to").distinct()


def chunked(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of each record's payload; revisits and empty payloads have one empty chunk."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload).alias("sha1"))
    r = stored(revisits(pages), "warc-revisits").select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "refers_to")
    r = F.broadcast(r) if r.count() <= REVISITS else r
    p = p.join(r, (F.col("page_id") == F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left")
    size = F.octet_length("html").cast("long")
    n = F.when(F.col("refers_to").isNull(), F.greatest(F.ceil(size / chunk), F.lit(1))).otherwise(1)
    p = p.select(record_id(F.col("page_id")).alias("record_id"), "url", "sha1", size.alias("size"), record_id(F.col("refers_to")).alias("refers_to"), n.cast("int").alias("n"), "html")
    p = p.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    data = F.when(F.col("refers_to").isNull(), F.substring(F.col("html"), F.col("chunk") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return p.select("record_id", "url", "sha1", "size", "refers_to", "chunk", (F.col("chunk") == F.col("n") - 1).alias("last"), data.alias("payload"))


def _header(rid: str | None, url: str | None, sha1: str, size: int, refers: str | None) -> bytes:
    """The record's header, and for a response that of its HTTP message."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n" if refers is None else ""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{rid or 'urn:uuid:' + str(uuid.uuid4())}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers}>", f"X-Payload-Length: {size}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + size if refers is None else 0}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


class Archives:
    """Files that one attempt of a task writes, and the stretches of them."""

    def __init__(self, folder: str):
        self.folder, (self.fs, self.root) = folder, pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.out, self.at, self.start, self.records, self.done = None, 0, 0, 0, []

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.at, self.start = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None), 0, 0
        self.out.write(data)
        self.at += len(data)

    def end_record(self) -> None:
        self.records += 1
        if self.at - self.start >= STRETCH:
            self.mark()
        if self.at >= ARCHIVE:
            self.close()

    def mark(self) -> None:
        if self.records:
            self.done.append((f"{self.folder}/{self.name}", self.start, self.at - self.start, self.records))
            self.start, self.records = self.at, 0

    def close(self) -> None:
        if self.out is not None:
            self.mark()
            self.out.close()
            self.out = None


def _write(folder: str, level: int):
    def run(batches):
        files = Archives(folder)
        gz = sha = None
        for b in batches:
            for r in zip(*b.columns, strict=True):
                rid, url, sha1, size, refers, _, last, data = (x.as_py() for x in r)
                if gz is None:
                    gz, sha = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                    files.write(gz.compress(_header(rid, url, sha1, size, refers)))
                sha.update(data)
                files.write(gz.compress(data))
                if last:
                    if refers is None and sha.hexdigest() != sha1:
                        raise ValueError(f"payload of {rid} changed while it was written")
                    files.write(gz.compress(b"\r\n\r\n") + gz.flush())
                    files.end_record()
                    gz = None
        files.close()
        cols = list(zip(*files.done, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["path", "start", "length", "records"])

    return run


def write(pages: DataFrame, folder: str | None = None, level: int = 5) -> DataFrame:
    """Writes a record for each row of ``pages`` and returns the manifest of what was written.

    Null html is an empty payload, a null url leaves its header out, rows that
    repeat are written each (of one id and payload, all as response), a null
    id gets a random record id; other columns are not written. No rows give an
    empty manifest.
    """
    folder = folder or shared_dir(pages.sparkSession, "warc")
    return stored(chunked(pages).mapInArrow(_write(folder, level), MANIFEST), "warc-manifest")


class _Inflated:
    """The inflated bytes of a stretch of gzip members, by line and by piece."""

    def __init__(self, f, length: int):
        self.f, self.left, self.buffer, self.z, self.rest = f, length, b"", zlib.decompressobj(31), b""

    def fill(self) -> bool:
        while True:
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            if not self.rest:
                if not self.left:
                    return False
                self.rest = self.f.read(min(CHUNK, self.left))
                if not self.rest:
                    raise ValueError("the archive is shorter than its manifest says")
                self.left -= len(self.rest)
            got = self.z.decompress(self.rest, CHUNK)
            self.rest = self.z.unconsumed_tail
            if got:
                self.buffer += got
                return True

    def line(self) -> bytes | None:
        while b"\r\n" not in self.buffer:
            if not self.fill():
                return None
        out, self.buffer = self.buffer.split(b"\r\n", 1)
        return out

    def pieces(self, n: int, size: int = CHUNK) -> Iterator[bytes]:
        while n:
            want = min(n, size)
            while len(self.buffer) < want:
                if not self.fill():
                    raise ValueError("the archive ends within a record")
            yield self.buffer[:want]
            self.buffer = self.buffer[want:]
            n -= want


def _headers(source: _Inflated) -> tuple[dict[str, str], int]:
    out, n = {}, 0
    while line := source.line():
        n += len(line) + 2
        key, _, value = line.decode("utf-8", "replace").partition(":")
        out[key.strip().lower()] = value.strip()
    return out, n + 2


def records(source: _Inflated, payloads: bool) -> Iterator[tuple]:
    """Rows of ``RECORDS`` for each chunk of each record."""
    while (line := source.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue  # the empty lines that end a record
        head, _ = _headers(source)
        kind, n = head.get("warc-type", ""), int(head.get("content-length", 0))
        stated = head.get("warc-payload-digest", "")
        stated = base64.b32decode(stated[5:]).hex() if stated.startswith("sha1:") else None
        rid, uri, refers = head.get("warc-record-id", "").strip("<>"), head.get("warc-target-uri"), head.get("warc-refers-to")
        size_stated = head.get("x-payload-length")
        if kind == "response" and n and "application/http" in head.get("content-type", ""):
            inner, used = _headers(source)
            n -= used
            size_stated = inner.get("content-length", size_stated)
        fixed = (rid, kind, uri, refers and refers.strip("<>"))
        sha, at, k = hashlib.sha1(), 0, 0
        for piece in source.pieces(n):
            sha.update(piece)
            at += len(piece)
            if payloads or at == n:
                yield (*fixed, k, at == n, at, sha.hexdigest(), stated, size_stated and int(size_stated), piece if payloads else None)
            k += 1
        if not n:
            yield (*fixed, 0, True, 0, sha.hexdigest(), stated, size_stated and int(size_stated), b"" if payloads else None)


TYPES = [pa.string()] * 4 + [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
NAMES = [x.split()[0] for x in RECORDS.split(", ")]


def _read(payloads: bool):
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)

    def run(batches):
        for b in batches:
            for path, start, length in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                fs, name = pa.fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    f.seek(start)
                    for r in records(_Inflated(f, length), payloads):
                        rows.append(r)
                        held += len(r[-1] or b"") + 300
                        if held > 1 << 22:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return run


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The chunk rows of the archives of a manifest: ``sha1`` and ``size`` are those of the payload so far.

    Without ``payloads``, each record's last row only, its payload null.
    """
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path", "start", "length").repartition(n, "path", "start").mapInArrow(_read(payloads), RECORDS)


def page_id(c):
    return F.regexp_extract(c, r"^urn:x-page:(-?[0-9]+)$", 1).try_cast("long")


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns for each page, from the archives."""
    r = read(write(pages.select("page_id", "url", "html")), payloads=False).where("last")
    revisit = F.col("record_type") == "revisit"
    return r.select(
        page_id(F.col("record_id")).alias("page_id"), F.when(revisit, F.col("stated_size")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(revisit, F.col("stated")).otherwise(F.col("sha1")).alias("payload_digest"), "record_type", page_id(F.col("refers_to")).alias("refers_to"),
    )


def archive(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives to a folder and returns their records, payloads included."""
    return read(write(pages, folder))
