"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens that the tokenizer never merges across. The
lengths of frequent pre-tokens are broadcast as one table of fixed size; other
pre-tokens are encoded by the library and kept in a cache of each Python
worker. No pre-token is shuffled: only each task's bounded list of frequent
ones is, to build the table.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
#: Entries of the broadcast table, and how many bytes each pre-token in it has at most: together its size bound.
FREQUENT, FREQUENT_BYTES = 32_768, 32
#: Longer pre-tokens (in characters) are encoded each time and not kept.
KEPT_CHARS = 256
#: Pre-tokens that each task reports at most, and that it and a worker's cache hold at most.
REPORTED, CACHED = 8_192, 400_000
MARK = "▁"


class Pieces:
    """A sentencepiece BPE model, split into independent parts.

    The model turns a space into the mark U+2581 and puts one before the text.
    No merge joins another character to a mark after it, so a text falls apart
    before each run of marks. A character that occurs in no piece longer than
    itself (the line feed, here) merges with nothing, so a text also falls
    apart before it. Both facts are checked on the vocabulary.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        whole = [p for p in pieces if len(p) > 1 and not re.fullmatch(r"<0x[0-9A-F]{2}>", p)]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in whole):
            raise ValueError(f"{path} has pieces that run over a space; its texts can't be split there")
        alone = "\n" if not any("\n" in p for p in whole) else ""
        self.alone = alone
        self.find = re.compile(f"[{alone}][^ {MARK}{alone}]*|[ {MARK}]+[^ {MARK}{alone}]*" if alone else f"[ {MARK}]+[^ {MARK}]*").findall

    def split(self, text: str) -> list[str]:
        return self.find(" " + text) if text else []

    def lengths(self, parts: list[str]) -> list[int]:
        """Tokens of each part within a text: its first space is the one that the model would add, and counts as one token before a line feed."""
        shown = [p if p[0] == self.alone else p[1:] for p in parts]
        got = self.model.encode(shown, num_threads=1)
        return [len(g) - 1 if p[0] == self.alone else len(g) if s else 1 for p, s, g in zip(parts, shown, got, strict=True)]


_models: dict[str, Pieces] = {}
_cache: dict[str, dict[str, int]] = {}


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def texts_of(b: pa.RecordBatch, column: str):
    """The texts of a batch one by one; null is empty."""
    for x in b.column(b.schema.names.index(column)):
        yield x.as_py() or ""


def _frequent(path: str):
    def run(batches):
        model, counts = pieces(path), Counter()
        for b in batches:
            for text in texts_of(b, "text"):
                counts.update(p for p in model.split(text) if len(p) <= FREQUENT_BYTES)
                if len(counts) > CACHED:  # lossy counting: what is rare so far starts again
                    counts = Counter(dict(counts.most_common(CACHED // 4)))
        top = [(k, n) for k, n in counts.most_common(REPORTED) if n > 1 and len(k.encode()) <= FREQUENT_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["part", "n"])

    return run


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """Token lengths of the most frequent pre-tokens of all documents, at most ``FREQUENT``."""
    top = docs.select("text").mapInArrow(_frequent(path), "part string, n long").groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(FREQUENT)
    parts = [r["part"] for r in top.collect()]
    return dict(zip(parts, pieces(path).lengths(parts), strict=True))


def _count(path: str, table):
    def run(batches):
        model, first = pieces(path), table.value
        known = _cache.setdefault(path, {})
        for b in batches:
            n = []
            for text in texts_of(b, "text"):
                parts = model.split(text)
                got = [first.get(p) for p in parts]
                if None in got:
                    rest = [p for p, g in zip(parts, got, strict=True) if g is None]
                    long = [p for p in rest if len(p) > KEPT_CHARS]
                    if long:
                        rest = [p for p in rest if len(p) <= KEPT_CHARS]
                        rest_n = sum(model.lengths(long))
                    else:
                        rest_n = 0
                    new = list({p for p in rest if p not in known})
                    if new:
                        if len(known) + len(new) > CACHED:
                            known.clear()
                            new = list(set(rest))
                        known.update(zip(new, model.lengths(new), strict=True))
                    n.append(sum(g for g in got if g is not None) + sum(known[p] for p in rest) + rest_n)
                else:
                    n.append(sum(got))
            names = [x for x in b.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(x)) for x in names), pa.array(n, pa.int64())], [*names, "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` without ``text`` and with ``n_tokens`` added.

    Null and empty texts have no tokens; a long text is counted whole, by its
    parts; rows that repeat are counted alike; an empty table gives no rows;
    other columns pass through, one named ``n_tokens`` is replaced.
    """
    path = path or public_tokenizers.path(MODEL)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))
    docs = docs.drop("n_tokens")
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != "text"), T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(_count(path, table), schema)


def digest(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """The contract's columns for each document."""
    d = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    return count_tokens(d, path).withColumn("over_limit", F.col("n_tokens") > limit)
