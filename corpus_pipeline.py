"""A corpus pipeline: five stages from raw documents to tokens.

Each stage takes the documents that the stage before it kept, as they were
left, and its decisions take effect in what it returns. All but the last
return the columns of ``documents``, whatever other columns these have. A long
text is one row and is taken whole; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoscope.llm import bpe, decontaminate, neardup, quality, substrings
from chronoscope.llm.shared import stored, table


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and all other columns in one struct, so that no name can clash with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*rest).alias("_rest")] if rest else []))


def _unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the log-likelihood ratio pass; empty and null texts go."""
    return _unpacked(quality.judge(_packed(docs), table(spark, sf_dir, "labels")).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (5-word shingles, 0.8), that of least id; rows of one id are one document, rows without an id stay."""
    return _unpacked(neardup.survivors(_packed(docs), k=5, percent=80), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 13-word windows that a document of smaller id has too; texts that lose none stay as they are."""
    out = substrings.deduplicate(_packed(docs))
    out = _unpacked(out.withColumn("text", F.when(F.col("_n_removed") > 0, F.col("_kept")).otherwise(F.col("text"))), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth is in windows of benchmark items; null and empty texts stay, rows that repeat are judged one by one."""
    marked = decontaminate.mark(_packed(docs), table(spark, sf_dir, "benchmark"))
    return _unpacked(marked.where(~decontaminate.contaminated()), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and the digest of what these decode to, in place of the text; all other columns stay but those of these names. Null and empty texts have no ids, rows that repeat are encoded each."""
    return bpe.encode(docs, wanted=("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Hashed n-grams, MinHash and BPE have no counterpart in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
