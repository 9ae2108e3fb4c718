import pytest
from compare import check
from conftest import SF

import corpus_pipeline
from chronoscope.llm import queries
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.SQL[name], SF)


def test_native_queries_use_no_python(spark):
    for name in ("op4_url_filters", "op5_quality", "op9_licenses"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    kept = {r["doc_id"] for r in good.collect()}
    assert kept and not any(brute.quality(t)[-1] for i, t in plain if i in kept)
    rows = [(i, t) for i, t in plain if i in kept]
    near = {i for i, _, _, k in brute.near(rows, 5, 80) if k}
    left = {i: t for _, (i, t) in enumerate(rows) if i in near}
    cut = {i: (kept_text if gone else left[i]) for i, _, gone, kept_text in brute.substrings(sorted(left.items()))}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, n, h, _ in brute.hits(sorted(cut.items()), bench) if not (h > 0 and 20 * h >= n)}
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert out == {i: t.encode(cut[i], add_special_tokens=False).ids for i in clean}


def test_stages_keep_the_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = docs.unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10**6)))
    odd = odd.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit("y")).withColumn("items", F.lit(1)).withColumn("score", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (odd, odd.where("false")):
            out = stage(spark, d, SF)
            assert out.columns == odd.columns, name
            out.count()
