import pytest

import corpus_pipeline

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "token_files":
            total = out.selectExpr("max(start + n_tokens) AS end", "sum(n_tokens) AS n", "count(*) AS docs").first()
            assert total["end"] == total["n"] and total["docs"] == sizes[-1]
            break
        assert out.columns == first.columns and out.dtypes == first.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
        known = {r.doc_id: r for r in first.collect()}
        assert all(known[r.doc_id] == r for r in docs.collect())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
