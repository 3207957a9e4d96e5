"""The pipeline over the smallest tables, stage by stage."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lanwatch.llm import decontaminate, language, pieces, secrets

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"row": F.lit(1), "h": F.lit("x"), "d": F.lit(2)})
    for name, stage in cp.STAGES[:-1]:
        out = cp.cut(stage(spark, docs, SF))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        gone = docs.count() - out.count()
        if name == "language_id":
            assert gone == language.identify(docs, language.learn(docs)).where("lang_rejected").count()
        if name == "benchmark_decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert decontaminate.contamination(out, bench).where("contaminated").count() == 0
        if name == "secret_scan":
            assert gone == 0 and secrets.scan(out)[0].count() == 0 and out.where(F.length("text") != F.col("n_chars")).count() == 0
        docs = out
    last = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count() and all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in last)
