"""The stages against what their operators decide, on the smallest tables."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark, tmp_path):
    from quiverlake.llm import decontaminate, jaccard_join, secrets

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns and 0.5 * n < docs.count() <= n
            n = docs.count()
        if k == 1:
            found = jaccard_join.jaccard_components(before).collect()
            assert {r["doc_id"] for r in docs.collect()} == {r["component_id"] for r in found}
        if k == 2:
            bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
            assert decontaminate.contamination(docs, bench, ["doc_id"]).where("size(items) > 1").count() == 0
        if k == 3:
            assert secrets.scan(docs).where("exists(secret_spans, x -> x.rank < 3)").count() == 0
    assert {"copy_no", "mix_key"} <= set(docs.columns)


def test_repeated_ids_are_decided_by_row(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, one), (5, one), (5, two), (7, three), (7, three), (8, ""), (8, ""), (None, one)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, one), (5, two), (7, three), (8, ""), (8, ""), (None, one)]))
