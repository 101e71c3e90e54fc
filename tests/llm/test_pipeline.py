import os

import pytest

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the driver's tables are not here")


def test_stages(spark, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in C.STAGES:
        out = stage(spark, docs, D)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == columns and 0 < out.count() <= before
            before = out.count()
            docs = out
    left = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == left
    sizes = out.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect()
    assert all(r.doc_tokens == r["sum(length)"] for r in sizes)


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
