import importlib.util

import pytest

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")


def test_stages_in_order_keep_columns_and_clean_documents(spark, small, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            assert 0.5 * n < out.count() <= docs.count()
        docs = out
    assert docs.columns == [*columns, "copy"]
    again = corpus_pipeline.run(spark, small)
    key = lambda df: sorted((r["doc_id"], r["copy"]) for r in df.select("doc_id", "copy").collect())
    assert key(again) == key(docs)


def test_run_on_edge_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    from .helpers import edge, empty

    items = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    for name, docs in (("edge", edge(spark)), ("empty", empty(spark))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        # `copy` may be a column of the documents already.
        assert out.columns == [*docs.columns, "_copy" if "copy" in docs.columns else "copy"]
        rows = out.collect()
        assert all(r["text"] and any(map(str.isalpha, r["text"])) for r in rows) and bool(rows) == (name == "edge")
