"""Queries over benchmark items ask every item."""

import pytest

from quillon.plans import registry


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(k, f"Is ring {k} red? It is.") for k in range(17, 24)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, f"Ring {k} is red. It is so.") for k in range(3)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["embed_and_rerank", *sorted(n for n in registry.QUERIES if n.startswith("method_"))])
def test_every_item_is_asked(spark, folder, name):
    assert {r["query_id"] for r in registry.QUERIES[name](spark, folder).select("query_id").collect()} == set(range(17, 24))
