"""op8's files and pages stay in one Python worker of a task."""

import pyarrow as pa

from quillon.llm import media


def test_a_task_has_one_python_worker(spark, tmp_path):
    texts = [None, "", "x" * 64, "é" * 70_000, "a line of text\n" * 20, "x" * 64]
    docs = spark.createDataFrame([(k if k != 4 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = media.op8_tiff(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") + plan.count("MapInArrow") == 1
    through_jvm = media.pages(media.files(docs.repartition(3)), "media").mapInArrow(media._digests, media.DIGEST_SQL)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(found) == rows(through_jvm) and len(rows(found)) == len(texts)


def test_batches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(media, "BATCH_BYTES", 1000)
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "text": ["word " * 60] * 50}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    made = list(media.page_batches("media")(media.file_batches(iter([docs]))))
    assert [x for b in made for x in b.column("doc_id").to_pylist()] == list(range(50))
    assert max(sum(map(len, b.column("samples").to_pylist())) for b in made) < 1000 + 320
