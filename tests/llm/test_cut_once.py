"""The pipeline's stages run a Python function on a text once."""

from quillon.llm import linededup


def test_lines_are_cut_once(spark):
    rows = [(1, "en", "s", "the same line stands here twice\nalone in one document", 53), (2, "en", "s", "the same line stands here twice\nnothing like it", 47), (3, "en", "s", "the same line stands here twice", 31)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, n_chars int")
    left = linededup.drop_lines(spark, docs, "")
    assert left._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in left.orderBy("doc_id").collect()] == [(1, rows[0][3], 53), (2, "nothing like it", 15)]
