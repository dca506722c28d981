"""The mix against its SQL and against what it promises."""

import duckdb
import pytest

from quillon.llm import mixing


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    got = mixing.mix(docs).rows.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken").toPandas()
    c = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    c.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(source AS VARCHAR) AS source FROM documents")
    want = c.execute(mixing.OP4_SQL).fetchall()
    key = lambda r: tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r)
    assert sorted(key((None if r[0] != r[0] else int(r[0]), *map(int, r[1:3]), float(r[3]), int(r[4]))) for r in got.values.tolist()) == sorted(key((r[0], r[1], r[2], float(r[3]), r[4])) for r in want)
    return docs, got


def test_mix_matches_sql(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 7 % 23)), ["a", "b", "c", None, "é"][k % 5] if k % 3 else "a", None) for k in range(400)]
    docs, got = check(spark, rows)
    total = got["size"].sum()
    assert abs(got["taken"].sum() - total) < 30
    by = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by["target"] - by["taken"]) < 60).all()
    assert (got["taken"] <= 3 * got["size"]).all()
    out = mixing.mixed(spark, docs, "")
    assert out.columns == [*docs.columns, "copies_"]
    assert sum(len(r["text"].split()) * r["copies_"] for r in out.collect()) == got["taken"].sum()


@pytest.mark.parametrize("rows", [
    [(1, None, None, None)],
    [(None, "a b", "x", None), (None, "a b", "x", None), (2, "", "y", None)],
    [(1, "a", "x", None), (2, "b " * 500, "y", None)],
])
def test_odd_tables(spark, rows):
    check(spark, rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).rows.count() == 0
    assert mixing.mixed(spark, docs, "").count() == 0


def test_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    check(spark, [(k, "w " * (k % 9), "ab"[k % 2], None) for k in range(150)])


def test_targets_stop_at_three_times_a_source(spark):
    docs = spark.createDataFrame([(k, "w " * n, s) for k, (s, n) in enumerate([("a", 10), ("b", 1000), ("c", 1000)])], "doc_id long, text string, source string")
    t = {r["source"]: r["target"] for r in mixing.mix(docs).sources.collect()}
    assert t["a"] == 30 and abs(t["b"] - 1980 * 2 / 3) < 1e-6 and abs(sum(t.values()) - 2010) < 1e-6
