"""MinHash near-duplicates of documents, with tensored banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash
from .common import Bounded, fresh, keep, table
from .links import bounded, counted, linked, tensored

#: Words of a shingle, least similarity in hundredths, band halves of each collection, hashes of a half.
WORDS, PERCENT, M, HALF = 5, 75, 16, 3
SIGNED = "n_shingles long, node long, a array<long>, b array<long>"


def word_list(text: str | None) -> list[bytes]:
    """The words, A-Z as a-z; bytes.lower and bytes.split know ASCII only, as is wanted."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def doc_key():
    """Tells rows by id and text, a null from any value."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("string"), F.col("text").isNull(), F.col("text"))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, n_shingles, node, a, b: of each document its number of shingles, the id of its shingle set, and the keys of the two collections."""

    @F.pandas_udf(SIGNED)
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        factors, offsets = minhash.functions(2 * M * HALF, 5, 64)
        of_word = Bounded(minhash.word_hash)
        for texts in batches:
            sets = [minhash.word_shingles(word_list(t), of_word, WORDS) for t in texts]
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            keys = np.zeros((len(sets), 2 * M), np.int64)
            at = 0
            while at < len(full):  # some million hashes at a time
                end = at + max(1, int(np.searchsorted(np.cumsum(sizes[full[at:]]), 1_000_000)))
                part = full[at:end]
                starts = np.cumsum(sizes[part]) - sizes[part]
                keys[part] = minhash.halves(minhash.minima(np.concatenate([sets[k] for k in part]), starts, factors, offsets), HALF)
                at = end
            yield pd.DataFrame({"n_shingles": sizes, "node": [minhash.set_id(s) if len(s) else None for s in sets], "a": list(keys[:, :M]), "b": list(keys[:, M:])}).astype({"node": "Int64"})

    return docs.select("doc_id", doc_key().alias("doc_key"), sign("text").alias("s")).select("doc_id", "doc_key", "s.*")


def shingle_sets(docs: DataFrame, where: DataFrame, n: int) -> DataFrame:
    """node, items of the nodes of `where` (node, doc_key: a row of docs that has the set), which has n rows."""

    @F.pandas_udf("array<long>")
    def items(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of_word = Bounded(minhash.word_hash)
        for texts in batches:
            yield pd.Series([minhash.word_shingles(word_list(t), of_word, WORDS).view(np.int64) for t in texts])

    rows = docs.select(doc_key().alias("doc_key"), "text").join(bounded(where, n), "doc_key")
    return rows.select("node", items("text").alias("items"))


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, links): doc_id, doc_key, n_shingles, component_id, kept of each row of docs (doc_id, text); left, right of links between nodes.

    Rows of equal sets are one node; copies are never paired. Null and empty texts have no shingles and stand alone. A null id is no component id while
    another is to be had. Repeated rows share their component; each of them is `kept` if their id is the component's."""
    rows = keep(signed(docs), "near-signed")
    full = rows.where("node is not null")
    where = lambda wanted, n: full.join(bounded(wanted, n), "node", "left_semi").groupBy("node").agg(F.min("doc_key").alias("doc_key"))
    united, links = linked(tensored(full, "near"), lambda wanted, n: shingle_sets(docs, keep(where(wanted, n), "near-where"), n), PERCENT, "near")
    least = full.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    labelled = keep(least.join(united, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-labelled")
    ids = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = keep(labelled.join(ids, "component").select("node", "component_id"), "near-named")
    narrow = rows.select("doc_id", "doc_key", "n_shingles", "node")
    found = narrow.join(named, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("node"), links


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of all documents."""
    rows, _ = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the pipeline: one document of each component stays. Of rows that repeat an id and its text, one."""
    rows, _ = near_duplicates(docs.select("doc_id", "text"))
    rows = keep(rows.select("doc_key", "kept"), "near-verdicts")
    gone, n = counted(rows.where(~F.col("kept")).select("doc_key").distinct(), "near-gone")
    repeats = rows.where("kept").groupBy("doc_key").count().where("count > 1").limit(1).count()
    name = fresh(docs, "near_key")
    left = docs.withColumn(name, doc_key()).join(bounded(gone.withColumnRenamed("doc_key", name), n), name, "left_anti")
    return (left.dropDuplicates([name]) if repeats else left).select(*docs.columns)


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.a = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""
