"""Retrieval: exact dense top-k, vocabulary matching, keywords, fusion, pools, reranking.

Runs of retrieval are rows (query_id, path, id, rank, score). A stated set of queries is sent to the executors, which keep the
best k of each batch, so that only k rows a query and batch are shuffled, however large the collection is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vectors as V

from .sizes import sent

#: Queries that are sent at a time.
QUERY_BLOCK = 2000


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The stated queries (query_id, vector), QUERY_BLOCK at a time: the driver holds one block."""
    block: list[tuple[int, np.ndarray]] = []
    for r in queries.select("query_id", "vector").where("vector is not null").toLocalIterator():
        block.append((r[0], np.asarray(r[1], float)))
        if len(block) == QUERY_BLOCK:
            yield block
            block = []
    if block:
        yield block


def _asked(collection: DataFrame, queries: DataFrame, run: Callable, id_col: str, vector: str) -> DataFrame:
    source = collection.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    out = None
    for block in _blocks(queries):
        part = source.mapInPandas(run(block), "query_id long, id long, score double")
        out = part if out is None else out.unionAll(part)
    return out if out is not None else source.where(F.lit(False)).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"))


def dense_topk(collection: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vector: str = "vector", decimals: int = 6) -> DataFrame:
    """query_id, id, rank, score: the k vectors of highest cosine for each query (query_id, vector), ties by id.

    Exact. Filters on the collection reach its scan. Null, empty, zero vectors, and those of another length than the query's score 0. Null query vectors have no result."""
    return ranked(_asked(collection, queries, lambda block: _best(block, k, decimals), id_col, vector), k)


def dense_above(collection: DataFrame, queries: DataFrame, least: float, *, id_col: str = "id", vector: str = "vector", decimals: int = 6) -> DataFrame:
    """query_id, id, score of all pairs whose cosine reaches `least`: a filter, without a rank."""
    return _asked(collection, queries, lambda block: _best(block, None, decimals, least), id_col, vector)


def _best(asked: list[tuple[int, np.ndarray]], k: int | None, decimals: int, least: float | None = None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            ids = batch["id"].to_numpy()
            lengths = np.array([0 if v is None else len(v) for v in batch["vector"]])
            by_length = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths)}
            stacked = {n: np.array([*batch["vector"].iloc[rows]], float) for n, rows in by_length.items() if n}
            norms = {n: np.sqrt((m * m).sum(axis=1)) for n, m in stacked.items()}
            for query, v in asked:
                score = np.zeros(len(ids))
                if len(v) in stacked and (size := float(np.sqrt(v @ v))):
                    m, norm = stacked[len(v)], norms[len(v)]
                    score[by_length[len(v)]] = np.divide(m @ v, norm * size, out=np.zeros(len(m)), where=norm > 0)
                score = np.round(score, decimals) + 0.0
                best = np.lexsort((ids, -score))[:k] if least is None else np.flatnonzero(score >= least)
                found.append(pd.DataFrame({"query_id": query, "id": ids[best], "score": score[best]}))
            if found:
                yield pd.concat(found)

    return run


def ranked(scored: DataFrame, k: int | None = None, by: str = "query_id") -> DataFrame:
    """Rows with rank 1, 2, ... by score, then id, within each query; the first k."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), "id")))
    return (out if k is None else out.where(F.col("rank") <= k)).select(by, "id", "rank", "score")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that should be total."""
    name = "_place"
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) == 1).drop(name)


def fuse(paths: DataFrame, k: int = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, path, id, rank, score): the sum of 1 / (k + rank). A query with one path keeps that path's scores."""
    n_paths = F.size(F.collect_set("path").over(Window.partitionBy("query_id")))
    marked = paths.withColumn("paths", n_paths)
    fused = marked.groupBy("query_id", "id").agg(F.round(F.when(F.max("paths") == 1, F.max("score")).otherwise(F.sum(1 / (k + F.col("rank")))), 9).alias("score"))
    return ranked(fused, limit)


def vocabulary_matches(hits: DataFrame, least: float = 0.75, most: int | None = None) -> DataFrame:
    """query_id, id, score: of (query_id, term, id, score), in order of terms and scores, the first hit of each id that reaches `least`."""
    kept = first_by(hits.where(F.col("score") >= least), ["query_id", "id"], F.col("term"), F.col("score").desc())
    return ranked(kept, most)


def broad_terms(headings: DataFrame, most: int) -> DataFrame:
    """term of headings (id, term) with more than `most` distinct ids."""
    return headings.groupBy("term").agg(F.count_distinct("id").alias("n")).where(F.col("n") > most).select("term")


def heading_rank(headings: DataFrame, wanted: DataFrame, limit: int, broad_above: int | None = None) -> DataFrame:
    """id, matches, rank: ids by the number of distinct wanted terms (term) that they have; ties by the id as text, descending.

    Terms with more than broad_above ids are passed over."""
    use = headings.join(sent(wanted.select("term").distinct()), "term")  # a query's terms
    if broad_above is not None:
        use = use.join(broad_terms(use, broad_above), "term", "left_anti")
    counted = use.groupBy("id").agg(F.count_distinct("term").alias("matches"))
    top = counted.orderBy(F.col("matches").desc(), F.col("id").cast("string").desc()).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("matches").desc(), F.col("id").cast("string").desc())))


def heading_weights(headings: DataFrame, weighted: DataFrame, limit: int) -> DataFrame:
    """id, score, matches: the sum of 1 / (1 + hop) over the distinct terms (term, hop) that an id has."""
    nearest = weighted.groupBy("term").agg(F.min("hop").alias("hop"))
    found = headings.select("id", "term").distinct().join(sent(nearest), "term")  # a query's terms
    out = found.groupBy("id").agg(F.round(F.sum(1 / (1 + F.col("hop"))), 6).alias("score"), F.count(F.lit(1)).alias("matches"))
    return out.orderBy(F.col("score").desc(), F.col("matches").desc(), F.col("id").cast("string").desc()).limit(limit)


def has_keyword(column: Column, keyword: str) -> Column:
    """Whether the words of a keyword stand in a text next to each other, in any case; never for a keyword without letters and digits."""
    wanted = " ".join(re.findall("[a-z0-9]+", keyword.lower()))
    return F.contains(F.concat(F.lit(" "), T.alnum(column), F.lit(" ")), F.lit(f" {wanted} ")) if wanted else F.lit(False)


def keyword_filter(docs: DataFrame, keywords: list[str], *, all_of: bool = False, column: str = "text") -> DataFrame:
    """docs with any, or all, of the keywords. Without a keyword, none."""
    tests = [has_keyword(F.col(column), k) for k in keywords]
    if not tests:
        return docs.where(F.lit(False))
    wanted = tests[0]
    for t in tests[1:]:
        wanted = wanted & t if all_of else wanted | t
    return docs.where(wanted)


def substring_filter(docs: DataFrame, keywords: list[str], columns: list[str], most: int = 3) -> DataFrame:
    """docs where one of the first keywords stands in one of the columns, in any case."""
    wanted = F.lit(False)
    for k in keywords[:most]:
        for c in columns:
            wanted |= F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(k.lower()))
    return docs.where(wanted)


def rank_score(ids: DataFrame, by: str = "query_id", order: str = "rank") -> DataFrame:
    """score 1 - i / n of the i-th of n rows, from 0."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    return ids.withColumn("score", F.round(1 - (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / n, 9))


def filter_ids(mode: str, vocabulary: DataFrame, keyword: DataFrame) -> DataFrame | None:
    """The ids that a filter mode leaves: none for NONE (no filter), MESH, KEYWORD, OR (union), AND (intersection)."""
    v, k = vocabulary.select("id"), keyword.select("id")
    return {"NONE": None, "MESH": v.distinct(), "KEYWORD": k.distinct(), "OR": v.union(k).distinct(), "AND": v.intersect(k)}[mode]


def merge_best(pools: DataFrame, limit: int | None = None) -> DataFrame:
    """Pools (query_id, pool, id, score) as one: of equal ids the higher score, on ties the earlier pool; by score."""
    return ranked(first_by(pools, ["query_id", "id"], F.col("score").desc(), F.col("pool")), limit)


def merge_first(pools: DataFrame, limit: int | None = None) -> DataFrame:
    """Pools as one: of equal ids the one of the earlier pool; in order of pool and rank."""
    kept = first_by(pools, ["query_id", "id"], F.col("pool"), F.col("rank"))
    out = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pool", F.col("rank"), "id")))
    return (out if limit is None else out.where(F.col("rank") <= limit)).select("query_id", "id", "rank", "score", "pool")


def round_robin(pools: DataFrame, limit: int) -> DataFrame:
    """Pools in turn: first the first of each pool, then the second, ...; an id counts where it comes first."""
    turn = pools.withColumn("turn", F.struct("rank", "pool"))
    kept = first_by(turn, ["query_id", "id"], F.col("turn"))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("turn"))).where(F.col("place") <= limit).select("query_id", "id", "place", "pool")


def inject_gold(ranking: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Gold ids (query_id, id) first, by id, then the ranking's others until k are filled."""
    first = gold.select("query_id", "id").distinct().withColumn("kind", F.lit(0)).withColumn("rank", F.lit(0))
    rest = ranking.join(gold.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(1).alias("kind"), "rank")
    both = first.unionByName(rest).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("kind", "rank", "id")))
    return both.where(F.col("place") <= k).select("query_id", "id", "place", (F.col("kind") == 0).alias("gold"))


def gold_ranks(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """For each query of gold, the rank of its first gold id, -1 if none is ranked."""
    hits = ranking.join(gold.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("gold_rank"))
    return gold.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.coalesce("gold_rank", F.lit(-1)).cast("long").alias("gold_rank"))


def recall_at(ranks: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """R@k for each k of gold ranks, and how many gold ids are ranked at all."""
    at = lambda k: F.round(F.avg(((F.col("gold_rank") >= 1) & (F.col("gold_rank") <= k)).cast("double")), 6).alias(f"recall_{k}")
    return ranks.agg(F.count(F.lit(1)).alias("n_queries"), *[at(k) for k in ks], F.round(F.avg((F.col("gold_rank") >= 1).cast("double")), 6).alias("ceiling"))


def hydrate(ranking: DataFrame, documents: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """The ranking with columns of documents. Ids without a document are gone; the ranks of the others stay as they are."""
    return ranking.join(documents.select(key, *columns), key)


def tiered(ranking: DataFrame, k: int, text: str = "text", title: str = "title") -> DataFrame:
    """Rows with a text first, by score and rank, then those with a title only, which stands for it; ranked anew to k."""
    tier = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", 0).when(F.trim(F.coalesce(F.col(title), F.lit(""))) != "", 1)
    out = ranking.withColumn("tier", tier).where("tier is not null").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", F.col("score").desc(), "rank")))
    return out.where(F.col("place") <= k)


def lexical_rerank(ranking: DataFrame, terms: list[str], column: str = "text", weight: float = 10.0) -> DataFrame:
    """By weight * (query terms in the text) + score."""
    overlap = sum((has_keyword(F.col(column), w).cast("int") for w in terms), F.lit(0))
    return ranking.withColumn("overlap", overlap).withColumn("score", F.round(weight * F.col("overlap") + F.col("score"), 6))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with place 0, 1, ... in order of a column of distinct values, by ranges: rows are sorted in parts, and only the parts' counts meet in one task."""
    part = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    part = part.sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    counts = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return part.join(sent(before), "_part").withColumn("place", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")  # a row a partition


def widen(ranking: DataFrame, usable: Column, k: int, limits: tuple[int, ...]) -> DataFrame:
    """The first k usable rows of each query within the least of the limits that has k of them, else within the last."""
    marked = ranking.withColumn("usable", usable)
    per = Window.partitionBy("query_id")
    enough = [F.sum(F.when(F.col("usable") & (F.col("rank") <= n), 1).otherwise(0)).over(per) >= k for n in limits]
    bound = F.lit(limits[-1])
    for n, ok in reversed(list(zip(limits, enough, strict=True))[:-1]):
        bound = F.when(ok, n).otherwise(bound)
    out = marked.withColumn("bound", bound).where(F.col("usable") & (F.col("rank") <= F.col("bound")))
    return out.withColumn("place", F.row_number().over(per.orderBy("rank"))).where(F.col("place") <= k)


@dataclass(frozen=True)
class Strategy:
    """Which paths a preset takes, and how it goes on."""

    dense: bool = False
    mesh: bool = False
    keyword: bool = False
    vector_within: bool = False  # rank filter ids by vector
    rerank: bool = False


#: The fourteen presets: A by filters only, B by filters and vectors, C by vectors only; each without and with reranking.
STRATEGIES = {
    "A1": Strategy(mesh=True), "A2": Strategy(mesh=True, rerank=True), "A3": Strategy(keyword=True), "A4": Strategy(keyword=True, rerank=True),
    "A5": Strategy(mesh=True, keyword=True), "A6": Strategy(mesh=True, keyword=True, rerank=True),
    "B1": Strategy(mesh=True, vector_within=True), "B2": Strategy(mesh=True, vector_within=True, rerank=True), "B3": Strategy(keyword=True, vector_within=True),
    "B4": Strategy(keyword=True, vector_within=True, rerank=True), "B5": Strategy(mesh=True, keyword=True, vector_within=True), "B6": Strategy(mesh=True, keyword=True, vector_within=True, rerank=True),
    "C1": Strategy(dense=True), "C2": Strategy(dense=True, rerank=True),
}


def hybrid(strategy: Strategy, collection: DataFrame, queries: DataFrame, mesh_ids: DataFrame, keyword_ids: DataFrame, *, each: int = 100, fused: int = 200, k: int = 50) -> DataFrame:
    """A preset over a collection (id, vector): its paths of `each` rows, fused, cut to `fused`, reranked by vector if it says so, cut to k."""
    paths = []

    def path(name: str, ids: DataFrame) -> None:
        if strategy.vector_within:
            run = dense_topk(collection.join(ids.select("id").distinct(), "id", "left_semi"), queries, each)
        else:
            first = ids.select("id").distinct().orderBy("id").limit(each)  # the same ids for every query
            place, n = F.row_number().over(Window.orderBy("id")), F.count(F.lit(1)).over(Window.partitionBy())
            scored = first.select("id", place.alias("rank"), F.round(1 - (place - 1) / n, 9).alias("score"))
            run = queries.select("query_id").join(sent(scored))  # at most `each` rows
        paths.append(run.select("query_id", F.lit(name).alias("path"), "id", "rank", "score"))

    if strategy.mesh:
        path("mesh", mesh_ids)
    if strategy.keyword:
        path("keyword", keyword_ids)
    if strategy.dense:
        paths.append(dense_topk(collection, queries, each).select("query_id", F.lit("dense").alias("path"), "id", "rank", "score"))
    union = paths[0]
    for p in paths[1:]:
        union = union.unionByName(p)
    out = fuse(union, limit=fused)
    if strategy.rerank:  # just the pairs that were found
        pairs = out.select("query_id", "id").join(queries.select("query_id", F.col("vector").alias("_asked")), "query_id").join(collection.select("id", "vector"), "id")
        out = ranked(pairs.select("query_id", "id", F.round(V.cosine(F.col("vector"), F.col("_asked")), 6).alias("score")), k)
    return out.where(F.col("rank") <= k)
