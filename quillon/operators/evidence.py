"""Evidence as text, traces of questions, and searches that go on from what they found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import parsing as P
from quillon.functions import text as T


def blocks(rows: DataFrame, block: Column, by: str = "query_id", order: str = "rank", most: int | None = None, between: str = "\n\n", head: str = "") -> DataFrame:
    """by, evidence: the blocks of a query's first rows, in order, joined; null blocks are passed over."""
    kept = rows if most is None else rows.where(F.col(order) <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), block.alias("block")))), lambda x: x["block"])
    joined = F.array_join(F.filter(listed, lambda b: b.isNotNull()), between)
    return kept.groupBy(by).agg(F.concat(F.lit(head), joined).alias("evidence"))


def article_block(place: Column, article: Column, title: Column, abstract: Column, most: int = 1200) -> Column:
    cut = F.substring(F.coalesce(abstract, F.lit("")), 1, most)
    return F.concat(F.lit("["), place.cast("string"), F.lit("] PMID "), article.cast("string"), F.lit("\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\nAbstract: "), cut)


def section_block(place: Column, article: Column, role: Column, title: Column, stage: Column, text: Column) -> Column:
    """A header line with role, title if there is one, and stage, then the text; null without text."""
    or_ = lambda c, default: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default))
    named = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(" | title:"), title)).otherwise("")
    header = F.concat(F.lit("[Chunk "), place.cast("string"), F.lit(" | PMID:"), or_(article, "unknown"), F.lit(" | role:"), or_(role, "other"), named, F.lit(" | stage:"), or_(stage, "seed"), F.lit("]\n"))
    body = P.strip(text)
    return F.when(body != "", F.concat(header, body))


def token_truncated(rows: DataFrame, budget: int, useful: int = 50, by: str = "query_id", order: str = "rank") -> DataFrame:
    """Rows (.., text, cost) in order while their costs fit; the first that doesn't is cut to what is left, four characters a token, if that is more than `useful`."""
    before = F.coalesce(F.sum("cost").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - F.col("before")
    marked = rows.withColumn("before", before).withColumn("fits", F.col("before") + F.col("cost") <= budget)
    kept = marked.where((F.col("before") <= budget) & (F.col("fits") | (left > useful)))
    return kept.withColumn("text", F.when(F.col("fits"), F.col("text")).otherwise(F.substring(F.col("text"), F.lit(1), (4 * left).cast("int")))).drop("before")


def hard_cases(traces: DataFrame, below: float = 0.5) -> DataFrame:
    return traces.where(F.col("score") < below)


def timed_out(traces: DataFrame) -> DataFrame:
    """Traces that used all iterations they had."""
    return traces.where(F.col("iterations") >= F.col("max_iterations"))


def subtask_scores(results: DataFrame, by: list[str]) -> DataFrame:
    """by, total, correct, score: the accuracy of yesno and mcq, the mean F1 of list, mcq_multi and expression, the mean ROUGE-L of summary and factoid, over items that have it."""
    kind = F.col("question_type")
    per_item = F.when(kind.isin("yesno", "mcq"), F.col("correct").cast("double")).when(kind.isin("list", "mcq_multi", "expression"), F.col("f1")).when(kind.isin("summary", "factoid"), F.col("rouge_l"))
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("correct").cast("long")).alias("correct"), F.round(F.coalesce(F.avg(per_item), F.lit(0.0)), 6).alias("score"))


def distinct_sets(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """The sorted distinct values of columns, by key."""
    return rows.groupBy(by).agg(*[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in columns])


def extraction_stats(cache: DataFrame) -> DataFrame:
    """Entries by status, and the entities and relations of those that succeeded. cache: status, entities, relations (arrays)."""
    ok = F.col("status") == "success"
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    size = lambda c: F.sum(F.when(ok, F.size(c)).otherwise(0)).alias(f"total_{c}")
    return cache.agg(F.count(F.lit(1)).alias("total_documents"), *map(count, ("success", "error", "empty")), *map(size, ("entities", "relations")))


def searched_again(search: Callable[[DataFrame], DataFrame], questions: DataFrame, rounds: int = 2, per_round: int = 20, top: int = 5, terms: int = 5) -> DataFrame:
    """query_id, id, round: what rounds of search found first, each round asking the question with capitalised phrases of the texts found before.

    search: from questions (query_id, question) to hits (query_id, id, rank, text). Phrases are taken in order of text, so that reruns agree."""
    asked, out = questions, None
    for k in range(rounds):
        hits = search(asked).where(F.col("rank") <= per_round)
        found = hits.select("query_id", "id", F.lit(k).alias("round"))
        out = found if out is None else out.unionByName(found)
        if k + 1 < rounds:
            texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, 500).alias("text")))), lambda x: x["text"])
            phrases = hits.where(F.col("rank") <= top).groupBy("query_id").agg(F.slice(F.array_sort(T.capitalised_phrases(F.array_join(texts, " "))), 1, terms).alias("phrases"))
            asked = questions.join(phrases, "query_id", "left").select("query_id", F.concat_ws(" ", F.col("question"), F.array_join(F.coalesce("phrases", F.array().cast("array<string>")), " ")).alias("question"))
    return out.groupBy("query_id", "id").agg(F.min("round").alias("round"))
