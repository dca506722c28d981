"""Evidence packing: which of a query's passages, in order, fit a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_budget(units: DataFrame, budget: int, *, by: str = "query_id", order: str = "rank", cost: str = "cost") -> DataFrame:
    """The longest prefix of each query's units whose costs sum to the budget at most."""
    total = F.sum(cost).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return units.withColumn("total", total).where(F.col("total") <= budget)


def largest_prefix(units: DataFrame, budget: int, *, by: str = "query_id", order: str = "rank", cost: str = "cost") -> DataFrame:
    """As prefix_budget, but where not even the first unit fits, that unit cut down to the budget."""
    per = Window.partitionBy(by).orderBy(order)
    out = units.withColumn("place", F.row_number().over(per)).withColumn("total", F.sum(cost).over(per.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("total") <= budget) | (F.col("place") == 1)).withColumn("cost", F.least(F.col(cost), F.lit(budget)))


def per_key_cap(units: DataFrame, key: str, most: int, *, by: str = "query_id", order: str = "rank") -> DataFrame:
    """At most `most` units of each key, the first ones."""
    return units.withColumn("_nth", F.row_number().over(Window.partitionBy(by, key).orderBy(order))).where(F.col("_nth") <= most).drop("_nth")


def greedy_pack(units: DataFrame, budget: int, *, cap: int = 2, overhead: int = 18, by: str = "query_id") -> DataFrame:
    """Units (query_id, unit_id, paper_id, rank, cost) taken one by one: one that doesn't fit, or whose paper has `cap` units already, is passed over and
    later ones may still come; a first unit over the budget is taken and ends it. A unit costs its estimate and an overhead.

    A fold over one query's ranked units, which retrieval bounds; the queries are spread over the cluster."""
    listed = units.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "unit_id", "paper_id", (F.col("cost") + overhead).cast("long").alias("cost")))).alias("units"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"), F.array().cast("array<bigint>").alias("papers"), F.lit(False).alias("over"))

    def step(state, unit):
        seen = F.size(F.filter(state["papers"], lambda p: p == unit["paper_id"]))
        first = F.size(state["taken"]) == 0
        too_large = first & (unit["cost"] > budget)
        take = ~state["over"] & (too_large | ((state["used"] + unit["cost"] <= budget) & (seen < cap)))
        add = lambda xs, x: F.when(take, F.concat(xs, F.array(x.cast("long")))).otherwise(xs)
        return F.struct(
            F.when(take, state["used"] + unit["cost"]).otherwise(state["used"]).alias("used"), add(state["taken"], unit["unit_id"]).alias("taken"),
            add(state["papers"], unit["paper_id"]).alias("papers"), (state["over"] | too_large).alias("over"),
        )

    packed = listed.select(by, F.aggregate("units", start, step).alias("s"))
    return packed.select(by, F.posexplode("s.taken").alias("place", "unit_id"), F.col("s.used").alias("used")).select(by, "unit_id", (F.col("place") + 1).alias("place"), "used")


def polarity_budgets(units: DataFrame, budget: int, question_type: str) -> DataFrame:
    """Units with their polarity's part of the budget: 46 % each of positive and negative for yes/no questions, all of it otherwise."""
    part = F.when(F.col("polarity").isin("positive", "negative"), F.floor(F.lit(budget) * 0.46)).otherwise(F.lit(budget) - 2 * F.floor(F.lit(budget) * 0.46))
    return units.withColumn("part", part if question_type == "yesno" else F.lit(budget))


def mixed_budget(units: DataFrame, budget: int, community_share: float = 0.25) -> DataFrame:
    """Units (query_id, kind, rank, cost) of communities within their share, entities and relations within half of the rest each."""
    community = int(budget * community_share)
    rest = (budget - community) // 2
    part = F.when(F.col("kind") == "community", community).otherwise(rest)
    total = F.sum("cost").over(Window.partitionBy("query_id", "kind").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return units.withColumn("total", total).where(F.col("total") <= part)


def assembled(units: DataFrame, *, by: str = "query_id", order: str = "rank", text: str = "text") -> DataFrame:
    """One text a query: its units' texts, numbered, between blank lines."""
    numbered = units.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    listed = numbered.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(text).alias("t")))).alias("units"))
    return listed.select(by, F.array_join(F.transform("units", lambda u: F.concat(F.lit("["), u["_n"].cast("string"), F.lit("] "), u["t"])), "\n\n").alias("context"))
