"""Whole methods over the driver's tables: benchmark items as questions, documents as passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import methods

from .registry import query, table


def run(spark, sf_dir, method):
    kinds = F.array(*[F.lit(x) for x in ("yesno", "factoid", "summary")])
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.element_at(kinds, (F.col("item_id") % 3 + 1).cast("int")).alias("question_type"), F.array("text").alias("context"), F.lit(0.5).alias("confidence"))
    return methods.run(items, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), method).select("query_id", "question_type", "predicted", "escalated")


for _name in ("no-context", "golden-context", "dense", "dual-dense", "rankrag", "v14-cascade-dual-rerank-grounded", "pipeline"):
    query(f"method_{_name.replace('-', '_').replace('.', '_')}")(lambda spark, sf_dir, m=_name: run(spark, sf_dir, m))
