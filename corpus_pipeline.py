"""The corpus pipeline: documents through the stages below, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, linededup, mixing, neardup, quality
from quillon.llm.common import keep, table

#: Name and function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents.
STAGES = [
    ("quality", quality.keep_good),
    ("line_dedup", linededup.drop_lines),
    ("near_dedup", neardup.keep_one),
    ("decontamination", decontaminate.drop_contaminated),
    ("mixing", mixing.mixed),
]

#: A trained model decides the first stage, which SQL can't express; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
