"""Sinks that a restarted stream may write to again, and a state with a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Appends the rows of each batch whose key isn't in the table at path yet. A batch that is tried again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EVIDENCE = "query_id long, used long, taken long, rounds int, status string"


def evidence(stream: DataFrame, budget: int, enough: int, most_rounds: int = 5) -> DataFrame:
    """query_id, used, taken, rounds, status of a stream of snippets (query_id, cost): each query takes snippets within its budget, round by round, until it
    has enough of them (enough), or its rounds or its budget are at an end (exhausted)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, taken, rounds, status = state.get if state.exists else (0, 0, 0, "searching")
        if status == "searching":
            rounds += 1
            for batch in batches:
                for cost in batch["cost"].sort_values():
                    if taken < enough and used + cost <= budget:
                        used, taken = used + int(cost), taken + 1
            status = "enough" if taken >= enough else "exhausted" if rounds >= most_rounds or used >= budget else "searching"
            state.update((used, taken, rounds, status))
        yield pd.DataFrame({"query_id": [key[0]], "used": [used], "taken": [taken], "rounds": [rounds], "status": [status]})

    return stream.groupBy("query_id").applyInPandasWithState(step, EVIDENCE, "used long, taken long, rounds int, status string", "update", "NoTimeout")


def latest(stream: DataFrame, key: str, time: str) -> DataFrame:
    """The newest record of each key."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), time).alias("r")).select(key, "r.*")
