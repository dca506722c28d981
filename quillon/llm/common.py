"""What the operators of this subpackage share: reading, kept tables, splits and samples."""

from __future__ import annotations

import atexit
import gc
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as a class for Java and Python patterns.
WORD = r"[^\x20\x09-\x0D]+"

_local: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset (tests on a local master) a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _local:
            _local["dir"] = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        found = _local["dir"]
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back. That cuts the lineage: the rows outlive any executor and are computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def discard(*frames: DataFrame) -> None:
    """Deletes kept tables that nothing reads any more; other frames are passed over."""
    for df in frames:
        path = df.__dict__.get("_kept_at")
        if path in _written:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done: it does so when the driver collects its garbage, which a driver with room to spare puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget() -> None:
    """Deletes all kept tables, at exit."""
    while _written:
        path, spark = _written.popitem()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: nothing to delete with
            return


atexit.register(forget)


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def held_out(modulus: int, remainder: int, col: str = "doc_id") -> Column:
    return id_crc(col) % modulus == remainder


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int, modulus: int, remainder: int, seed: str) -> DataFrame:
    """draw, doc_id, text, label of at most `most` documents outside the held-out fold.

    The ids are drawn from the labels by md5, a sample that any size of input gives alike. Repeated labels of an id count as the larger, repeated texts of an
    id as the largest; null ids, labels and texts are left out."""
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(modulus, remainder))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .withColumn("draw", F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string"))))
        .orderBy("draw", "doc_id").limit(most)
    )
    return (
        docs.select("doc_id", "text").where(F.col("text").isNotNull())
        .join(F.broadcast(ids), "doc_id")  # at most `most` ids
        .groupBy("doc_id", "draw").agg(F.max("text").alias("text"), F.max("label").alias("label"))
        .select("draw", "doc_id", "text", "label")
    )


def fitted(rows: DataFrame, fit: Callable[[Iterator[tuple[str, int]]], Any]) -> Any:
    """What fit makes of the (text, label) of labelled_texts, in order of draw and doc_id. It runs in a task of an executor, which reads these bounded rows: no text comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        found.sort(key=lambda r: r[:2])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[2:] for r in found]))], pa.binary())], names=["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else fit([])


class Bounded(dict):
    """What `make` gives for a key, kept for at most `most` keys of at most `longest` characters."""

    def __init__(self, make, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
