"""JSON lines, CSV and Parquet sources and sinks. Schemas are always given: records of a log differ, so none is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "id string, dataset string, question string, question_type string, options map<string,string>, context array<string>, answer string, metadata string"
RECORD = "type string, item_id string, dataset string, subtask string, method string, predicted string, gold string, score double, latency_ms double, error string, timestamp string"
SIDECAR = "item_id string, score double"
PASSAGES = "id string, passages array<struct<offset:long,infons:map<string,string>,text:string>>"


def read_items(spark: SparkSession, *paths: str, types: tuple[str, ...] = ()) -> DataFrame:
    """One question a line, of these types if any are given. A line that is no record is an error."""
    items = spark.read.schema(ITEM).option("mode", "FAILFAST").json(list(paths))
    return items.where(F.col("question_type").isin(*types)) if types else items


def read_log(spark: SparkSession, *paths: str) -> DataFrame:
    """The item records of run logs, with `line`, their order within a file. Lines that are no records are passed over."""
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    parsed = lines.withColumn("r", F.from_json("value", RECORD, {"mode": "PERMISSIVE"}))
    return parsed.where(F.col("r.type") == "item").select("r.*", "file", "line")


def read_sidecar(spark: SparkSession, *paths: str) -> DataFrame:
    """item_id, score: the last score of each item."""
    lines = spark.read.text(list(paths)).select(F.from_json("value", SIDECAR).alias("r"), F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).alias("at"))
    return lines.where("r.item_id is not null").groupBy("r.item_id").agg(F.max_by("r.score", "at").alias("score"))


def datasets(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """The names whose file <root>/<name>.jsonl exists, in order. Asks the file system of the root, whichever it is."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(folder, f"{n}.jsonl")))


def latest_run(spark: SparkSession, pattern: str) -> str | None:
    """The newest of the files that a pattern finds."""
    files = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at")).distinct()
    found = files.orderBy(F.col("at").desc(), F.col("path").desc()).first()
    return found["path"] if found else None


def write_log(items: DataFrame, path: str, method: str) -> None:
    """Appends item records, between a start and an end record."""
    spark = items.sparkSession
    mark = lambda kind: spark.createDataFrame([(kind, method)], "type string, method string")
    mark("run_start").write.mode("append").json(path)
    items.withColumn("type", F.lit("item")).withColumn("method", F.lit(method)).write.mode("append").json(path)
    mark("run_end").write.mode("append").json(path)


def write_report(report: DataFrame, path: str, score: str = "score", latency: str | None = None) -> None:
    """CSV with a header, scores to 4 decimals, latencies to 1."""
    out = report.withColumn(score, F.format_string("%.4f", F.col(score)))
    if latency:
        out = out.withColumn(latency, F.format_string("%.1f", F.col(latency)))
    out.write.mode("overwrite").option("header", True).csv(path)


def markdown(report: DataFrame) -> DataFrame:
    """line: a report's rows as lines of a table, after those of its header."""
    head = report.sparkSession.createDataFrame([("| " + " | ".join(report.columns) + " |",), ("|" + " --- |" * len(report.columns),)], "line string")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns]
    return head.unionAll(report.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")))


def patched(table: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """table with the other columns of patch where its keys match; an error if a row of patch doesn't match exactly one."""
    counts = patch.select(*keys).join(table.groupBy(*keys).count(), keys, "left").agg(F.min(F.coalesce("count", F.lit(0))).alias("low"), F.max(F.coalesce("count", F.lit(0))).alias("high")).first()
    if counts["low"] is not None and (counts["low"], counts["high"]) != (1, 1):
        raise ValueError(f"rows of the patch match {counts['low']} to {counts['high']} rows each")
    new = [c for c in patch.columns if c not in keys]
    joined = table.join(patch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new], F.lit(True).alias("_hit")), keys, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


def absent(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows of new that an insert would add: those whose key isn't known yet, one a key."""
    return new.join(known.select(key), key, "left_anti").dropDuplicates([key])


def store_cache(rows: DataFrame, path: str, partitions: list[str]) -> None:
    """Appends cached results, in folders by strategy and dataset or the like."""
    rows.withColumn("stored_at", F.current_timestamp()).write.mode("append").partitionBy(*partitions).parquet(path)


def load_cache(spark: SparkSession, path: str, keys: list[str], most: int | None = None) -> DataFrame:
    """The last entry of each key, and of its list of ids the first `most`."""
    cached = spark.read.parquet(path)
    rest = [c for c in cached.columns if c not in keys]
    out = cached.groupBy(*keys).agg(F.max_by(F.struct(*rest), "stored_at").alias("r")).select(*keys, "r.*")
    return out.withColumn("ids", F.slice("ids", 1, most)) if most and "ids" in out.columns else out


def cache_stats(cached: DataFrame, by: list[str]) -> DataFrame:
    return cached.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"), F.count(F.when(F.size("gold") > 0, 1)).alias("with_gold"), F.round(F.avg(F.size("gold")), 6).alias("gold_mean"))


def split_cached(asked: DataFrame, cached: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Those of asked that are cached, and those that aren't."""
    known = cached.select(*keys).distinct()
    return asked.join(known, keys, "left_semi"), asked.join(known, keys, "left_anti")


def checksums(files: DataFrame, expected: DataFrame) -> DataFrame:
    """path, ok: of binary files (path, content) against path, sha256."""
    return files.select("path", F.sha2("content", 256).alias("found")).join(expected, "path", "full").select("path", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("ok"))


def converted(rows: DataFrame, names: dict[str, str], answer: Column, valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, audit): rows under the names of ITEM with their answer; how many were kept and skipped."""
    marked = rows.withColumn("_ok", F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)).withColumn("_answer", answer)
    items = marked.where("_ok").select(*[F.col(old).alias(new) for old, new in names.items()], F.col("_answer").alias("answer"))
    return items, marked.agg(F.count(F.when(F.col("_ok"), 1)).alias("kept"), F.count(F.when(~F.col("_ok"), 1)).alias("skipped"))


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """paper_id, place, kind, text of sectioned full texts: a passage a row, in order."""
    docs = spark.read.schema(PASSAGES).option("multiLine", True).json(path)
    each = docs.select(F.col("id").alias("paper_id"), F.posexplode("passages").alias("place", "p"))
    return each.select("paper_id", "place", F.coalesce(F.try_element_at("p.infons", F.lit("type")), F.lit("paragraph")).alias("kind"), F.col("p.text").alias("text"))
