"""Mixing sources to target weights: weighted fair queueing, in DataFrame operations only.

Each source deals its documents in a shuffled order (md5 of the id), up to MOST_EPOCHS times over. A copy's virtual finish time
is the words its source has dealt so far, itself included, divided by the source's target; the mix is the prefix of all copies
in order of finish time that fits the total budget.

No running total is taken in one task. Rows fall into buckets of the shuffle order, or of finish time, whose sums are summed up
in two levels; only rows of one bucket are ordered together, and the number of buckets follows the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, keep, table

#: Fixed values of the contract: the weights that sources get in turn, and the most often a document is taken.
WEIGHTS, MOST_EPOCHS = (5, 2, 1), 3
#: Rows that a bucket has about, and sources up to which their table is broadcast.
BUCKET_ROWS, BROADCAST_SOURCES = 4096, 50_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def before(sums: DataFrame, group: list[str], bucket: str, bits: int, value: str) -> DataFrame:
    """From one row for each group and bucket: what all earlier buckets of the group hold, as `before`."""
    low = bits // 2
    fine = sums.withColumn("_hi", F.shiftright(F.col(bucket), low))
    so_far = lambda over: F.coalesce(F.sum(value).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = fine.groupBy(*group, "_hi").agg(F.sum(value).alias(value)).withColumn("_far", so_far(Window.partitionBy(*group).orderBy("_hi"))).drop(value)
    near = fine.withColumn("_near", so_far(Window.partitionBy(*group, "_hi").orderBy(bucket)))
    return near.join(coarse, [*group, "_hi"]).select(*group, bucket, (F.col("_near") + F.col("_far")).alias("before"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, rank, source_size, target: one row a source, so that windows over all of them are small.

    Targets share the sum of all sizes by weight, at most MOST_EPOCHS times a source's size. In order of cap over weight, the sources that stop
    at their cap come first, so the first source that needn't stop gives the rate of all later ones."""
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(weights, ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")))
        .withColumn("cap", MOST_EPOCHS * F.col("source_size"))
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    rate = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    fits = ranked.withColumn("rate", rate).withColumn("fits", F.col("rate") * F.col("weight") <= F.col("cap"))
    first = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "rank", "rate"))).over(Window.partitionBy())
    found = fits.withColumn("first", first)
    stops = F.struct(F.col("cap") / F.col("weight"), "rank") < F.struct(F.col("first.col1"), F.col("first.rank"))
    return found.select("source", "rank", "source_size", F.when(stops, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("first.rate")).alias("target"))


@dataclass
class Mix:
    sources: DataFrame  # source, rank, source_size, target
    n_sources: int
    rows: DataFrame  # doc_id, size, rank, source_size, target, draw, dealt, copies: one row for each document


def draw(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix(docs: DataFrame, seed: str = "mix") -> Mix:
    """How often the mix takes each row of docs (doc_id, text, source).

    Null texts have size 0, null sources are one source, null ids count as the empty text in the draw. Repeated rows take their turns one after
    the other. Empty docs give an empty mix."""
    sizes = keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("draw", draw(seed)), "mix-sizes")
    sources = keep(source_targets(sizes), "mix-sources")
    n_sources, n, total = sources.count(), sizes.count(), sources.agg(F.sum("source_size")).first()[0] or 0
    bits = max(2, min(40, math.ceil(math.log2(max(1, n) / BUCKET_ROWS + 1))))

    rows = (
        sizes.join(small(sources, n_sources), sizes["source"].eqNullSafe(sources["source"]))
        .select("doc_id", "size", "draw", "rank", "source_size", "target")
        .withColumn("bucket", F.shiftright(F.conv(F.substring("draw", 1, 10), 16, 10).cast("long"), 40 - bits))
    )
    offsets = before(rows.groupBy("rank", "bucket").agg(F.sum("size").alias("size")), ["rank"], "bucket", bits, "size")
    inside = F.sum("size").over(Window.partitionBy("rank", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    dealt = keep(rows.withColumn("inside", inside).join(offsets, ["rank", "bucket"]).withColumn("dealt", F.col("before") + F.col("inside")).drop("bucket", "inside", "before"), "mix-dealt")

    finish = lambda epoch: F.when(F.col("target") > 0, (epoch * F.col("source_size") + F.col("dealt")) / F.col("target")).otherwise(F.lit(0.0))
    copies = dealt.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1)))).withColumn("finish", finish(F.col("epoch")))
    # Equal steps of finish time hold about equal numbers of words up to 1, where the budget ends; what lies beyond is squeezed into as many steps again.
    slot = F.floor(F.when(F.col("finish") < 1, F.col("finish")).otherwise(2 - 1 / F.col("finish")) * (1 << bits)).cast("long")
    slots = copies.withColumn("slot", slot)
    so_far = before(filled := slots.groupBy("slot").agg(F.sum("size").alias("size")), [], "slot", bits + 1, "size")
    crossing = filled.join(so_far, "slot").where(F.col("before") + F.col("size") > total).orderBy("slot").limit(1).first()
    if crossing is None:
        taken = F.lit(MOST_EPOCHS)
    else:
        key = lambda finish: F.struct(finish, F.col("rank"), F.col("draw"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        order = Window.orderBy("key")
        last = (
            slots.where(F.col("slot") == crossing["slot"]).withColumn("key", key(F.col("finish")))
            .withColumn("total", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))  # of one slot only
            .where(F.col("total") + crossing["before"] <= total).agg(F.max("key").alias("key")).first()["key"]
        )
        if last is None:  # the slot's first copy does not fit
            within = lambda epoch: F.floor(F.when(finish(epoch) < 1, finish(epoch)).otherwise(2 - 1 / finish(epoch)) * (1 << bits)) < crossing["slot"]
        else:
            limit = F.struct(*[F.lit(x) for x in last])
            within = lambda epoch: key(finish(epoch)) <= limit
        taken = sum((within(F.lit(e)).cast("int") for e in range(1, MOST_EPOCHS)), within(F.lit(0)).cast("int"))
    return Mix(sources, n_sources, dealt.withColumn("copies", taken))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents."""
    return mix(table(spark, sf_dir, "documents")).rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str, seed: str = "mix") -> DataFrame:
    """Last stage of the pipeline: the documents that the mix takes, with the number of copies.

    The texts are not shuffled: as a source deals in order of draw, its rows that are taken so often end at one draw, and these ends, MOST_EPOCHS a
    source, are all that is joined to the texts. Rows that share a draw, which only rows with the same id do, are taken as often as the one taken most."""
    m = mix(docs, seed)
    ends = m.rows.where(F.col("copies") > 0).groupBy("rank", "copies").agg(F.max("draw").alias("end"))
    ends = ends.groupBy("rank").agg(*[F.max(F.when(F.col("copies") >= c, F.col("end"))).alias(f"_end{c}") for c in range(1, MOST_EPOCHS + 1)])
    ends = keep(m.sources.join(ends, "rank").select(F.col("source").alias("_source"), *[f"_end{c}" for c in range(1, MOST_EPOCHS + 1)]), "mix-ends")
    at = fresh(docs, "mix_end")
    joined = docs.join(small(ends.select(F.struct("*").alias(at)), m.n_sources), docs["source"].eqNullSafe(F.col(f"{at}._source")))
    dealt = lambda c: F.coalesce(draw(seed) <= F.col(f"{at}._end{c}"), F.lit(False)).cast("int")
    copies = sum((dealt(c) for c in range(2, MOST_EPOCHS + 1)), dealt(1))
    name = fresh(docs, "copies")
    return joined.withColumn(name, copies).where(F.col(name) > 0).select(*docs.columns, name)


OP4_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents),
ranked AS (
  SELECT source, source_size, 3 * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source)),
rated AS (
  SELECT *, CAST((SELECT sum(size) FROM sizes) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate,
         row_number() OVER (ORDER BY cap / weight, rank) AS place
  FROM ranked),
level AS (SELECT min(place) AS place, arg_min(rate, place) AS rate FROM rated WHERE rate * weight <= cap),
sources AS (
  SELECT r.source, r.rank, r.source_size, CASE WHEN r.place < l.place THEN CAST(r.cap AS DOUBLE) ELSE r.weight * l.rate END AS target
  FROM rated r, level l),
dealt AS (
  SELECT z.doc_id, z.size, z.draw, s.rank, s.source_size, s.target,
         CAST(sum(z.size) OVER (PARTITION BY s.rank ORDER BY z.draw, z.doc_id, z.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS dealt
  FROM sizes z JOIN sources s ON z.source IS NOT DISTINCT FROM s.source),
copies AS (
  SELECT d.*, CASE WHEN target > 0 THEN CAST(e.epoch * source_size + dealt AS DOUBLE) / target ELSE 0 END AS finish
  FROM dealt d, (SELECT unnest([0, 1, 2]) AS epoch) e),
queue AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, draw, coalesce(CAST(doc_id AS VARCHAR), '') ROWS UNBOUNDED PRECEDING) AS total FROM copies)
SELECT doc_id, size, source_size, target, CAST(coalesce(sum(size) FILTER (WHERE total <= (SELECT sum(size) FROM sizes)), 0) AS BIGINT) AS taken
FROM queue GROUP BY doc_id, size, source_size, target, draw, dealt
"""
