"""Run logs: latest and first records, merges, splices, roll-ups, coverage, latency, confidence."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import sent


def latest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Of each key the row of the greatest time, on ties the least `tie`. Aggregated map-side, so that a hot key stays small."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(time), (-F.col(tie)).alias("_tie"))
    found = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return found.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return found.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return found.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def overriding(base: DataFrame, over: DataFrame, keys: list[str], value: str) -> DataFrame:
    """base with the values of `over` where it has the key; rows of `over` alone don't come in."""
    new = over.select(*keys, F.col(value).alias("_over"), F.lit(True).alias("_has"))
    joined = base.join(new, keys, "left")
    return joined.withColumn("spliced", F.coalesce("_has", F.lit(False))).withColumn(value, F.when(F.col("spliced"), F.col("_over")).otherwise(F.col(value))).drop("_over", "_has")


def newer_over_older(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows of both, the new ones' where both have the key."""
    joined = old.select(*keys, F.col(value).alias("_old")).join(new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_has")), keys, "full")
    return joined.select(*keys, F.when(F.col("_has"), F.col("_new")).otherwise(F.col("_old")).alias(value), F.coalesce("_has", F.lit(False)).alias("from_new"))


def routed(base: DataFrame, other: DataFrame, routes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """base, with the value of `other` where routes (keys, route) says so and other has it."""
    joined = base.join(other.select(*keys, F.col(value).alias("_other")), keys, "left").join(routes.select(*keys, "route"), keys, "left")
    use = F.coalesce("route", F.lit(False)) & F.col("_other").isNotNull()
    return joined.select(*[c for c in base.columns if c != value], F.when(use, F.col("_other")).otherwise(F.col(value)).alias(value), use.alias("routed"))


def remaining(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def rollup(scores: DataFrame, levels: list[str], value: str = "score") -> DataFrame:
    """n, total (6 decimals) and mean at each level, from all levels down to the first, in one pass; an absent level is null."""
    sets = [levels[: k + 1] for k in range(len(levels))]
    return (
        scores.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in levels])
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total"), F.round(F.avg(value), 6).alias("mean"))
    )


def latency(df: DataFrame, by: list[str], millis: str) -> DataFrame:
    """Median, mean and 95th percentile (linear) in seconds of latencies above 0."""
    seconds = F.col(millis) / 1000
    return df.where(F.col(millis) > 0).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.percentile(seconds, 0.5), 6).alias("median_s"), F.round(F.avg(seconds), 6).alias("mean_s"), F.round(F.percentile(seconds, 0.95), 6).alias("p95_s"),
    )


def coverage(scores: DataFrame, totals: DataFrame, by: str) -> DataFrame:
    """n against the totals (by, total); where there is no total, n stands for it."""
    n = scores.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    out = n.join(sent(totals), by, "left").withColumn("total", F.coalesce("total", "n"))  # one row a dataset
    return out.withColumn("coverage", F.round(F.col("n") / F.col("total"), 6))


def drift(scores: DataFrame, sample: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """Of sample ids (by, key): expected, seen, mean value; OK, DRIFT (some missing) or NO_DATA (all)."""
    seen = sample.join(scores.select(*by, key, value), [*by, key], "left").groupBy(*by).agg(
        F.count_distinct(key).alias("expected"), F.count_distinct(F.when(F.col(value).isNotNull(), F.col(key))).alias("seen"), F.round(F.avg(value), 6).alias("mean"),
    )
    return seen.withColumn("status", F.when(F.col("seen") == 0, "NO_DATA").when(F.col("seen") < F.col("expected"), "DRIFT").otherwise("OK"))


def mean_with_empty_gold(scores: DataFrame, by: list[str], value: str, empty: Column) -> DataFrame:
    """The mean over all items, those without gold counting 1."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(empty, F.lit(1.0)).otherwise(F.col(value))), 6).alias("mean"))


def bootstrap(scores: DataFrame, by: str, value: str, key: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """mean, low, high: 95 % intervals of the mean from Poisson resampling.

    Each value counts a Poisson(1) number of times in each round, drawn from the seed and the row's key, so reruns agree however the rows are dealt out; sums are
    taken batch by batch and then added, so a group may be of any size."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for group, part in batch.groupby(by, dropna=False):
                for at in range(0, len(part), 2000):
                    some = part.iloc[at : at + 2000]
                    values, h = some[value].to_numpy(float), some["_draw"].to_numpy(np.int64).view(np.uint64)[:, None] + places
                    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # each bit of key and round moves all others
                    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    times = np.searchsorted(steps, (h >> np.uint64(11)) / float(1 << 53), side="right")
                    yield pd.DataFrame({by: group, "round": range(rounds), "total": values @ times, "times": times.sum(axis=0), "plain": values.sum(), "n": len(values)})

    kind = scores.schema[by].dataType.simpleString()
    sums = scores.select(by, F.col(value).cast("double").alias(value), F.xxhash64(F.lit(seed), key).alias("_draw")).where(F.col(value).isNotNull()).mapInPandas(partial, f"{by} {kind}, round int, total double, times long, plain double, n long")
    means = sums.groupBy(by, "round").agg((F.sum("total") / F.sum("times")).alias("mean"), F.sum("plain").alias("plain"), F.sum("n").alias("n"))
    return means.groupBy(by).agg(
        F.max("n").alias("n"), F.round(F.max("plain") / F.max("n"), 6).alias("mean"), F.round(F.percentile("mean", 0.025), 6).alias("low"), F.round(F.percentile("mean", 0.975), 6).alias("high"),
    )
