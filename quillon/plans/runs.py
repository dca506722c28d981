"""Run-log queries: events as records (event_type = subtask, user_id = item or dataset, value = score and latency), labels and documents as items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scores as S
from quillon.operators import runs as R

from .registry import query, table


def log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("item"), F.concat(F.lit("set"), (F.col("user_id") % 9).cast("string")).alias("dataset"), F.col("event_type").alias("subtask"), F.col("value").alias("score"))


LOG = "SELECT event_id, ts, user_id AS item, 'set' || CAST(user_id % 9 AS VARCHAR) AS dataset, event_type AS subtask, value AS score FROM events"


@query("score_rollup", f"""
SELECT dataset, subtask, count(*) AS n, round(sum(score), 6) AS total, round(avg(score), 6) AS mean FROM ({LOG}) GROUP BY GROUPING SETS ((dataset), (dataset, subtask))""")
def score_rollup(spark, sf_dir):
    return R.rollup(log(spark, sf_dir), ["dataset", "subtask"])


@query("latency_stats", f"""
SELECT dataset, count(*) AS n, round(quantile_cont(score / 1000, 0.5), 6) AS median_s, round(avg(score / 1000), 6) AS mean_s, round(quantile_cont(score / 1000, 0.95), 6) AS p95_s FROM ({LOG}) WHERE score > 0 GROUP BY dataset""")
def latency_stats(spark, sf_dir):
    return R.latency(log(spark, sf_dir), ["dataset"], "score")


@query("coverage", f"""
WITH t(dataset, total) AS (VALUES ('set0', 1500), ('set1', 1200), ('set2', 2000)), n AS (SELECT dataset, count(*) AS n FROM ({LOG}) GROUP BY dataset)
SELECT dataset, n, CAST(coalesce(total, n) AS BIGINT) AS total, round(n / CAST(coalesce(total, n) AS DOUBLE), 6) AS coverage FROM n LEFT JOIN t USING (dataset)""")
def coverage(spark, sf_dir):
    totals = spark.createDataFrame([("set0", 1500), ("set1", 1200), ("set2", 2000)], "dataset string, total long")
    return R.coverage(log(spark, sf_dir), totals, "dataset")


@query("sample_drift", f"""
WITH s AS (SELECT DISTINCT dataset, event_id * 2 AS k FROM ({LOG}) WHERE event_id < 600), l AS (SELECT dataset, event_id AS k, score FROM ({LOG})),
j AS (SELECT s.dataset, s.k, l.score FROM s LEFT JOIN l ON l.dataset = s.dataset AND l.k = s.k)
SELECT dataset, count(DISTINCT k) AS expected, count(DISTINCT k) FILTER (WHERE score IS NOT NULL) AS seen, round(avg(score), 6) AS mean,
CASE WHEN count(score) = 0 THEN 'NO_DATA' WHEN count(DISTINCT k) FILTER (WHERE score IS NOT NULL) < count(DISTINCT k) THEN 'DRIFT' ELSE 'OK' END AS status FROM j GROUP BY dataset""")
def sample_drift(spark, sf_dir):
    run = log(spark, sf_dir)
    sample = run.where("event_id < 600").select("dataset", (F.col("event_id") * 2).alias("event_id")).distinct()
    return R.drift(run, sample, ["dataset"], "event_id", "score")


@query("latest_wins", f"SELECT item, subtask, event_id, score FROM ({LOG}) QUALIFY row_number() OVER (PARTITION BY item, subtask ORDER BY ts DESC, event_id) = 1")
def latest_wins(spark, sf_dir):
    return R.latest(log(spark, sf_dir), ["item", "subtask"], "ts", "event_id").select("item", "subtask", "event_id", "score")


@query("first_wins", f"SELECT item, event_id, score FROM ({LOG}) QUALIFY row_number() OVER (PARTITION BY item ORDER BY event_id) = 1")
def first_wins(spark, sf_dir):
    return R.first(log(spark, sf_dir), ["item"], "event_id").select("item", "event_id", "score")


@query("last_wins", f"SELECT item, event_id, score FROM ({LOG}) QUALIFY row_number() OVER (PARTITION BY item ORDER BY event_id DESC) = 1")
def last_wins(spark, sf_dir):
    return R.last(log(spark, sf_dir), ["item"], "event_id").select("item", "event_id", "score")


BASE, OTHER = "SELECT item, event_id, score FROM ({0}) WHERE subtask = 'click'", "SELECT item, avg(score) AS score FROM ({0}) WHERE subtask = 'view' AND item % 3 = 0 GROUP BY item"


def base(spark, sf_dir):
    return log(spark, sf_dir).where("subtask = 'click'").select("item", "event_id", "score")


def other(spark, sf_dir):
    return log(spark, sf_dir).where("subtask = 'view' AND item % 3 = 0").groupBy("item").agg(F.round(F.avg("score"), 6).alias("score"))


@query("routed_merge", f"""
WITH o AS (SELECT item, round(avg(score), 6) AS score FROM ({LOG}) WHERE subtask = 'view' AND item % 3 = 0 GROUP BY item), r AS (SELECT DISTINCT item, item % 2 = 0 AS route FROM ({LOG}))
SELECT b.item, b.event_id, CASE WHEN r.route AND o.score IS NOT NULL THEN o.score ELSE b.score END AS score, coalesce(r.route, false) AND o.score IS NOT NULL AS routed
FROM ({BASE.format(LOG)}) b LEFT JOIN o USING (item) LEFT JOIN r USING (item)""")
def routed_merge(spark, sf_dir):
    routes = log(spark, sf_dir).select("item", (F.col("item") % 2 == 0).alias("route")).distinct()
    return R.routed(base(spark, sf_dir), other(spark, sf_dir), routes, ["item"], "score")


@query("splice", f"""
WITH o AS (SELECT item, round(avg(score), 6) AS score FROM ({LOG}) WHERE subtask = 'view' AND item % 3 = 0 GROUP BY item)
SELECT b.item, b.event_id, CASE WHEN o.item IS NOT NULL THEN o.score ELSE b.score END AS score, o.item IS NOT NULL AS spliced FROM ({BASE.format(LOG)}) b LEFT JOIN o USING (item)""")
def splice(spark, sf_dir):
    return R.overriding(base(spark, sf_dir), other(spark, sf_dir), ["item"], "score").select("item", "event_id", "score", "spliced")


@query("newer_over_older", f"""
WITH a AS (SELECT item, round(avg(score), 6) AS score FROM ({LOG}) WHERE subtask = 'click' AND item % 2 = 0 GROUP BY item), b AS (SELECT item, round(avg(score), 6) AS score FROM ({LOG}) WHERE subtask = 'view' AND item % 3 = 0 GROUP BY item)
SELECT item, CASE WHEN b.item IS NOT NULL THEN b.score ELSE a.score END AS score, b.item IS NOT NULL AS from_new FROM a FULL JOIN b USING (item)""")
def newer_over_older(spark, sf_dir):
    old = log(spark, sf_dir).where("subtask = 'click' AND item % 2 = 0").groupBy("item").agg(F.round(F.avg("score"), 6).alias("score"))
    return R.newer_over_older(old, other(spark, sf_dir), ["item"], "score")


@query("resume_anti", f"SELECT DISTINCT item, dataset FROM ({LOG}) WHERE (item, dataset) NOT IN (SELECT item, dataset FROM ({LOG}) WHERE subtask = 'error' AND score > 40)")
def resume_anti(spark, sf_dir):
    run = log(spark, sf_dir)
    return R.remaining(run.select("item", "dataset").distinct(), run.where("subtask = 'error' AND score > 40"), ["item", "dataset"])


@query("question_counts_cube", "SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def question_counts_cube(spark, sf_dir):
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("case_study_stats", "SELECT source, count(*) AS total, sum(quality) AS correct, round(avg(quality), 6) AS accuracy, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS toxic_failures FROM documents JOIN labels USING (doc_id) GROUP BY source")
def case_study_stats(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.sum("quality").alias("correct"), F.round(F.avg("quality"), 6).alias("accuracy"), F.count(F.when((F.col("quality") == 0) & (F.col("toxic") == 1), 1)).alias("toxic_failures"))


@query("error_classes", """
WITH e AS (SELECT event_id, event_type = 'click' AS correct, CASE WHEN event_type = 'error' THEN 'request timed out' WHEN event_id % 11 = 0 THEN 'KG lookup' ELSE '' END AS err, value > 10 AS found, value > 50 AS inside FROM events)
SELECT class, count(*) AS n FROM (SELECT CASE WHEN correct THEN NULL WHEN regexp_matches(lower(err), 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(lower(err), 'kg|tool') THEN 'kg_tool_error'
WHEN NOT found THEN 'retrieval_miss' WHEN inside THEN 'wrong_extraction' ELSE 'reasoning_error' END AS class FROM e) GROUP BY class""")
def error_classes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    error = F.when(F.col("event_type") == "error", "request timed out").when(F.col("event_id") % 11 == 0, "KG lookup").otherwise("")
    return e.groupBy(S.error_class(F.col("event_type") == "click", error, F.col("value") > 10, F.col("value") > 50).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("mean_all_empty_gold", f"SELECT dataset, count(*) AS n, round(avg(CASE WHEN subtask = 'error' THEN 1.0 ELSE score END), 6) AS mean FROM ({LOG}) GROUP BY dataset")
def mean_all_empty_gold(spark, sf_dir):
    return R.mean_with_empty_gold(log(spark, sf_dir), ["dataset"], "score", F.col("subtask") == "error")


@query("leaderboard", f"SELECT dataset, n, mean, row_number() OVER (ORDER BY mean DESC, dataset) AS place FROM (SELECT dataset, count(*) AS n, round(avg(score), 6) AS mean FROM ({LOG}) GROUP BY dataset)")
def leaderboard(spark, sf_dir):
    from pyspark.sql import Window

    means = log(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean").desc(), "dataset")))  # one row a dataset


@query("routing_stats", "SELECT event_type, user_id % 4 AS grp, count(*) AS n FROM events GROUP BY ALL")
def routing_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 4).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("run_item_filter", f"""
WITH i AS (SELECT * FROM ({LOG}) WHERE subtask IN ('click', 'view') AND score > 5 AND item NOT IN (SELECT item FROM ({LOG}) WHERE subtask = 'error' AND score > 60))
SELECT dataset, event_id FROM i QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY event_id) <= 25""")
def run_item_filter(spark, sf_dir):
    from pyspark.sql import Window

    run = log(spark, sf_dir)
    items = R.remaining(run.where("subtask IN ('click', 'view') AND score > 5"), run.where("subtask = 'error' AND score > 60"), ["item"])
    return items.withColumn("n", F.row_number().over(Window.partitionBy("dataset").orderBy("event_id"))).where("n <= 25").select("dataset", "event_id")


@query("json_props", """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("delta_totals", f"""
WITH t AS (SELECT dataset, sum(score) AS old FROM ({LOG}) GROUP BY dataset), a AS (SELECT dataset, sum(score) AS part FROM ({LOG}) WHERE subtask = 'error' GROUP BY dataset)
SELECT dataset, round(old - coalesce(part, 0) + coalesce(part, 0) / 2, 4) AS total FROM t LEFT JOIN a USING (dataset)""")
def delta_totals(spark, sf_dir):
    part = F.coalesce(F.sum(F.when(F.col("subtask") == "error", F.col("score"))), F.lit(0.0))
    return log(spark, sf_dir).groupBy("dataset").agg(F.round(F.sum("score") - part + part / 2, 4).alias("total"))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    return R.bootstrap(log(spark, sf_dir), "dataset", "score", "event_id")
