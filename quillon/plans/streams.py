"""Event-time queries. The same transformations run on streams, see quillon.streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.streaming import windows as W

from .registry import query, table


@query("x_tumbling_window", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x_tumbling_window(spark, sf_dir):
    return W.tumbling(table(spark, sf_dir, "events"), "1 hour")


@query("x_sliding_window", """
WITH w AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * k AS start, event_type, value FROM events, (SELECT unnest([0, 1]) AS k))
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def x_sliding_window(spark, sf_dir):
    return W.tumbling(table(spark, sf_dir, "events"), "1 hour", "30 minutes")


@query("x_session_window", """
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def x_session_window(spark, sf_dir):
    return W.sessions(table(spark, sf_dir, "events"), "6 hours")


@query("x_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def x_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("x_approx_distinct")
def x_approx_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@query("x_resume_once", "SELECT user_id, count(*) AS n FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1) GROUP BY 1")
def x_resume_once(spark, sf_dir):
    return W.once(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
