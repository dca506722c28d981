"""Rounding of products as the SQL does it."""

import duckdb
from pyspark.sql import functions as F

from quillon.functions import scores


def test_products_round_as_in_sql(spark):
    values = spark.range(0, 1_000_000, 5).select((F.col("id") / 1e6).alias("x"))  # every second one is near a tie at 0.9
    got = [r[0] for r in values.coalesce(1).select(scores.rounded(F.col("x") * 0.9, 6)).collect()]
    want = [r[0] for r in duckdb.sql("SELECT round(CAST(i AS DOUBLE) / 1e6 * 0.9, 6) FROM range(0, 1000000, 5) t(i) ORDER BY i").fetchall()]
    assert got == want
    assert spark.sql("SELECT double(0.144165) AS x").select(scores.rounded(F.col("x") * 0.9, 6)).first()[0] == 0.129748
