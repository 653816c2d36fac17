"""Histogram buckets at the values where a logarithm is missing or inexact."""

import duckdb
from pyspark.sql import functions as F

from vectorloom.operators import evaluate


def test_buckets_equal_sql_at_odd_values(spark):
    values = [0.0, -0.0, -1.0, float("nan"), float("inf"), float("-inf"), 5e-324, 0.5, 1.0, 1.0000000000000002, 2.0, 2.0000000000000004]
    values += [y for i in range(2, 14) for y in (2.0**i - 2.0 ** (i - 50), 2.0**i, 2.0**i * (1 + 2.0**-52), 2.0**i * (1 + 2.0**-51), 2.0**i * (1 + 2.0**-50), 2.0**i * (1 + 2.0**-49))]
    df = spark.createDataFrame(list(enumerate(values)), "n int, value double")
    got = dict(df.select("n", evaluate.histogram_bucket(F.col("value"), 1.0, 12)).collect())
    for n, v in enumerate(values):
        assert got[n] == duckdb.execute("SELECT greatest(0, least(12, ceil(log2(?::DOUBLE))))::INTEGER", [v]).fetchone()[0], v
