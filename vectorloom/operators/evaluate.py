"""Recall, latency reports and synthetic vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, recall: share of the true best k (clipped to what there is) among those found."""
    best = truth.where(F.col("rank") <= k).select("query_id", "id")
    hits = best.join(found.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


#: Rows that one task may sort to find a percentile.
RANKED = 1_000_000


def _at_place(df: DataFrame, place: int, n: int) -> float:
    """The value at a place (from 0) in the order of column ``value``.

    Values around the place are narrowed by approximate quantiles until one task can sort them, or all are equal.
    """
    low, high, before = None, None, 0
    while n > RANKED:
        span = df.agg(F.min("value"), F.max("value")).first()
        if span[0] == span[1]:
            return float(span[0])
        share, off = (place - before) / n, 0.01
        a, b = (float(v) for v in df.approxQuantile("value", [max(0.0, share - off), min(1.0, share + off)], 0.001))
        left, inside = df.agg(F.count(F.when(F.col("value") < a, 1)), F.count(F.when(F.col("value").between(a, b), 1))).first()
        if left <= place - before < left + inside and inside < n:
            low, high, before, n = a, b, before + left, inside
        else:  # a value that fills the bracket, or an estimate beside it: halve by the middle value
            middle = float(df.approxQuantile("value", [0.5], 0.001)[0])
            left, same = df.agg(F.count(F.when(F.col("value") < middle, 1)), F.count(F.when(F.col("value") == middle, 1))).first()
            if place - before < left:
                df, n = df.where(F.col("value") < middle), left
            elif place - before < left + same:
                return middle
            else:
                df, before, n = df.where(F.col("value") > middle), before + left + same, n - left - same
            continue
        df = df.where(F.col("value").between(low, high))
    rows = df.orderBy("value").limit(place - before + 1).agg(F.max("value")).first()
    return float(rows[0])


def percentiles(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """p, value: by nearest rank, halves up, of (n - 1) p; nulls and NaN don't count, without values there are no rows."""
    known = df.select(F.col(value).cast("double").alias("value")).where("value is not null and not isnan(value)")
    n = known.count()
    rows = [(float(p), _at_place(known, int(np.floor((n - 1) * p + 0.5)), n)) for p in at] if n else []
    return df.sparkSession.createDataFrame(rows, "p double, value double")


def latency_report(df: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, min, p50, p95, p99 and max of a column, by the percentiles above."""
    df = df.select(F.col(value).cast("double").alias(value)).where(~F.isnan(value))
    ranks = percentiles(df, value, [0.5, 0.95, 0.99]).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
    out = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.crossJoin(ranks).select("n", "mean", "min", "p50", "p95", "p99", "max")  # one row each


def throughput(df: DataFrame, value: str, per_second: float = 1000.0) -> DataFrame:
    """n, total_seconds, qps of latencies, ``per_second`` of whose units are a second; no latencies: 0."""
    total = F.coalesce(F.sum(value), F.lit(0.0)) / F.lit(per_second)
    out = df.where(~F.isnan(F.col(value).cast("double"))).agg(F.count(value).alias("n"), total.alias("total_seconds"))
    return out.withColumn("qps", F.when(F.col("total_seconds") > 0, F.col("n") / F.col("total_seconds")).otherwise(0.0))


def _edge(i: int) -> float:
    """The largest number whose logarithm to base 2 is ``i`` or less in doubles."""
    x = 2.0**i
    while math.log2(math.nextafter(x, math.inf)) <= i:
        x = math.nextafter(x, math.inf)
    return x


def histogram_bucket(value, start: float, count: int) -> Column:
    """Number of the exponential bucket (start * 2**i) that a value falls in; ``count`` is the one above all.

    By comparisons alone: Spark's logarithm is null for 0 and isn't exact near powers of two. Zero is in bucket 0;
    negative values, nulls and NaN are in ``count``, as by SQL's ceil(log2(value / start)) held within 0 and count.
    """
    x = value.cast("double") / F.lit(start)
    above = [(x > F.lit(_edge(i))).cast("int") for i in range(count)]
    return F.when(x >= 0, sum(above, F.lit(0))).otherwise(F.lit(count)).cast("int")


def synthetic(spark: SparkSession, n: int, dim: int, seed: int = 1) -> DataFrame:
    """id, values: unit Gaussian directions, each made from its own row number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack([np.random.Generator(np.random.PCG64([seed, i])).standard_normal(dim) for i in f["id"]]) if len(f) else np.empty((0, dim))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.DataFrame({"id": [f"vec-{i}" for i in f["id"]], "values": list(x.astype(np.float32))})

    return spark.range(n).mapInPandas(run, "id string, values array<float>")
