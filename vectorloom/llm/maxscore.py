"""Exact top-k inner products by MaxScore over sharded postings.

A vector is a document and its dimensions are terms; a query's term contributes ``q * x``. Each candidate shard
keeps its postings by dimension, with the smallest and largest value of each, which bound every contribution.
For a query the terms are ordered by their room (largest less smallest contribution). While a chunk of
candidates is scored, the terms of least room whose bounds together can't lift a candidate over the current
k-th score are non-essential: only the postings of the essential terms are traversed for all candidates; the
others are probed term group by term group, and only for candidates whose partial score plus the bounds of
what is left still competes. Shards' own best k are merged by query. All numbers are integers, held in
doubles, far below 2**53.

Queries and candidates meet block by block: a task holds one shard and one block of queries, both bounded, so
nothing grows with the tables and no pair of rows is ever written. Only query blocks are copied, one for each shard.
Chunks of candidates start small, so that there is a bar to prune by early.

Edge cases: vectors null, empty, or with a null or non-finite component take no part, and vectors of another
length than a query's aren't its candidates; equal scores go to the smaller vec_id; a query doesn't find its
own vec_id; rows that repeat count once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.runtime import ship

SHARD_ROWS, QUERY_ROWS, FIRST, CHUNK, PROBE = 8_192, 512, 128, 2_048, 8


def _chunks(n: int) -> Iterator[tuple[int, int]]:
    """Cuts of n candidates: FIRST, then twice as many each time up to CHUNK."""
    at, size = 0, FIRST
    while at < n:
        yield at, min(n, at + size)
        at, size = at + size, min(CHUNK, 2 * size)


def score_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's best k in one shard."""
    by_id = np.argsort(ids, kind="stable")
    ids = ids[by_id]
    postings = np.ascontiguousarray(vectors[by_id].T.astype(np.float64))
    least, most = postings.min(axis=1), postings.max(axis=1)
    out: list[tuple[int, int, int]] = []
    n = len(ids)
    for q_id, q in zip(query_ids.tolist(), queries.astype(np.float64), strict=True):
        high = np.maximum(q * least, q * most)
        low = np.minimum(q * least, q * most)
        terms = np.argsort(high - low, kind="stable")  # least room first
        room = np.cumsum((high - low)[terms])
        top = float(high.sum())
        best_s, best_i = np.empty(0), np.empty(0, np.int64)
        bar = -np.inf
        for at, end in _chunks(n):
            part = slice(at, end)
            here = ids[part]
            # non-essential: even all their room over their least contributions leaves a candidate under the bar
            # unless an essential posting adds to it
            cut = int(np.searchsorted(room, bar - float(low.sum()), side="left")) if np.isfinite(bar) else 0
            cut = min(cut, len(terms) - 1)
            essential = terms[cut:]
            score = q[essential] @ postings[essential, part]
            alive = np.flatnonzero(here != q_id)
            score = score[alive]
            left = float(high[terms[:cut]].sum())
            while cut and len(alive):
                fit = score + left >= bar
                alive, score = alive[fit], score[fit]
                probe = terms[max(0, cut - PROBE) : cut]
                cut -= len(probe)
                left = float(high[terms[:cut]].sum())
                if len(alive):
                    score = score + q[probe] @ postings[np.ix_(probe, alive + at)]
            if len(alive):
                keep = score >= bar
                best_s, best_i = np.concatenate((best_s, score[keep])), np.concatenate((best_i, here[alive[keep]]))
                if len(best_s) > k:
                    order = np.lexsort((best_i, -best_s))[:k]
                    best_s, best_i = best_s[order], best_i[order]
                if len(best_s) == k:
                    bar = float(best_s.min())
        order = np.lexsort((best_i, -best_s))[:k]
        out += [(q_id, int(best_i[j]), int(best_s[j])) for j in order]
        assert top >= bar or not len(best_s)
    return out


def _blocks(rows: DataFrame, block: str) -> DataFrame:
    """Rows (vec_id, v, block) packed as one row a block: ids and the matrix as bytes."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks()
        flat = v.flatten()
        ids = table.column("vec_id").to_numpy().astype("<i8")
        return pa.table({
            "block": [key[0].as_py()], "dim": [key[1].as_py()], "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([flat.to_numpy().astype("<f8").tobytes()], pa.binary()),
        }, schema=pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]))

    return rows.withColumn("block", block).groupBy("block", "dim").applyInArrow(pack, "block long, dim int, ids binary, data binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: exact best ``k`` of ``vectors`` (vec_id, embedding) for each of ``queries``."""
    spark = vectors.sparkSession
    ship(spark)

    def whole(df: DataFrame) -> DataFrame:
        x = F.col("embedding")
        good = F.coalesce(F.size(x) > 0, F.lit(False)) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
        v = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("double"))
        return df.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(x).alias("dim"))

    n, n_q = vectors.select("vec_id").count(), queries.select("vec_id").count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_q // QUERY_ROWS))
    dealt = lambda m: F.pmod(F.xxhash64("vec_id", "v"), F.lit(m))
    docs = _blocks(whole(vectors), dealt(shards)).select(F.col("block").alias("shard"), "dim", "ids", "data")
    asked = _blocks(whole(queries), dealt(blocks)).select("block", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    met = docs.join(asked, "shard").where("dim = q_dim").select("dim", "ids", "data", "q_ids", "q_data")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                found = score_shard(
                    np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["data"], "<f8").reshape(-1, r["dim"]), np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_data"], "<f8").reshape(-1, r["dim"]), k
                )
                cols = list(zip(*found, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    best = met.mapInArrow(score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
