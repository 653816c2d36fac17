"""Searches by groups of queries: what is shuffled, memory, and ranks that single precision can't tell apart."""

import tracemalloc

import numpy as np
import pytest

from vectorloom.functions import columns as C
from vectorloom.functions.quantize import ProdQuantizer
from vectorloom.operators import search


def frame(spark, x, name):
    return spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], f"{name} string, values array<double>")


def best(scores, k):
    """Places of the k highest scores of each column, ties to the smaller place."""
    return [list(np.lexsort((np.arange(len(s)), -s))[:k]) for s in scores.T]


def ranked(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(int(r["id"][1:]))
    return [out[q] for q in sorted(out)]


def test_groups_shuffle_k_rows_a_query_and_share(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 200)  # 18 blocks of rows
    x = np.random.default_rng(1).standard_normal((700, 5))
    rows, asked = frame(spark, x, "id").repartition(5), frame(spark, x[:150], "query_id").repartition(3)
    got = search._met_in_blocks(rows, asked, 5, 7, lambda q: q, lambda b: C.matrix(b.column("values"), 5))
    groups, shares = search._cells(spark, 150, 700, 5, 7)
    assert got.count() == 150 * 7 * shares and groups > 1
    assert ranked(search.merge(got, 7).collect()) == best(x @ x[:150].T, 7)


@pytest.mark.parametrize("queries,rows,cores", [(615_384, 615_384, 12), (10_000_000, 10_000_000, 12), (5_000, 10_000_000, 12), (10, 10, 12), (0, 5, 4), (3, 0, 4)])
def test_a_group_is_bounded(queries, rows, cores):
    class Context:
        defaultParallelism = cores

    class Session:
        sparkContext = Context

    groups, shares = search._cells(Session, queries, rows, 64, 10)
    assert groups >= 1 and shares >= 1 and groups * shares >= 2 * cores
    assert -(-queries // groups) * 64 <= search.GROUP_NUMBERS
    assert groups * shares <= max(4 * cores, 2 * queries * 64 // search.GROUP_NUMBERS)


@pytest.mark.parametrize("bound", [1 << 18, 64])
def test_close_equal_and_large_numbers(spark, monkeypatch, bound):
    monkeypatch.setattr(search, "MAX_QUERY_NUMBERS", bound)
    monkeypatch.setattr(search, "TILE_ROWS", 64)
    monkeypatch.setattr(search, "TILE_QUERIES", 16)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8))
    x[100:300] = x[0] + rng.integers(0, 50, (200, 1)) * 1e-12  # alike in single precision, many of them equal
    x[300:400] = x[1]
    x[400] *= 1e6
    x[401] = 0
    rows, asked = frame(spark, x, "id").repartition(3), frame(spark, x[:50], "query_id")
    scores = np.zeros((600, 50))
    for j in range(8):  # in the order of SQL's list_dot_product
        scores += x[:, j : j + 1] * x[:50, j]
    for scale in (1.0, 1e200, 1e-160):
        by = search.exact(rows.selectExpr("id", f"transform(values, x -> x * {scale!r}D) as values"), asked, 8, 12).collect()
        if scale == 1.0:
            assert ranked(by) == best(scores, 12)
        else:  # scaling rounds once more: the clear ranks stay
            assert len(by) == 600 and {r["id"] for r in by if r["rank"] == 1} <= {f"v{i:04d}" for i in range(600)}


def test_rows_without_finite_numbers_rank_as_spark_sorts(spark):
    x = np.random.default_rng(4).standard_normal((40, 3))
    x[7, 1], x[9, 1], x[11, 1] = np.nan, np.inf, -np.inf
    got = search.exact(frame(spark, x, "id"), frame(spark, np.abs(x[:2]), "query_id"), 3, 40).collect()
    assert len(got) == 80
    for q in ranked(got):
        assert q[:2] == [7, 9] and q[-1] == 11


@pytest.mark.parametrize("estimator", ["unbiased", "sign_agreement"])
def test_product_codes_in_groups(spark, monkeypatch, estimator):
    monkeypatch.setattr(search, "MAX_QUERY_NUMBERS", 64)
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 320)
    x = np.random.default_rng(5).standard_normal((300, 16)).astype(np.float32).astype(np.float64)
    p = ProdQuantizer(16, 4, 42)
    rows = frame(spark, x, "id").withColumn("c", C.prod_quantize(p)("values")).select("id", "c.*")
    scores = p.estimate(x[:40], *p.encode(x), estimator)
    assert ranked(search.prod(rows, frame(spark, x[:40], "query_id"), p, 5, estimator).collect()) == best(scores, 5)


def test_a_task_holds_a_tile_of_scores():
    x = np.random.default_rng(6).standard_normal((10_000, 64))
    ids = np.array([str(i) for i in range(len(x))], object)
    tracemalloc.start()
    b = search._Best(x[:4096], 5)
    b.add(x, ids)
    held = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert held < 100 and (b.n == 5).all()
