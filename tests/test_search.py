"""Search against brute force: ties, many batches, and query sets that go in blocks."""

import numpy as np
import pytest

from vectorloom.errors import InvalidArgument
from vectorloom.functions.quantize import ProdQuantizer, Quantizer
from vectorloom.operators import search


def frame(spark, x, name):
    return spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], f"{name} string, values array<float>")


@pytest.mark.parametrize("bound", [1 << 22, 64])
def test_exact_with_ties(spark, monkeypatch, bound):
    monkeypatch.setattr(search, "MAX_QUERY_NUMBERS", bound)
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 200)
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (700, 5)).astype(np.float32)  # full of ties
    rows, asked = frame(spark, x, "id").repartition(5), frame(spark, x[:150], "query_id").repartition(3)
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in search.exact(rows, asked, 5, 7).collect()}
    for q in range(150):
        s = x @ x[q]
        for rank, i in enumerate(np.lexsort((np.arange(700), -s))[:7], 1):
            assert got[f"v{q:04d}", rank] == (f"v{i:04d}", s[i])
    assert len(got) == 150 * 7
    assert search.exact(rows.limit(0), asked, 5, 7).count() == 0 and search.exact(rows, asked.limit(0), 5, 7).count() == 0
    bad = spark.createDataFrame([("b", [1.0, float("nan"), 0.0, 0.0, 0.0])], "query_id string, values array<float>")
    with pytest.raises(InvalidArgument):
        search.exact(rows, bad, 5, 3)


@pytest.mark.parametrize("bound", [1 << 22, 64])
def test_codes_in_blocks(spark, monkeypatch, bound):
    monkeypatch.setattr(search, "MAX_QUERY_NUMBERS", bound)
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 320)
    from vectorloom.functions import columns as C

    x = np.random.default_rng(2).standard_normal((300, 16)).astype(np.float32)
    rows, asked = frame(spark, x, "id").repartition(4), frame(spark, x[:40], "query_id")
    q = Quantizer(16, 4, 42)
    s = q.scores(x[:40].astype(np.float64), *q.encode(x.astype(np.float64)))
    got = search.quantized(rows.withColumn("c", C.quantize(q)("values")).select("id", "c.codes", "c.norm"), asked, q, 5).collect()
    assert len(got) == 200 and all(r["id"] == f"v{np.lexsort((np.arange(300), -s[:, int(r['query_id'][1:])]))[r['rank'] - 1]:04d}" for r in got)
    p = ProdQuantizer(16, 4, 42)
    assert search.prod(rows.withColumn("c", C.prod_quantize(p)("values")).select("id", "c.*"), asked, p, 3).count() == 120
