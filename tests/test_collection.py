"""Collections: plans, many marks, codes from elsewhere, import and export, automatic seal."""

import numpy as np
import pytest

from vectorloom.errors import AlreadyExists, InvalidArgument
from vectorloom.functions.quantize import Quantizer
from vectorloom.operators import attention, collection, evaluate
from vectorloom.operators.collection import Config, Engine
from vectorloom.sources import gguf, safetensors


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "engine"))


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id string, values array<float>")


def written(spark, engine):
    c = engine.create(Config("docs", 4))
    c.upsert(vectors(spark, [(f"v{i}", [i, 1, 0, 0]) for i in range(30)]))
    c.seal()
    c.upsert(vectors(spark, [(f"v{i}", [-i, 1, 0, 0]) for i in range(0, 30, 3)]))
    c.delete([f"v{i}" for i in range(0, 30, 5)])
    c.seal()
    c.upsert(vectors(spark, [("v1", [100, 0, 0, 0]), ("v0", [7, 7, 7, 7])]))
    return c


@pytest.mark.parametrize("marks", [1_000_000, 3, 0])
def test_live_rows_whatever_the_join(spark, engine, monkeypatch, marks):
    monkeypatch.setattr(collection, "MAX_MARKS", marks)
    c = written(spark, engine)
    want = {f"v{i}": [-i if i % 3 == 0 else i, 1, 0, 0] for i in range(30) if i % 5} | {"v1": [100, 0, 0, 0], "v0": [7, 7, 7, 7]}
    assert {r["id"]: r["values"] for r in c.snapshot().collect()} == want
    assert [r["id"] for r in c.ids().collect()] == sorted(want)
    assert c.compact() == len(want) and {r["id"]: r["values"] for r in c.snapshot().collect()} == want


def test_sealed_vectors_are_not_shuffled(spark, engine):
    c = written(spark, engine)
    c._parts(c._m)[1].select("id", "codes", "values").collect()
    plan = c._parts(c._m)[1].select("id", "codes", "values")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    sealed = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(sealed) <= 1  # the log's own rows, by id


def test_codes_from_elsewhere(spark, engine):
    x = np.random.default_rng(1).standard_normal((20, 8))
    q = Quantizer(8, 4, 42)
    codes, norm = q.encode(x)
    rows = spark.createDataFrame([(f"c{i}", bytearray(k.tobytes()), float(n)) for i, (k, n) in enumerate(zip(codes, norm, strict=True))], "id string, codes binary, norm float")
    c = engine.create(Config("codes", 8))
    c.delete(["c3"])
    assert c.load_codes(rows) == 20
    got = {r["id"]: r["values"] for r in c.snapshot().collect()}
    assert len(got) == 20 and np.allclose([got[f"c{i}"] for i in range(20)], q.decode(codes, norm), atol=1e-5)
    with pytest.raises(AlreadyExists):
        c.load_codes(rows.limit(1))
    with pytest.raises(InvalidArgument):
        c.load_codes(spark.createDataFrame([("x", bytearray(b"1"), 1.0)], rows.schema))
    assert c.stats()["live_count"] == 20


def test_automatic_seal_and_engine_stats(spark, engine):
    c = engine.create(Config("auto", 2, seal_threshold=5))
    c.upsert(vectors(spark, [(str(i), [i, 1]) for i in range(3)]))
    assert c.stats()["segments"] == 0 and engine.stats()["segments_active"] == 1
    c.upsert(vectors(spark, [(str(i), [i, 1]) for i in range(2, 5)]))
    assert c.stats()["segments"] == 1 and c.stats()["live_count"] == 5 and engine.stats()["segments_sealed_total"] == 1 and engine.stats()["host_bytes"] == 5 * 29
    assert c.seal() == 0


def test_import_and_export(spark, engine, tmp_path):
    gguf.register(spark)
    c = written(spark, engine)
    path = str(tmp_path / "a.safetensors")
    n = safetensors.export_collection(c, path)
    meta = safetensors.read_header(path)[1]
    assert safetensors.read_quantiser_metadata(meta) == {"version": "0.1", "rotator_seed": 42, "rotator_type": "hadamard", "codebook_id": "d4_b4_lloyd_max_v1", "bit_width": 4, "variant": "mse"}
    assert safetensors.read_quantiser_metadata({}) == {"version": "", "rotator_seed": 0, "rotator_type": "", "codebook_id": "", "bit_width": 0, "variant": ""}
    with pytest.raises(InvalidArgument):
        safetensors.read_quantiser_metadata({"bit_width": "4x"})
    assert safetensors.import_collection(engine, path, Config("back", 4), "r") == n
    ids = meta["ids"].split("\n")
    back, whole = ({r["id"]: r["values"] for r in x.snapshot().collect()} for x in (engine.collection("back"), c))
    assert {ids[int(k[1:])]: v for k, v in back.items()} == whole
    with pytest.raises(AlreadyExists):
        safetensors.import_collection(engine, path, Config("back", 4))
    with pytest.raises(InvalidArgument):
        safetensors.import_collection(engine, path, Config("wrong", 5))
    assert "wrong" not in engine.list()


def test_upsert_checks_what_it_wrote(spark, engine):
    c = engine.create(Config("docs", 2))
    seen = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    c.upsert(vectors(spark, [("a", [1, 2]), ("b", [3, 4])]).coalesce(1).mapInPandas(once, "id string, values array<float>"))
    assert seen.value == 2


def test_cache_dtypes_and_throughput(spark):
    assert attention.CacheConfig.from_dtype("turboquant3", 64) == attention.CacheConfig(64, 3, 3)
    assert [attention.is_cache_dtype(x) for x in ("turboquant1", "turboquant8", "turboquant9", "turboquant", "fp8", "turboquantx")] == [True, True, False, False, False, False]
    with pytest.raises(InvalidArgument):
        attention.CacheConfig.from_dtype("auto", 64)
    df = spark.createDataFrame([(10.0,), (30.0,), (None,), (float("nan"),)], "ms double")
    assert evaluate.throughput(df.where("not isnan(ms)"), "ms").first()["qps"] == 50.0
    assert evaluate.throughput(df.limit(0), "ms").first()["qps"] == 0.0
    assert {r["p"]: r["value"] for r in evaluate.percentiles(df, "ms", [0.0, 1.0]).collect()} == {0.0: 10.0, 1.0: 30.0}
