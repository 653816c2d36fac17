import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from vectorloom.errors import AlreadyExists, CorruptFile, InvalidArgument, NotFound
from vectorloom.functions import packing
from vectorloom.functions.codebook import codebook, nearest
from vectorloom.functions.quantize import ProdQuantizer, Quantizer
from vectorloom.functions.rotation import rotate, unrotate
from vectorloom.operators import attention, evaluate, search
from vectorloom.operators.collection import Config, Engine
from vectorloom.plans import filters
from vectorloom.plans.options import SearchOptions
from vectorloom.sources import gguf, safetensors
from vectorloom.streaming import cdc


@given(st.integers(1, 8), st.integers(1, 40), st.integers(0, 99))
def test_pack_round_trip(bits, n, seed):
    codes = np.random.default_rng(seed).integers(0, 1 << bits, (3, n))
    assert (packing.unpack(packing.pack(codes, bits), bits, n) == codes).all()


def test_packed_sizes_and_ties():
    assert [packing.packed_size(n, b) - 4 for b, n in ((4, 1536), (3, 1536), (1, 1536), (8, 1536), (4, 2048))] == [768, 576, 192, 1536, 1024]
    c = np.array([-1.5, -0.5, 0.5, 1.5])
    assert nearest(np.array([-2, -1.5, -1, -0.5, 0, 0.5, 1, 1.5, 100]), c).tolist() == [0, 0, 0, 1, 1, 2, 2, 3, 3]
    with pytest.raises(InvalidArgument):
        packing.pack(np.array([[4]]), 2)


def test_codebook_and_distortion():
    assert abs(codebook(1024, 1)[1] - np.sqrt(2 / (np.pi * 1024))) < 1e-4
    x = np.random.default_rng(1).standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for bits, most in ((1, 0.40), (2, 0.13), (4, 0.011), (6, 0.0009)):
        q = Quantizer(64, bits)
        assert ((q.decode(*q.encode(x)) - x) ** 2).sum(axis=1).mean() < most


@pytest.mark.parametrize("dim", [3, 64, 100, 256])
def test_rotation(dim):
    x = np.random.default_rng(dim).standard_normal((20, dim))
    y = rotate(x, 7)
    assert np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(unrotate(y, 7, dim), x)


def test_scores_in_rotated_space_and_zero_rows():
    x = np.random.default_rng(2).standard_normal((30, 50))
    x[3] = 0
    q = Quantizer(50, 4)
    code = q.encode(x)
    assert np.allclose(q.scores(x[:5], *code), q.decode(*code) @ x[:5].T, atol=1e-6)
    assert code[1][3] == 0 and not q.decode(*code)[3].any()


def test_prod_is_unbiased():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((2, 64))
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    got = [ProdQuantizer(64, 4, seed).estimate(y[None], *ProdQuantizer(64, 4, seed).encode(x[None]))[0, 0] for seed in range(300)]
    assert abs(np.mean(got) - x @ y) < 4 * np.std(got) / np.sqrt(len(got))


def test_options():
    for bad in (dict(k=0), dict(k=5000), dict(oversearch=0.5), dict(k=10, ef_search=5), dict(ef_search=-1)):
        with pytest.raises(InvalidArgument):
            SearchOptions(**bad)
    assert [SearchOptions(k=k, oversearch=f).effective_k for k, f in ((10, 0), (10, 1), (10, 2.5), (600, 3))] == [10, 10, 25, 1000]
    assert SearchOptions(k=10, oversearch=5, exact=True).effective_k == 10


def test_filters(spark):
    for bad in ("", "   ", "a LIKE 'x'", "a = 1 OR b = 2", "a > 1", "a = x"):
        with pytest.raises(InvalidArgument):
            filters.parse(bad)
    df = spark.createDataFrame([("it's", 3, True, None), ("a AND b", 4, False, "t")], "s string, n int, b boolean, z string")
    truth = {
        "s = 'it''s'": [1, 0], "s = 'a AND b'": [0, 1], "s != 'x' and n = 3": [1, 0], "z != 'x'": [0, 1], "z IS NULL": [1, 0], "gone is null": [1, 1], "gone = 'x'": [0, 0],
        "b = true": [1, 0], "z = true": [0, 1], "n <> 3": [0, 1], "n = '3'": [0, 0],
    }
    for text, want in truth.items():
        got = [int(r[0]) for r in df.select(filters.predicate(text, dict(df.dtypes))).collect()]
        assert got == want, text


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/engine")


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id string, values array<float>")


def test_collection_life(spark, engine):
    with pytest.raises(InvalidArgument):
        Config("-x", 4)
    c = engine.create(Config("docs", 4))
    with pytest.raises(AlreadyExists):
        engine.create(Config("docs", 4))
    c.upsert(vectors(spark, [("a", [1, 0, 0, 0]), ("b", [0, 1, 0, 0]), ("10", [0, 0, 1, 0])]))
    with pytest.raises(InvalidArgument):
        c.upsert(vectors(spark, [("x", [1, 0, 0, 0]), ("y", [1, 0])]))
    assert c.seal() == 3 and c.seal() == 0
    c.upsert(vectors(spark, [("a", [0, 0, 0, 1])]))
    c.delete(["b", "nobody"])
    assert c.seal() == 1
    assert c.list_ids() == (["10", "a"], False) and c.list_ids("10", 1) == (["a"], False)
    found, plan = c.search([1, 0, 0, 0], k=5, oversearch=2.0, rerank=True)
    got = {r["id"]: r["score"] for r in found.collect()}
    assert set(got) == {"10", "a"} and got["a"] == 0.0 and plan.reranked  # the stale copy of a never wins
    assert c.stats()["live_count"] == 2
    assert c.compact() == 2 and c.stats()["physical_count"] == 2
    again = Engine(spark, engine.root).collection("docs")
    assert again.list_ids()[0] == ["10", "a"]
    engine.drop("docs")
    with pytest.raises(NotFound):
        engine.collection("docs")
    assert engine.create(Config("docs", 4)).list_ids()[0] == []


def test_sealed_recall_and_metadata(spark, engine):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = engine.create(Config("many", 32))
    rows = spark.createDataFrame([(f"v{i:03d}", v.tolist(), {"k": str(i % 2)}) for i, v in enumerate(x)], "id string, values array<float>, metadata map<string,string>")
    c.upsert(rows)
    c.seal()
    asked = spark.createDataFrame([(str(i), x[i].tolist()) for i in range(10)], "query_id string, values array<double>")
    truth = np.argsort(-(x[:10] @ x.T), axis=1)[:, :10]
    found = c.search(asked, k=10, oversearch=2.0, rerank=True)[0].collect()
    hits = sum(f"v{j:03d}" in {r["id"] for r in found if r["query_id"] == str(i)} for i in range(10) for j in truth[i])
    assert hits >= 95 and all("k" in r["metadata"] for r in found)


def test_tensor_files(spark, tmp_path):
    gguf.register(spark)
    x = (np.arange(20, dtype=np.float32) % 7).reshape(5, 4)
    path, target = str(tmp_path / "a.safetensors"), str(tmp_path / "a.gguf")
    safetensors.write(path, {"embeddings": x}, {"ids": "a\nb"})
    got = spark.read.format("safetensors").option("rowsPerPartition", "2").load(path).orderBy("row").collect()
    assert [r["values"] for r in got] == x.tolist()
    gguf.convert(path, target)
    got = spark.read.format("gguf").option("tensor", "embeddings").load(target).orderBy("row").collect()
    assert [r["values"] for r in got] == x.tolist()
    assert {r["name"] for r in spark.read.format("gguf").option("mode", "inspect").load(target).collect()} >= {"embeddings", "safetensors.ids"}
    q8 = np.float16(0.5).tobytes() + np.arange(32, dtype=np.int8).tobytes()
    assert gguf.dequantize(q8, 8).tolist() == [0.5 * i for i in range(32)]
    assert not gguf.dequantize(np.float16(1).tobytes() + b"\x88" * 16, 2).any()
    frame = spark.createDataFrame([(f"n{i}", v.tolist()) for i, v in enumerate(x)], "id string, values array<float>").repartitionByRange(3, "id").sortWithinPartitions("id")
    out = str(tmp_path / "out.safetensors")
    frame.write.format("safetensors").mode("append").save(out)
    assert [r["values"] for r in spark.read.format("safetensors").load(out).orderBy("row").collect()] == x.tolist()
    assert safetensors.read_header(out)[1] == {"ids": "n0\nn1\nn2\nn3\nn4"}
    with pytest.raises(Exception, match="out.safetensors"):
        frame.write.format("safetensors").mode("append").save(out)
    for kind in ("F32", "F16"):
        frame.write.format("gguf").option("tensor", "t").option("dtype", kind).mode("overwrite").save(out := str(tmp_path / "out.gguf"))
        assert [r["values"] for r in spark.read.format("gguf").option("tensor", "t").load(out).orderBy("row").collect()] == x.tolist()
    uneven = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "values array<float>")
    with pytest.raises(Exception, match="same number"):
        uneven.coalesce(1).write.format("safetensors").mode("overwrite").save(str(tmp_path / "uneven.safetensors"))
    assert not [p for p in tmp_path.iterdir() if "parts" in p.name or "uneven" in p.name]
    for bits in range(1, 9):
        codes = np.random.default_rng(bits).integers(0, 1 << bits, (3, 32))
        raw = gguf.encode_blocks(np.array([1, 0.5, 0]), np.array([7, 0, 65535]), codes, bits)
        norms, offsets, back = gguf.decode_blocks(raw, bits)
        assert len(raw) == 3 * gguf.block_bytes(bits) and norms.tolist() == [1, 0.5, 0] and offsets.tolist() == [7, 0, 65535] and (back == codes).all()
    raw = open(path, "rb").read()
    for broken in (raw[:4], raw[:-1], b"\xff" * 8 + raw[8:], raw[:8] + b"x" + raw[9:]):
        (tmp_path / "b.safetensors").write_bytes(broken)
        with pytest.raises(CorruptFile):
            safetensors.read_header(str(tmp_path / "b.safetensors"))
    (tmp_path / "b.gguf").write_bytes(b"GGUF" + (3).to_bytes(4, "little") + (1 << 60).to_bytes(8, "little") + bytes(8))
    with pytest.raises(CorruptFile):
        gguf.read_header(str(tmp_path / "b.gguf"))


DOCS = cdc.Mapping("public.documents", "docs", "doc_id", "vector", "deleted_at IS NULL")


def events(spark, rows):
    return spark.createDataFrame([(o, "public.documents", lsn, s, r, old) for o, lsn, s, r, old in rows], cdc.EVENT)


def test_change_capture(spark, engine, tmp_path):
    c = engine.create(Config("docs", 3))
    first = events(spark, [
        ("insert", 1, 0, {"doc_id": "d1", "vector": "[0.5, -1.25, 2]"}, None), ("insert", 1, 1, {"doc_id": "d2", "vector": "{1, 2, 3}"}, None),
        ("insert", 1, 2, {"doc_id": "d3", "vector": "[1,x]"}, None), ("insert", 1, 3, {"doc_id": "d4", "vector": "[1,2,3]", "deleted_at": "now"}, None),
    ])
    assert {r["id"]: r["error"] for r in cdc.transform(first, [DOCS]).where("op = 'error'").collect()} == {"d3": "bad vector"}
    cdc.apply_batch(first, [DOCS], {"docs": c})
    cdc.apply_batch(first, [DOCS], {"docs": c})
    assert c.list_ids()[0] == ["d1", "d2"]
    second = events(spark, [
        ("update", 2, 0, {"doc_id": "d1", "note": "no vector"}, None), ("update", 2, 1, {"doc_id": "d9", "vector": "[7,7,7]"}, {"doc_id": "d2"}),
    ])
    cdc.apply_batch(second, [DOCS], {"docs": c})
    assert {r["id"]: r["values"] for r in c.snapshot().collect()} == {"d1": [0.5, -1.25, 2.0], "d9": [7.0, 7.0, 7.0]}
    second.write.parquet(f"{tmp_path}/feed/1")
    events(spark, [("truncate", 3, 0, None, None), ("insert", 4, 0, {"doc_id": "n", "vector": "[1,1,1]"}, None)]).write.parquet(f"{tmp_path}/feed/2")
    feed = spark.readStream.schema(cdc.EVENT).parquet(f"{tmp_path}/feed/*")
    cdc.stream(feed, [DOCS], {"docs": c}, f"{tmp_path}/check", once=True).awaitTermination()
    assert c.list_ids()[0] == ["n"]
    source = spark.createDataFrame([("n", "[1,1,1]", None), ("m", "[2,2,2]", None), ("bad", "[", None), ("off", "[1,1,1]", "x")], "doc_id string, vector string, deleted_at string")
    found = {(r["id"], r["kind"]) for r in cdc.reconcile(source, c.ids(), DOCS).collect()}
    assert found == {("m", "missing"), ("bad", "malformed")}
    assert cdc.repair(source, c, DOCS) == 1 and c.list_ids()[0] == ["m", "n"]


def test_percentiles_narrow_to_the_exact_value(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "RANKED", 50)
    rng = np.random.default_rng(4)
    tied = np.concatenate((rng.normal(size=1500), np.full(1500, 0.25)))
    for x in (rng.normal(size=3000), tied, np.full(300, 2.0), np.repeat([1.0, 2.0], 150)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        at = [0.0, 0.25, 0.5, 0.95, 1.0]
        want = {p: float(np.sort(x)[int((len(x) - 1) * p + 0.5)]) for p in at}
        assert {r["p"]: r["value"] for r in evaluate.percentiles(df, "v", at).collect()} == want
    assert evaluate.percentiles(df.where("v > 99"), "v", [0.5]).count() == 0


def test_attention_over_codes(spark):
    x = np.random.default_rng(6).standard_normal((40, 16)).astype(np.float32)
    config = attention.CacheConfig(16, 4, 5)
    cache = spark.createDataFrame([(i % 2, i, v.tolist(), (2 * v).tolist()) for i, v in enumerate(x)], "sequence int, position int, key array<float>, value array<float>")
    asked = spark.createDataFrame([(0, x[0].tolist()), (1, x[1].tolist()), (2, x[2].tolist())], "sequence int, query array<float>")
    got = {r["sequence"]: r["output"] for r in attention.attention(attention.encode(cache, config), asked, config).collect()}
    assert sorted(got) == [0, 1] and config.code_bytes(10) == (80, 100)
    for s in (0, 1):
        k, v = (q.decode(*q.encode(y[s::2].astype(np.float64))) for q, y in ((config.keys, x), (config.values, 2 * x)))
        w = np.exp(k @ x[s].astype(np.float64) / 4)
        assert np.allclose(got[s], w @ v / w.sum())
    with pytest.raises(InvalidArgument):
        attention.CacheConfig(16, 9)


def test_rerank_joins_by_shuffle_beyond_the_bound(spark, monkeypatch):
    rows = vectors(spark, [(str(i), [i, 1, 0]) for i in range(30)])
    asked = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [-1.0, 0.0, 0.0])], "query_id string, values array<double>")
    found = search.exact(rows, asked, 3, 8)
    before = search.rerank(found, rows, asked, 3, 8).collect()
    monkeypatch.setattr(search, "MAX_SENT_ROWS", 0)
    assert search.rerank(found, rows, asked, 3, 8).collect() == before and [r["id"] for r in before if r["query_id"] == "a"] == ["29", "28", "27"]
