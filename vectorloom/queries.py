"""The engine's own queries over the test tables, each with the SQL that gives the same rows.

Constants (centroids, signs) are put into the SQL as values: it checks the operators, and unit tests the constants.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.errors import AlreadyExists
from vectorloom.functions import columns as C
from vectorloom.functions.quantize import ProdQuantizer, Quantizer, gaussian
from vectorloom.functions.rotation import signs
from vectorloom.operators import attention, evaluate, search
from vectorloom.operators.collection import Collection, Config, Engine
from vectorloom.plans import filters
from vectorloom.runtime import Scratch, ship
from vectorloom.sources import gguf, safetensors
from vectorloom.streaming import cdc

DIM, SEED = 64, 42
Q4 = Quantizer(DIM, 4, SEED)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"), "vec_id", "label")


def _asked(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("query_id"), "values")


def _score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def exact_topk_batch(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _score(search.exact(r, _asked(r), DIM, 10))


def exact_topk_single(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _score(search.exact_sql(r, [1.0 if i % 2 else -1.0 for i in range(DIM)], 10))


def vec_norm(spark, sf_dir):
    return _rows(spark, sf_dir).select("vec_id", F.round(C.norm(F.col("values")), 6).alias("norm"))


def vec_normalize(spark, sf_dir):
    r = _rows(spark, sf_dir).withColumn("values", F.transform("values", lambda x: x * 3))
    return r.select("vec_id", F.posexplode(C.normalize(F.col("values"))).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


def vec_validate(spark, sf_dir):
    k = F.col("vec_id") % 5
    dirty = F.when(k == 0, F.lit(None)).when(k == 1, F.slice("values", 1, DIM - 1)).when(k == 2, F.transform("values", lambda x: F.lit(float("nan")))).otherwise(F.col("values"))
    r = _rows(spark, sf_dir).withColumn("values", dirty)
    return r.groupBy(F.coalesce(C.problem(F.col("values"), DIM), F.lit("good")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def rotate_fwht(spark, sf_dir):
    r = _rows(spark, sf_dir).select("vec_id", F.posexplode(C.rotate(DIM, SEED)("values")).alias("i", "y"))
    return r.select("vec_id", "i", F.round("y", 6).alias("y"))


def rotate_roundtrip(spark, sf_dir):
    r = _rows(spark, sf_dir).withColumn("back", C.rotate(DIM, SEED, inverse=True)(C.rotate(DIM, SEED)("values")))
    return r.select("vec_id", F.posexplode("back").alias("i", "x")).select("vec_id", "i", F.round("x", 5).alias("x"))


def mse_indices(spark, sf_dir):
    return _rows(spark, sf_dir).select("vec_id", F.posexplode(C.code_indices(Q4)("values")).alias("i", "code"))


def mse_packed_hex(spark, sf_dir):
    return _rows(spark, sf_dir).select("vec_id", F.hex(C.quantize(Q4)("values")["codes"]).alias("codes"))


def mse_reconstruct(spark, sf_dir):
    r = _rows(spark, sf_dir).withColumn("q", C.quantize(Q4)("values"))
    return r.select("vec_id", F.posexplode(C.dequantize(Q4)("q.codes", "q.norm")).alias("i", "x")).select("vec_id", "i", F.round("x", 5).alias("x"))


def mse_distortion_by_bits(spark, sf_dir):
    out = None
    for bits in (1, 2, 4):
        q = Quantizer(DIM, bits, SEED)
        r = _rows(spark, sf_dir).withColumn("q", C.quantize(q)("values")).withColumn("x", C.dequantize(q)("q.codes", "q.norm"))
        off = F.aggregate(F.zip_with("values", "x", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, d: s + d)
        one = r.agg(F.round(F.avg(off), 5).alias("mse")).select(F.lit(bits).alias("bits"), "mse")
        out = one if out is None else out.unionByName(one)
    return out


def _codes(r: DataFrame) -> DataFrame:
    return r.withColumn("q", C.quantize(Q4)("values")).select("id", "q.codes", "q.norm")


def quantized_topk_batch(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _score(search.quantized(_codes(r), _asked(r), Q4, 10))


def quantized_topk_symmetric(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _score(search.quantized(_codes(r), _asked(r), Q4, 10, query_codes=True))


def quantized_topk_rerank(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _score(search.rerank(search.quantized(_codes(r), _asked(r), Q4, 20), r, _asked(r), 10))


def recall_at_k(spark, sf_dir):
    r = _rows(spark, sf_dir)
    found = search.quantized(_codes(r), _asked(r), Q4, 10)
    return evaluate.recall(found, search.exact(r, _asked(r), DIM, 10), 10).select("query_id", F.round("recall", 6).alias("recall"))


def prod_estimate(spark, sf_dir):
    q = ProdQuantizer(DIM, 4, SEED)
    r = _rows(spark, sf_dir).withColumn("q", C.prod_quantize(q)("values"))
    return _score(search.prod(r.select("id", "q.*"), _asked(r), q, 10))


def _written(spark: SparkSession, sf_dir: str) -> Collection:
    """All vectors; a first seal; every third one negated; every seventh deleted; a second seal; every fifth negated."""
    r = _rows(spark, sf_dir)
    scratch = Scratch(spark, "engine")
    c = Engine(spark, scratch.root).create(Config("docs", DIM))
    minus = r.withColumn("values", F.transform("values", lambda x: -x))
    c.upsert(r.select("id", "values"))
    c.seal()
    c.upsert(minus.where("vec_id % 3 = 0").select("id", "values"))
    c.delete(r.where("vec_id % 7 = 0").select("id"))
    c.seal()
    c.upsert(minus.where("vec_id % 5 = 0").select("id", "values"))
    return c


def upsert_latest(spark, sf_dir):
    return _written(spark, sf_dir).snapshot().select("id", F.round(F.col("values")[0], 6).cast("double").alias("x0"))


def snapshot_ids(spark, sf_dir):
    return _written(spark, sf_dir).ids()


def ids_page(spark, sf_dir):
    page, more = _written(spark, sf_dir).list_ids("2", 25)
    return spark.createDataFrame([(i, more) for i in page], "id string, more boolean")


def collection_stats(spark, sf_dir):
    s = _written(spark, sf_dir).stats()
    return spark.createDataFrame([(s["live_count"], s["sealed_count"], s["segments"])], "live_count long, sealed_count long, segments long")


def topk_with_tombstones(spark, sf_dir):
    r = _rows(spark, sf_dir)
    found, _ = _written(spark, sf_dir).search(_asked(r), k=5, exact=True)
    return found.select("query_id", "rank", "id", F.round(F.col("score").cast("double"), 5).alias("score"))


_MAPPING = cdc.Mapping("public.documents", "docs", "doc_id", "vector", "deleted_at IS NULL AND lang != 'fr'")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change feed from documents: one event a row, 200 ids."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id")
    op = F.when(k % 6 == 5, "delete").when(k % 2 == 0, "insert").otherwise("update")
    vector = F.when(k % 11 == 0, "[1,x]").otherwise(F.concat(F.lit("["), (k % 13).cast("string"), F.lit(", "), (k % 17).cast("string"), F.lit(".5]")))
    gone = F.when(k % 9 == 0, "2024-01-01")
    row = F.create_map(F.lit("doc_id"), (k % 200).cast("string"), F.lit("vector"), vector, F.lit("lang"), F.col("lang"), F.lit("deleted_at"), gone)
    return d.select(op.alias("op"), F.lit("public.documents").alias("table"), (k + 1).alias("lsn"), F.lit(0).alias("seq"), row.alias("row"))


def cdc_transform(spark, sf_dir):
    t = cdc.transform(_events(spark, sf_dir), [_MAPPING])
    return t.select("lsn", "op", "id", F.col("values")[0].cast("double").alias("x0"), F.col("values")[1].cast("double").alias("x1"), "error")


def cdc_net_ops(spark, sf_dir):
    t = cdc.net_ops(cdc.transform(_events(spark, sf_dir), [_MAPPING]))
    return t.select("id", "op", "lsn", F.col("values")[0].cast("double").alias("x0"), F.col("values")[1].cast("double").alias("x1"))


def filter_dsl(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    p = filters.predicate("lang != 'fr' AND quality = 1 AND toxic <> 1 AND nothing IS NULL", dict(d.dtypes))
    return d.where(p).select("doc_id", "lang")


def reconcile_diff(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id")
    source = d.where("doc_id % 4 <> 0").select(k, F.when(k % 11 == 0, "[").otherwise("[1,2]").alias("vector"), F.when(k % 9 == 0, "x").alias("deleted_at"), "lang")
    return cdc.reconcile(source, d.where("doc_id % 5 <> 0").select(k.cast("string").alias("id")), _MAPPING)


def reconcile_summary(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = d.where("doc_id % 4 <> 0").count()
    return cdc.reconcile_summary(n, d.where("doc_id % 5 <> 0").count(), reconcile_diff(spark, sf_dir))


def parse_vector_text(spark, sf_dir):
    e = _events(spark, sf_dir).select("lsn", C.parse_vector(F.col("row")["vector"]).alias("v"))
    return e.select("lsn", F.when(F.col("v").isNotNull(), F.size("v")).alias("n"), F.col("v")[1].cast("double").alias("x1"))


def id_coercion(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_id") % 2 == 0, F.concat(F.col("event_id").cast("string"), F.lit(".0"))).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    return e.select("event_id", C.id_text(value).alias("id"))


def segment_size_estimate(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", C.segment_bytes(F.col("n"), DIM, 4).alias("bytes"))


def latency_percentiles(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return evaluate.percentiles(e, "value", [0.5, 0.95, 0.99])


def latency_report(spark, sf_dir):
    return evaluate.latency_report(spark.read.parquet(f"{sf_dir}/events.parquet"), "value").withColumn("mean", F.round("mean", 6))


def kv_attention(spark, sf_dir):
    """Each label's vectors as the keys and values of a sequence, its first vector as the query."""
    r = _rows(spark, sf_dir).withColumnRenamed("label", "sequence")
    config = attention.CacheConfig(DIM, 4, 4, seed=SEED)
    coded = attention.encode(r.select("sequence", F.col("vec_id").alias("position"), F.col("values").alias("key"), F.col("values").alias("value")), config)
    asked = r.groupBy("sequence").agg(F.min_by("values", "vec_id").alias("query"))
    out = attention.attention(coded, asked, config).select("sequence", F.posexplode("output").alias("i", "x"))
    return out.select("sequence", "i", F.round("x", 6).alias("x"))


def search_join_labels(spark, sf_dir):
    r = _rows(spark, sf_dir)
    found = search.exact(r, _asked(r), DIM, 10)
    both = found.join(r.select("id", F.col("label").alias("found_label")), "id").join(r.select(F.col("id").alias("query_id"), "label"), "query_id")
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == F.col("found_label")).cast("long")).alias("same"))


def _change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_events`` in two dimensions, with some vectors of three and some updates without one."""
    k = F.col("lsn") - 1
    row = F.when(k % 19 == 0, F.map_concat(F.map_filter("row", lambda n, _: n != "vector"), F.create_map(F.lit("vector"), F.lit("[1,2,3]"))))
    row = row.when((k % 23 == 0) & (F.col("op") == "update"), F.map_filter("row", lambda n, _: n != "vector")).otherwise(F.col("row"))
    return _events(spark, sf_dir).withColumn("row", row)


def _applied(spark: SparkSession, sf_dir: str, parts: list[str]) -> tuple[Collection, list[DataFrame]]:
    scratch, dead = Scratch(spark, "engine"), []
    c = Engine(spark, scratch.root).create(Config("docs", 2))
    feed = _change_feed(spark, sf_dir)
    for part in parts:
        cdc.apply_batch(feed.where(part), [_MAPPING], {"docs": c}, lambda df: dead.append(scratch.keep(df, "dead")))
    return c, dead


def _shown(c: Collection) -> DataFrame:
    return c.snapshot().select("id", F.col("values")[0].cast("double").alias("x0"), F.col("values")[1].cast("double").alias("x1"))


def cdc_apply(spark, sf_dir):
    return _shown(_applied(spark, sf_dir, ["true"])[0])


def cdc_redelivery(spark, sf_dir):
    """The same feed: late halves, and everything again."""
    return _shown(_applied(spark, sf_dir, ["lsn % 2 = 0 and lsn % 23 <> 1", "lsn % 23 = 1 or lsn % 2 = 1", "true"])[0])


def cdc_dead_letters(spark, sf_dir):
    _, dead = _applied(spark, sf_dir, ["true"])
    return dead[0].where("error <> 'no vector known'").select("lsn", "id", "error")


def cdc_repair(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id")
    c = Engine(spark, Scratch(spark, "engine").root).create(Config("docs", 2))
    c.upsert(d.where("doc_id % 5 <> 0").select(k.cast("string").alias("id"), F.array(F.lit(9.0), k.cast("double")).alias("values")))
    source = d.where("doc_id % 4 <> 0").select(k, F.when(k % 11 == 0, "[").otherwise(F.concat(F.lit("[1,"), k.cast("string"), F.lit("]"))).alias("vector"), F.when(k % 9 == 0, "x").alias("deleted_at"), "lang")
    cdc.repair(source, c, _MAPPING)
    return _shown(c)


def _tagged(spark: SparkSession, sf_dir: str, **more) -> Collection:
    """All vectors with their label as metadata, sealed."""
    c = Engine(spark, Scratch(spark, "engine").root).create(Config("tagged", DIM, **more))
    c.upsert(_rows(spark, sf_dir).select("id", "values", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata")))
    c.seal()
    return c


def metadata_filter(spark, sf_dir):
    asked = _asked(_rows(spark, sf_dir).where("vec_id % 50 = 0"))
    found, _ = _tagged(spark, sf_dir).search(asked, k=5, where="cast(metadata['label'] AS int) % 2 = 0", exact=True)
    return found.select("query_id", "rank", "id", F.col("metadata")["label"].alias("label"))


def reconstruct_sealed(spark, sf_dir):
    r = _tagged(spark, sf_dir, retain_raw=False).reconstruct()
    return r.select(F.col("id").cast("long").alias("vec_id"), F.posexplode("values").alias("i", "x")).select("vec_id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def compact_live(spark, sf_dir):
    c = _written(spark, sf_dir)
    n = c.compact()
    s = c.stats()
    return spark.createDataFrame([(n, s["live_count"], s["physical_count"], s["tombstones"], s["segments"])], "rows long, live_count long, physical_count long, tombstones long, segments long")


def strict_insert(spark, sf_dir):
    """Whether a strict insert of known, of new and of repeated ids was refused, and how many rows there are after."""
    c, r = _tagged(spark, sf_dir), _rows(spark, sf_dir).select("id", "values")
    new = r.withColumn("id", F.concat(F.lit("n"), F.col("id")))
    out = []
    for name, rows in (("known", r), ("new", new), ("repeated", new.unionByName(new).withColumn("id", F.concat(F.lit("r"), F.col("id"))))):
        try:
            c.upsert(rows, strict=True)
            out.append((name, False, c.stats()["live_count"]))
        except AlreadyExists:
            out.append((name, True, c.stats()["live_count"]))
    return spark.createDataFrame(out, "case string, refused boolean, live_count long")


def describe_collections(spark, sf_dir):
    e = _written(spark, sf_dir).engine
    e.create(Config("empty", 3, bit_width=2))
    return e.describe().join(spark.createDataFrame([(e.stats()["segments_active"], e.stats()["segments_sealed_total"])], "segments_active int, segments_sealed_total int"))


def value_histogram(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    return e.groupBy(evaluate.histogram_bucket(F.col("value"), 1.0, 12).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def latency_qps(spark, sf_dir):
    out = evaluate.throughput(spark.read.parquet(f"{sf_dir}/events.parquet"), "value")
    return out.select("n", F.round("total_seconds", 4).alias("total_seconds"), F.round("qps", 4).alias("qps"))


def _tensor_path(spark: SparkSession, name: str) -> str:
    """A plain path in the shared folder, which the tensor formats need."""
    root = Scratch(spark, "tensors").root.removeprefix("file://").removeprefix("file:")
    os.makedirs(root, exist_ok=True)
    return f"{root}/{name}"


def _exported(spark: SparkSession, sf_dir: str) -> str:
    gguf.register(spark)
    path = _tensor_path(spark, "all.safetensors")
    safetensors.export_collection(_tagged(spark, sf_dir), path)
    return path


def _first_numbers(df: DataFrame) -> DataFrame:
    return df.select("row", F.size("values").alias("dim"), F.round(F.col("values")[0].cast("double"), 6).alias("x0"), F.round(F.col("values")[DIM - 1].cast("double"), 6).alias("x_last"))


def safetensors_roundtrip(spark, sf_dir):
    return _first_numbers(spark.read.format("safetensors").load(_exported(spark, sf_dir)))


def tensor_convert(spark, sf_dir):
    path = _exported(spark, sf_dir)
    gguf.convert(path, path + ".gguf")
    return _first_numbers(spark.read.format("gguf").option("tensor", "vectors").load(path + ".gguf"))


def tensor_inspect(spark, sf_dir):
    got = spark.read.format("safetensors").option("mode", "inspect").load(_exported(spark, sf_dir))
    return got.select("name", "dtype", F.concat_ws("x", F.transform("shape", lambda x: x.cast("string"))).alias("shape"), F.when(F.col("name") != "ids", F.col("value")).alias("value"))


def tensor_import(spark, sf_dir):
    path = _exported(spark, sf_dir)
    e = Engine(spark, Scratch(spark, "engine").root)
    safetensors.import_collection(e, path, Config("back", DIM), "row-")
    return e.collection("back").snapshot().select("id", F.round(F.col("values")[0].cast("double"), 6).alias("x0"))


def search_in_blocks(spark, sf_dir):
    r = _rows(spark, sf_dir)
    met = search._met_in_blocks(r.select("id", "values"), _asked(r), DIM, 10, lambda q: q, search.raw_numbers(DIM))
    return _score(search.merge(met, 10))


def topk_sql_function(spark, sf_dir):
    _tagged(spark, sf_dir).table_function("tagged_rows")
    query = ", ".join("1D" if i % 2 else "-1D" for i in range(DIM))
    return spark.sql(f"SELECT id, round(s, 6) AS score FROM (SELECT id, tagged_rows_score(values, array({query})) AS s FROM tagged_rows) ORDER BY s DESC, id LIMIT 10")


_OWN = [
    exact_topk_batch, exact_topk_single, vec_norm, vec_normalize, vec_validate, rotate_fwht, rotate_roundtrip, mse_indices, mse_packed_hex, mse_reconstruct, mse_distortion_by_bits,
    quantized_topk_batch, quantized_topk_symmetric, quantized_topk_rerank, recall_at_k, prod_estimate, upsert_latest, snapshot_ids, ids_page, collection_stats, topk_with_tombstones,
    cdc_transform, cdc_net_ops, filter_dsl, reconcile_diff, reconcile_summary, parse_vector_text, id_coercion, segment_size_estimate, latency_percentiles, latency_report, kv_attention, search_join_labels,
    cdc_apply, cdc_redelivery, cdc_dead_letters, cdc_repair, metadata_filter, reconstruct_sealed, compact_live, strict_insert, describe_collections, value_histogram, latency_qps,
    safetensors_roundtrip, tensor_convert, tensor_inspect, tensor_import, search_in_blocks, topk_sql_function,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OWN}


def _values(name: str, numbers) -> str:
    return f"{name}(i, v) AS (VALUES " + ", ".join(f"({i}, {float(x)!r}::DOUBLE)" for i, x in enumerate(numbers)) + ")"


def _base() -> str:
    first, second = signs(SEED, DIM)
    return f"""s1 AS (SELECT * FROM (VALUES {", ".join(f"({i}, {x})" for i, x in enumerate(first))}) t(i, v)),
s2 AS (SELECT * FROM (VALUES {", ".join(f"({i}, {x})" for i, x in enumerate(second))}) t(i, v)),
x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
nrm AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM x GROUP BY vec_id)"""


def _rotated(unit: bool) -> str:
    scale = " / n" if unit else ""
    return f"""y AS (SELECT x.vec_id, s2.i, sum(x.x{scale} * s1.v * CASE WHEN bit_count(x.i & s2.i) % 2 = 0 THEN 1 ELSE -1 END) * any_value(s2.v) / 8 AS y
  FROM x JOIN nrm USING (vec_id) JOIN s1 ON s1.i = x.i CROSS JOIN s2 GROUP BY x.vec_id, s2.i)"""


def _coded(bits: int, tag: str = "") -> str:
    c = Quantizer(DIM, bits, SEED).centroids
    edges = [(a + b) / 2 for a, b in zip(c[1:], c[:-1], strict=True)]
    code = " + ".join(f"(y > {float(e)!r})::INT" for e in edges)
    listed = ", ".join(repr(float(v)) for v in c)
    return f"""code{tag} AS (SELECT vec_id, i, {code} AS code FROM y),
r{tag} AS (SELECT c.vec_id, s1.i, sum(([{listed}])[c.code + 1] * s2.v * CASE WHEN bit_count(c.i & s1.i) % 2 = 0 THEN 1 ELSE -1 END) * any_value(s1.v) / 8 * any_value(n::FLOAT) AS x
  FROM code{tag} c JOIN nrm USING (vec_id) JOIN s2 ON s2.i = c.i CROSS JOIN s1 GROUP BY c.vec_id, s1.i)"""


def _topk(left: str, right: str, k: int, name: str) -> str:
    """Scores of all pairs of two tables (vec_id, v) and the best k."""
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.vec_id::VARCHAR AS query_id, d.vec_id::VARCHAR AS id, list_dot_product(q.v, d.v) AS score FROM {left} q CROSS JOIN {right} d)) WHERE rank <= {k})"""


def _projected() -> str:
    """dp: reconstruction with the scaled signs of the residual's projection; qp: vector with its projection."""
    g = gaussian(SEED + 1, DIM, DIM)
    listed = ", ".join(f"({j}, {i}, {float(g[j, i])!r}::DOUBLE)" for j in range(DIM) for i in range(DIM))
    return f"""g(j, i, g) AS (VALUES {listed}),
rest AS (SELECT vec_id, i, x.x - r.x AS d, x.x AS x FROM x JOIN r USING (vec_id, i)), size AS (SELECT vec_id, sqrt(sum(d * d))::FLOAT::DOUBLE AS size FROM rest GROUP BY vec_id),
pr AS (SELECT vec_id, j, sum(d * g) AS d, sum(x * g) AS x FROM rest JOIN g USING (i) GROUP BY vec_id, j),
pl AS (SELECT vec_id, list(CASE WHEN d >= 0 THEN 1 ELSE -1 END * sqrt(pi() / 2) / {DIM} * size ORDER BY j) AS s, list(x ORDER BY j) AS p FROM pr JOIN size USING (vec_id) GROUP BY vec_id),
dp AS (SELECT vec_id, list_concat(v, s) AS v FROM rec JOIN pl USING (vec_id)), qp AS (SELECT vec_id, list_concat(v, p) AS v FROM raw JOIN pl USING (vec_id))"""


_RAW = "raw AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
_REC = "rec AS (SELECT vec_id, list(x ORDER BY i) AS v FROM r GROUP BY vec_id)"
_SHOWN = "SELECT query_id, rank::INTEGER AS rank, id, round(score, 6) AS score FROM"
_LIVE = """live AS (SELECT vec_id, vec_id::VARCHAR AS id, CASE WHEN vec_id % 5 = 0 OR vec_id % 3 = 0 THEN -1 ELSE 1 END AS s, embedding FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 5 = 0)"""
_EVENTS = """ev AS (SELECT doc_id AS k, doc_id + 1 AS lsn, CASE WHEN doc_id % 6 = 5 THEN 'delete' WHEN doc_id % 2 = 0 THEN 'insert' ELSE 'update' END AS o,
  (doc_id % 200)::VARCHAR AS id, doc_id % 11 = 0 AS bad, doc_id % 9 <> 0 AND lang IS NOT NULL AND lang <> 'fr' AS pass FROM documents),
t AS (SELECT lsn, id, CASE WHEN o = 'delete' THEN 'delete' WHEN NOT pass THEN CASE WHEN o = 'update' THEN 'delete' END WHEN bad THEN 'error' ELSE 'upsert' END AS op,
  CASE WHEN NOT bad THEN (k % 13)::DOUBLE END AS x0, CASE WHEN NOT bad THEN k % 17 + 0.5::DOUBLE END AS x1 FROM ev)"""


def oracle_sql() -> dict[str, str]:
    base = _base()
    coded = f"WITH {base}, {_rotated(True)}, {_coded(4)}"
    single = ", ".join("1.0" if i % 2 else "-1.0" for i in range(DIM))
    best = f"{_RAW}, {_REC}"
    out = {
        "exact_topk_batch": f"WITH {_RAW}, {_topk('raw', 'raw', 10, 'f')} {_SHOWN} f",
        "exact_topk_single": f"WITH {_RAW} SELECT vec_id::VARCHAR AS id, round(list_dot_product(v, [{single}]::DOUBLE[]), 6) AS score FROM raw ORDER BY list_dot_product(v, [{single}]::DOUBLE[]) DESC, id LIMIT 10",
        "vec_norm": f"WITH {base} SELECT vec_id, round(n, 6) AS norm FROM nrm",
        "vec_normalize": f"WITH {base} SELECT vec_id, i::INTEGER AS i, round(x / n, 6) AS x FROM x JOIN nrm USING (vec_id)",
        "vec_validate": "SELECT CASE vec_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'dim' WHEN 2 THEN 'not finite' ELSE 'good' END AS problem, count(*) AS n FROM embeddings GROUP BY 1",
        "rotate_fwht": f"WITH {base}, {_rotated(False)} SELECT vec_id, i::INTEGER AS i, round(y, 6) AS y FROM y",
        "rotate_roundtrip": f"WITH {base} SELECT vec_id, i::INTEGER AS i, round(x, 5) AS x FROM x",
        "mse_indices": f"{coded} SELECT vec_id, i::INTEGER AS i, code::INTEGER AS code FROM code",
        "mse_packed_hex": f"{coded} SELECT vec_id, string_agg(printf('%X', code), '' ORDER BY i // 2, -i) AS codes FROM code GROUP BY vec_id",
        "mse_reconstruct": f"{coded} SELECT vec_id, i::INTEGER AS i, round(x, 5) AS x FROM r",
        "mse_distortion_by_bits": f"WITH {base}, {_rotated(True)}, " + ", ".join(_coded(b, f"_{b}") for b in (1, 2, 4)) + " " + " UNION ALL ".join(
            f"SELECT {b}::INTEGER AS bits, round(sum((x.x - r_{b}.x) * (x.x - r_{b}.x)) / count(DISTINCT vec_id), 5) AS mse FROM x JOIN r_{b} USING (vec_id, i)" for b in (1, 2, 4)),
        "quantized_topk_batch": f"{coded}, {best}, {_topk('raw', 'rec', 10, 'f')} {_SHOWN} f",
        "quantized_topk_symmetric": f"{coded}, {best}, {_topk('rec', 'rec', 10, 'f')} {_SHOWN} f",
        "quantized_topk_rerank": f"""{coded}, {best}, {_topk('raw', 'rec', 20, 'f')} {_SHOWN} (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, list_dot_product(a.v, b.v) AS score FROM f JOIN raw a ON a.vec_id = query_id::BIGINT JOIN raw b ON b.vec_id = id::BIGINT)) WHERE rank <= 10""",
        "recall_at_k": f"{coded}, {best}, {_topk('raw', 'rec', 10, 'f')}, {_topk('raw', 'raw', 10, 'e')} SELECT query_id, round(count(f.id) / count(*), 6) AS recall FROM e LEFT JOIN f USING (query_id, id) GROUP BY query_id",
        "upsert_latest": f"WITH {_LIVE} SELECT id, round((s * embedding[1])::FLOAT, 6)::DOUBLE AS x0 FROM live",
        "snapshot_ids": f"WITH {_LIVE} SELECT id FROM live",
        "ids_page": f"WITH {_LIVE}, p AS (SELECT id FROM live WHERE id > '2' ORDER BY id LIMIT 26) SELECT id, (SELECT count(*) > 25 FROM p) AS more FROM p ORDER BY id LIMIT 25",
        "collection_stats": f"WITH {_LIVE} SELECT count(*) AS live_count, count(*) FILTER (vec_id % 5 <> 0) AS sealed_count, 2::BIGINT AS segments FROM live",
        "topk_with_tombstones": f"WITH {_RAW}, {_LIVE}, lv AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * s) AS v FROM live), {_topk('raw', 'lv', 5, 'f')} SELECT query_id, rank::INTEGER AS rank, id, round(score::FLOAT::DOUBLE, 5) AS score FROM f",
        "cdc_transform": f"WITH {_EVENTS} SELECT lsn, op, id, x0, x1, CASE WHEN op = 'error' THEN 'bad vector' END AS error FROM t WHERE op IS NOT NULL",
        "cdc_net_ops": f"WITH {_EVENTS} SELECT id, op, lsn, CASE WHEN op = 'upsert' THEN x0 END AS x0, CASE WHEN op = 'upsert' THEN x1 END AS x1 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS n FROM t WHERE op IN ('upsert', 'delete')) WHERE n = 1",
        "filter_dsl": "SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE lang <> 'fr' AND quality = 1 AND toxic <> 1",
        "parse_vector_text": f"WITH {_EVENTS} SELECT lsn, CASE WHEN NOT bad THEN 2 END::INTEGER AS n, CASE WHEN NOT bad THEN k % 17 + 0.5::DOUBLE END AS x1 FROM ev",
        "id_coercion": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE event_id::VARCHAR || '.5' END AS id FROM events",
        "segment_size_estimate": "SELECT label, (count(*) * (32 + 4 + 24))::BIGINT AS bytes FROM embeddings GROUP BY label",
        "latency_percentiles": """WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place FROM events WHERE value IS NOT NULL), n AS (SELECT count(*) AS n FROM r)
SELECT p, value FROM r, n, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) t(p) WHERE place = floor((n - 1) * p + 0.5)""",
        "latency_report": """WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) FILTER (place = floor((n - 1) * 0.5 + 0.5)) AS p50, max(value) FILTER (place = floor((n - 1) * 0.95 + 0.5)) AS p95,
  max(value) FILTER (place = floor((n - 1) * 0.99 + 0.5)) AS p99, max(value) AS max FROM r""",
        "kv_attention": f"""{coded}, {best}, q AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings GROUP BY label),
w AS (SELECT vec_id, label, exp(list_dot_product(v, q) / 8) AS w FROM rec JOIN embeddings USING (vec_id) JOIN q USING (label))
SELECT label AS sequence, i::INTEGER AS i, round(sum(w * x) / sum(w), 6) AS x FROM w JOIN r USING (vec_id) GROUP BY label, i""",
        "prod_estimate": f"WITH {base}, {_rotated(True)}, {_coded(3)}, {_REC}, {_RAW}, {_projected()}, {_topk('qp', 'dp', 10, 'f')} {_SHOWN} f",
        "search_join_labels": f"WITH {_RAW}, {_topk('raw', 'raw', 10, 'f')} SELECT q.label, count(*) AS n, sum((q.label = d.label)::BIGINT)::BIGINT AS same FROM f JOIN embeddings q ON q.vec_id = query_id::BIGINT JOIN embeddings d ON d.vec_id = id::BIGINT GROUP BY q.label",
    }
    source = """s AS (SELECT doc_id::VARCHAR AS id, doc_id % 11 <> 0 AS good FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 9 <> 0 AND lang <> 'fr'),
e AS (SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id % 5 <> 0),
d AS (SELECT coalesce(s.id, e.id) AS id, CASE WHEN s.id IS NULL THEN 'orphaned' WHEN good AND e.id IS NULL THEN 'missing' END AS kind FROM s FULL JOIN e ON s.id = e.id
  UNION ALL SELECT id, 'malformed' FROM s WHERE NOT good)"""
    out["reconcile_diff"] = f"WITH {source} SELECT id, kind FROM d WHERE kind IS NOT NULL"
    out["reconcile_summary"] = f"""WITH {source} SELECT (SELECT count(*) FROM documents WHERE doc_id % 4 <> 0) AS source_rows, (SELECT count(*) FROM e) AS engine_ids, count(*) FILTER (kind = 'missing') AS missing,
  count(*) FILTER (kind = 'orphaned') AS orphaned, count(*) FILTER (kind = 'malformed') AS malformed, count(*) FILTER (kind IN ('missing', 'orphaned')) AS discrepancies FROM d"""
    feed = """ev AS (SELECT doc_id AS k, doc_id + 1 AS lsn, CASE WHEN doc_id % 6 = 5 THEN 'delete' WHEN doc_id % 2 = 0 THEN 'insert' ELSE 'update' END AS o,
  (doc_id % 200)::VARCHAR AS id, doc_id % 9 <> 0 AND lang IS NOT NULL AND lang <> 'fr' AS pass FROM documents),
t AS (SELECT lsn, k, id, CASE WHEN o = 'delete' OR (o = 'update' AND NOT pass) THEN 'delete' WHEN NOT pass THEN 'skip' WHEN k % 19 = 0 THEN 'wrong dimension'
  WHEN k % 23 = 0 AND o = 'update' THEN 'carry' WHEN k % 11 = 0 THEN 'bad vector' ELSE 'upsert' END AS op FROM ev)"""
    state = f"""WITH {feed}, s AS (SELECT id, arg_max(k, lsn) AS k, arg_max(op, lsn) AS op FROM t WHERE op IN ('upsert', 'delete') GROUP BY id)
SELECT id, (k % 13)::DOUBLE AS x0, k % 17 + 0.5::DOUBLE AS x1 FROM s WHERE op = 'upsert'"""
    out["cdc_apply"] = out["cdc_redelivery"] = state
    out["cdc_dead_letters"] = f"WITH {feed} SELECT lsn, id, op AS error FROM t WHERE op IN ('bad vector', 'wrong dimension')"
    out["cdc_repair"] = f"""WITH {source} SELECT id, CASE WHEN e.id IS NULL THEN 1 ELSE 9 END::DOUBLE AS x0, id::DOUBLE AS x1
FROM (SELECT id, good FROM s) s FULL JOIN e USING (id) WHERE (s.id IS NOT NULL AND e.id IS NOT NULL) OR (e.id IS NULL AND good)"""
    first = "round(embedding[1]::DOUBLE, 6) AS x0"
    ranked = "(SELECT row_number() OVER (ORDER BY vec_id::VARCHAR) - 1 AS row, * FROM embeddings)"
    out |= {
        "metadata_filter": f"WITH {_RAW}, q AS (SELECT * FROM raw WHERE vec_id % 50 = 0), d AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label % 2 = 0), {_topk('q', 'd', 5, 'f')} SELECT query_id, rank::INTEGER AS rank, id, label::VARCHAR AS label FROM f JOIN embeddings ON vec_id = id::BIGINT",
        "reconstruct_sealed": f"{coded} SELECT vec_id, i::INTEGER AS i, round(x::FLOAT::DOUBLE, 5) AS x FROM r",
        "compact_live": f"WITH {_LIVE} SELECT count(*) AS rows, count(*) AS live_count, count(*) AS physical_count, 0::BIGINT AS tombstones, 1::BIGINT AS segments FROM live",
        "strict_insert": "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT c AS \"case\", c <> 'new' AS refused, CASE WHEN c = 'known' THEN n ELSE 2 * n END AS live_count FROM n, (VALUES ('known'), ('new'), ('repeated')) t(c)",
        "describe_collections": "SELECT * FROM (VALUES ('docs', 64::INTEGER, 4::INTEGER, 7::INTEGER, 2::INTEGER, 2::INTEGER, 3::INTEGER, 2::INTEGER), ('empty', 3, 2, 1, 0, 0, 3, 2)) t(name, dim, bit_width, version, segments, logs, segments_active, segments_sealed_total)",
        "value_histogram": "SELECT greatest(0, least(12, ceil(log2(value))))::INTEGER AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
        "latency_qps": "SELECT count(value) AS n, round(sum(value) / 1000, 4) AS total_seconds, round(count(value) / (sum(value) / 1000), 4) AS qps FROM events",
        "safetensors_roundtrip": f"SELECT row, 64::INTEGER AS dim, {first}, round(embedding[64]::DOUBLE, 6) AS x_last FROM {ranked}",
        "tensor_convert": f"SELECT row, 64::INTEGER AS dim, {first}, round(embedding[64]::DOUBLE, 6) AS x_last FROM {ranked}",
        "tensor_inspect": """SELECT name, dtype, shape, value FROM (VALUES ('ids', NULL, '', NULL), ('turboquant_version', NULL, '', '0.1'), ('rotator_seed', NULL, '', '42'), ('rotator_type', NULL, '', 'hadamard'),
  ('codebook_id', NULL, '', 'd64_b4_lloyd_max_v1'), ('bit_width', NULL, '', '4'), ('variant', NULL, '', 'mse')) t(name, dtype, shape, value) UNION ALL SELECT 'vectors', 'F32', count(*) || 'x64', NULL FROM embeddings""",
        "tensor_import": f"SELECT 'row-' || row AS id, {first} FROM {ranked}",
        "search_in_blocks": f"WITH {_RAW}, {_topk('raw', 'raw', 10, 'f')} {_SHOWN} f",
        "topk_sql_function": out["exact_topk_single"],
    }
    return out
