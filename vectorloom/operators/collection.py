"""Collections: a versioned manifest over Parquet, an append-only change log and sealed segments.

Single writer: a manifest ``v{n}.json`` is written whole and then named by an atomic rename, readers pin one
version. Every log row has the collection's incarnation, so a collection that is dropped and made again never
sees old rows, and the manifest holds the next sequence number. The newest change of an id decides; a seal
quantises live rows into a new segment and keeps metadata; nothing in memory is needed to reopen.

Sealed rows are never shuffled to be read: ids that the log overrides are taken out by an anti-join with the log's ids
and numbers, broadcast up to MAX_MARKS rows. Beyond, ids and numbers alone are joined, and what is dead is taken out.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.errors import AlreadyExists, InvalidArgument, NotFound
from vectorloom.functions import columns as C
from vectorloom.functions.quantize import Quantizer
from vectorloom.operators import search as S
from vectorloom.plans.options import SearchOptions, SearchPlan
from vectorloom.runtime import ship

LOG = "lsn long, seq long, op string, id string, values array<float>, metadata map<string,string>"
SEALED = "id string, codes binary, norm float, metadata map<string,string>, lsn long, seq long, values array<float>"
#: Log rows, or dead rows, whose ids may be broadcast.
MAX_MARKS = 1_000_000
_NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_-]{0,127}")


@dataclass(frozen=True)
class Config:
    name: str
    dim: int
    bit_width: int = 4
    metric: str = "inner_product"
    variant: str = "mse"
    rotator_seed: int = 42
    retain_raw: bool = True
    seal_threshold: int = 1_000_000  # unsealed rows from which a write seals; 0: never

    def __post_init__(self):
        if not _NAME.fullmatch(self.name or ""):
            raise InvalidArgument("a name has 1 to 128 letters, digits, - or _ and doesn't start with -")
        if not 1 <= self.dim <= 8192:
            raise InvalidArgument("dim from 1 to 8192")
        if not 1 <= self.bit_width <= 8:
            raise InvalidArgument("bit width from 1 to 8")
        if self.seal_threshold < 0:
            raise InvalidArgument("seal threshold from 0")
        if self.metric != "inner_product" or self.variant != "mse":
            raise InvalidArgument("metric inner_product and variant mse only")

    @property
    def quantizer(self) -> Quantizer:
        return Quantizer(self.dim, self.bit_width, self.rotator_seed)


@dataclass(frozen=True)
class Manifest:
    config: dict
    incarnation: str
    version: int = 0
    next_lsn: int = 1
    applied_lsn: int = 0
    logs: list[str] = field(default_factory=list)  # written since the last seal
    segments: list[str] = field(default_factory=list)
    applied: list[str] = field(default_factory=list)  # tables of source changes that were applied
    log_rows: int = 0  # rows of all logs, and of those the ones not sealed yet
    open_rows: int = 0
    seals: int = 0  # over the collection's life


class Engine:
    """All collections under one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        ship(spark)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        """Whole or not at all; an existing file is never replaced."""
        part = self._path(f"{path}.{uuid.uuid4().hex}")
        stream = self._fs.create(part)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(self._path(path)) or not self._fs.rename(part, self._path(path)):
            self._fs.delete(part, False)
            raise AlreadyExists(f"{path}: another writer was first")

    def _names(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def manifest(self, name: str) -> Manifest:
        versions = [int(n[1:-5]) for n in self._names(f"{self.root}/{name}") if re.fullmatch(r"v[0-9]+\.json", n)]
        if not versions:
            raise NotFound(name)
        return Manifest(**json.loads(self._read(f"{self.root}/{name}/v{max(versions)}.json")))

    def commit(self, name: str, m: Manifest) -> Manifest:
        m = replace(m, version=m.version + 1)
        self._write(f"{self.root}/{name}/v{m.version}.json", json.dumps(asdict(m)))
        return m

    def create(self, config: Config) -> Collection:
        if self._names(f"{self.root}/{config.name}"):
            raise AlreadyExists(config.name)
        self.commit(config.name, Manifest(asdict(config), uuid.uuid4().hex))
        return Collection(self, config.name)

    def collection(self, name: str) -> Collection:
        self.manifest(name)
        return Collection(self, name)

    def drop(self, name: str) -> None:
        self.manifest(name)
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def list(self) -> list[str]:
        return [n for n in self._names(self.root) if any(x.endswith(".json") for x in self._names(f"{self.root}/{n}"))]

    def describe(self) -> DataFrame:
        rows = [(n, m.config["dim"], m.config["bit_width"], m.version, len(m.segments), len(m.logs)) for n in self.list() for m in [self.manifest(n)]]
        return self.spark.createDataFrame(rows, "name string, dim int, bit_width int, version int, segments int, logs int")

    def stats(self) -> dict[str, int]:
        """Segments with rows in them, seals done so far, and estimated bytes of the codes."""
        out = {"segments_active": 0, "segments_sealed_total": 0, "host_bytes": 0, "device_bytes": 0}
        for name in self.list():
            m, c = self.manifest(name), Collection(self, name)
            out["segments_active"] += len(m.segments) + (m.open_rows > 0)
            out["segments_sealed_total"] += m.seals
            out["host_bytes"] += c._segments(m).count() * (c._width() + 4 + 24)
        return out

    def import_rows(self, rows: DataFrame, config: Config) -> int:
        """A new collection filled with (id, values); returns how many. Nothing is left if a row is refused."""
        if not rows.head(1):
            raise InvalidArgument("nothing to import")
        c = self.create(config)
        try:
            c.upsert(rows, strict=True)
        except Exception:
            self.drop(config.name)
            raise
        return c.engine.manifest(config.name).log_rows or c.stats()["live_count"]

    def health(self) -> dict[str, object]:
        return {"ok": True, "collections": len(self.list())}


class Collection:
    def __init__(self, engine: Engine, name: str):
        self.engine, self.name, self.spark = engine, name, engine.spark

    @property
    def _m(self) -> Manifest:
        return self.engine.manifest(self.name)

    @property
    def config(self) -> Config:
        return Config(**self._m.config)

    def _folder(self, m: Manifest, kind: str) -> str:
        return f"{self.engine.root}/{self.name}/{m.incarnation}/{kind}-{uuid.uuid4().hex}"

    # writes

    def _append(self, rows: DataFrame, applied: DataFrame | None = None, check=None) -> int:
        """Write ``rows`` to the log; ``check`` looks at what was written before it is committed."""
        m = self._m
        path = self._folder(m, "log")
        rows.select(*[F.col(c) for c in ("lsn", "seq", "op", "id", "values", "metadata")]).write.parquet(path)
        written = self.spark.read.schema(LOG).parquet(path)
        try:
            if check:
                check(written)
            done = list(m.applied)
            if applied is not None:
                done.append(self._folder(m, "applied"))
                applied.write.parquet(done[-1])
            n = written.count()
            self.engine.commit(self.name, replace(m, next_lsn=m.next_lsn + 1, logs=[*m.logs, path], applied=done, log_rows=m.log_rows + n, open_rows=m.open_rows + n))
        except Exception:
            self.engine._fs.delete(self.engine._path(path), True)
            raise
        if 0 < self.config.seal_threshold <= m.open_rows + n:
            self.seal()
        return m.next_lsn

    def upsert(self, rows: DataFrame, strict: bool = False) -> int:
        """Write (id, values[, metadata][, seq]); all or nothing. ``seq`` orders rows of one id, the highest stays.

        The rows are evaluated once: they are checked as they were written, then committed.
        """
        cols = rows.columns
        rows = rows.select(
            F.lit(self._m.next_lsn).cast("long").alias("lsn"), (F.col("seq") if "seq" in cols else F.monotonically_increasing_id()).cast("long").alias("seq"), F.lit("upsert").alias("op"),
            F.col("id").cast("string").alias("id"), F.col("values").cast("array<float>").alias("values"), (F.col("metadata") if "metadata" in cols else F.create_map()).cast("map<string,string>").alias("metadata"),
        )

        def check(written: DataFrame) -> None:
            wrong = F.when(F.col("id").isNull() | (F.col("id") == ""), "id").otherwise(C.problem(F.col("values"), self.config.dim))
            bad = written.withColumn("wrong", wrong).where("wrong is not null").select("id", "wrong").head(1)
            if bad:
                raise InvalidArgument(f"row {bad[0]['id']!r}: {bad[0]['wrong']}")
            if strict:
                twice = written.groupBy("id").count().where("count > 1").head(1) or written.join(self._ids(), "id", "left_semi").head(1)
                if twice:
                    raise AlreadyExists(twice[0]["id"])

        return self._append(rows, check=check)

    def load_codes(self, rows: DataFrame) -> int:
        """A segment from (id, codes, norm[, metadata]) that were quantised elsewhere with this collection's settings; ids must be new."""
        m = self._m
        path = self._folder(m, "segment")
        metadata = (F.col("metadata") if "metadata" in rows.columns else F.create_map()).cast("map<string,string>").alias("metadata")
        rows.select(
            F.col("id").cast("string").alias("id"), "codes", F.col("norm").cast("float").alias("norm"), metadata, F.lit(m.next_lsn).cast("long").alias("lsn"),
            F.monotonically_increasing_id().alias("seq"), F.lit(None).cast("array<float>").alias("values"),
        ).write.parquet(path)
        written = self.spark.read.schema(SEALED).parquet(path)
        try:
            bad = written.where(F.col("id").isNull() | (F.col("id") == "") | F.col("codes").isNull() | (F.octet_length("codes") != self._width()) | F.col("norm").isNull() | F.isnan("norm")).head(1)
            if bad:
                raise InvalidArgument(f"row {bad[0]['id']!r}: codes of {self._width()} bytes and a norm are needed")
            twice = written.groupBy("id").count().where("count > 1").head(1) or written.select("id").join(self._ids(), "id", "left_semi").head(1)
            if twice:
                raise AlreadyExists(twice[0]["id"])
            self.engine.commit(self.name, replace(m, next_lsn=m.next_lsn + 1, segments=[*m.segments, path], seals=m.seals + 1))
        except Exception:
            self.engine._fs.delete(self.engine._path(path), True)
            raise
        return written.count()

    def delete(self, ids: list[str] | DataFrame) -> int:
        """Delete ids; those that aren't there are ignored."""
        frame = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        gone = frame.select(F.lit(self._m.next_lsn).cast("long").alias("lsn"), F.monotonically_increasing_id().alias("seq"), F.lit("delete").alias("op"), "id", F.lit(None).cast("array<float>").alias("values"), F.lit(None).cast("map<string,string>").alias("metadata"))
        return self._append(gone)

    def apply_changes(self, changes: DataFrame, applied: DataFrame | None = None) -> None:
        """Append net operations (op, id, values, metadata), and in one commit the source changes (lsn, seq, id, cut) they stand for."""
        base = self._m.next_lsn
        self._append(changes.select(F.lit(base).cast("long").alias("lsn"), F.monotonically_increasing_id().alias("seq"), "op", "id", "values", "metadata"), applied)

    def applied(self) -> DataFrame:
        """Source changes applied so far: lsn, seq, the id changed (null: none), cut (it truncated)."""
        m = self._m
        schema = "lsn long, seq int, id string, cut boolean"
        return self.spark.read.schema(schema).parquet(*m.applied) if m.applied else self.spark.createDataFrame([], schema)

    def seal(self) -> int:
        """Quantise live unsealed rows into a new segment; returns how many (0: nothing to do)."""
        m = self._m
        if not m.open_rows:
            return 0
        q = self.config.quantizer
        live = self._newest_log(m).where("op = 'upsert'").withColumn("code", C.quantize(q)(F.col("values")))
        keep = F.col("values") if self.config.retain_raw else F.lit(None).cast("array<float>")
        path = self._folder(m, "segment")
        live.select("id", "code.codes", "code.norm", "metadata", "lsn", "seq", keep.alias("values")).write.parquet(path)
        sealed = self.spark.read.schema(SEALED).parquet(path)
        n, logs, marked = sealed.count(), [], 0
        if m.segments:
            # overwrites and deletes of older segments stay in force by rows without vectors, the former as they were sealed
            marks = self._folder(m, "log")
            rest = self._newest_log(m).where("op <> 'upsert'").select("lsn", "seq", "op", "id")
            rest = rest.unionByName(sealed.select("lsn", "seq", F.lit("sealed").alias("op"), "id"))
            rest.select("*", F.lit(None).cast("array<float>").alias("values"), F.lit(None).cast("map<string,string>").alias("metadata")).write.parquet(marks)
            logs, marked = [marks], self.spark.read.schema(LOG).parquet(marks).count()
        self.engine.commit(self.name, replace(m, segments=[*m.segments, path] if n else m.segments, logs=logs, log_rows=marked, open_rows=0, seals=m.seals + (n > 0)))
        return n

    flush = seal

    def compact(self) -> int:
        """One segment of the live rows; deletes and old versions go."""
        m = self._m
        path = self._folder(m, "segment")
        q = self.config.quantizer
        fresh, sealed = self._parts(m)
        keep = F.col("values") if self.config.retain_raw else F.lit(None).cast("array<float>")
        fresh = fresh.withColumn("code", C.quantize(q)(F.col("values"))).select("id", "code.codes", "code.norm", "metadata", "lsn", "seq", keep.alias("values"))
        sealed.select(*fresh.columns).unionByName(fresh).write.parquet(path)
        self.engine.commit(self.name, replace(m, segments=[path], logs=[], log_rows=0, open_rows=0))
        return self.spark.read.parquet(path).count()

    # reads

    def _log(self, m: Manifest) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*m.logs) if m.logs else self.spark.createDataFrame([], LOG)

    def _newest_log(self, m: Manifest) -> DataFrame:
        order = Window.partitionBy("id").orderBy(F.col("lsn").desc(), F.col("seq").desc())
        return self._log(m).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")

    def _segments(self, m: Manifest) -> DataFrame:
        return self.spark.read.schema(SEALED).parquet(*m.segments) if m.segments else self.spark.createDataFrame([], SEALED)

    def _parts(self, m: Manifest) -> tuple[DataFrame, DataFrame]:
        """Live rows of the log, and live sealed rows: those that nothing in the log is newer than."""
        newest, sealed = self._newest_log(m), self._segments(m)
        fresh = newest.where("op = 'upsert'").drop("op")
        if not m.segments or not m.log_rows:
            return fresh, sealed
        marks = newest.select("id", F.struct("lsn", "seq").alias("at"))
        older = lambda s, k: (s["id"] == k["id"]) & (F.struct(s["lsn"], s["seq"]) < k["at"])
        if m.log_rows <= MAX_MARKS:
            marks = F.broadcast(marks)
            return fresh, sealed.join(marks, older(sealed, marks), "left_anti")
        slim = sealed.select("id", "lsn", "seq")
        dead = slim.join(marks, older(slim, marks), "left_semi").select("id", F.struct("lsn", "seq").alias("at"))
        few = dead.count() <= MAX_MARKS
        gone = F.broadcast(dead) if few else dead
        return fresh, sealed.join(gone, (sealed["id"] == gone["id"]) & (F.struct(sealed["lsn"], sealed["seq"]) == gone["at"]), "left_anti")

    def _live(self, m: Manifest) -> DataFrame:
        """The newest version of every id that isn't deleted, sealed or not."""
        fresh, sealed = self._parts(m)
        fresh = fresh.withColumns({"codes": F.lit(None).cast("binary"), "norm": F.lit(None).cast("float")})
        return sealed.unionByName(fresh)

    def snapshot(self) -> DataFrame:
        """id, values, metadata of live rows; rows kept as codes only are reconstructed."""
        live = self._live(self._m)
        back = F.when(F.col("codes").isNotNull() & F.col("values").isNull(), C.dequantize(self.config.quantizer)(F.coalesce("codes", F.lit(b"\0" * self._width())), F.coalesce("norm", F.lit(0.0).cast("float"))))
        return live.select("id", F.coalesce("values", back.cast("array<float>")).alias("values"), "metadata")

    def _width(self) -> int:
        q = self.config.quantizer
        return (q.out_dim * q.bits + 7) // 8

    def reconstruct(self) -> DataFrame:
        """id, values of live sealed rows from their codes: lossy."""
        live = self._parts(self._m)[1]
        return live.select("id", C.dequantize(self.config.quantizer)(F.col("codes"), F.col("norm")).cast("array<float>").alias("values"))

    def _ids(self) -> DataFrame:
        return self._live(self._m).select("id")

    def ids(self) -> DataFrame:
        """Live ids in byte order."""
        return self._ids().orderBy("id")

    def list_ids(self, after: str = "", limit: int = 1000) -> tuple[list[str], bool]:
        """A page of ids in byte order, and whether more follow."""
        if not 1 <= limit <= 10_000:
            raise InvalidArgument("page size from 1 to 10000")
        got = [r["id"] for r in self._ids().where(F.col("id") > after).orderBy("id").limit(limit + 1).collect()]
        return got[:limit], len(got) > limit

    def stats(self) -> dict[str, int]:
        m = self._m
        fresh, sealed = self._parts(m)
        n, n_sealed = fresh.count(), sealed.count()
        physical = self._segments(m).count() + self._log(m).where("op = 'upsert'").count()
        gone = self._newest_log(m).where("op = 'delete'").count()
        q = self.config.quantizer
        return {"live_count": n + n_sealed, "sealed_count": n_sealed, "physical_count": physical, "tombstones": gone, "segments": len(m.segments), "bytes": n_sealed * (self._width() + 4 + 24), "out_dim": q.out_dim}

    def table_function(self, name: str) -> None:
        """Make live rows a temporary view ``name`` with a SQL function ``name_score(values, query)`` beside it.

        ``SELECT id FROM name ORDER BY name_score(values, array(...)) DESC, id LIMIT k`` is then an exact search in SQL.
        """
        self.snapshot().createOrReplaceTempView(name)
        self.spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_score(v ARRAY<FLOAT>, q ARRAY<DOUBLE>) RETURNS DOUBLE "
            "RETURN aggregate(zip_with(v, q, (x, y) -> coalesce(CAST(x AS DOUBLE) * y, 0D)), 0D, (s, x) -> s + x)"
        )

    def search(self, queries: DataFrame | list[float], k: int = 10, where: str | None = None, reranker=None, **options) -> tuple[DataFrame, SearchPlan]:
        """(query_id, rank, id, score, metadata) and the plan. A single vector is query "0"."""
        opts = SearchOptions(k=k, **options)
        if not isinstance(queries, DataFrame):
            queries = self.spark.createDataFrame([("0", [float(x) for x in queries])], "query_id string, values array<double>")
        m = self._m
        live = self._live(m)
        if where:
            live = live.where(where)
        dim, retained = self.config.dim, self.config.retain_raw
        fresh, coded = self._parts(m)
        raw = live.select("id", "values") if retained or not m.segments else None
        sealed, plain = (d.where(where) if where else d for d in (coded, fresh))
        sealed, plain = sealed.select("id", "codes", "norm"), plain.select("id", "values")
        reranked = bool(opts.rerank and (raw is not None or reranker))
        if not m.segments:
            found = S.exact(plain, queries, dim, opts.k)
        elif opts.exact and raw is not None:
            found = S.exact(raw, queries, dim, opts.k)
        else:
            both = S.quantized(sealed, queries, self.config.quantizer, opts.effective_k).unionByName(S.exact(plain, queries, dim, opts.effective_k))
            found = S.merge(both.drop("rank"), opts.effective_k)
            if reranked:
                found = S.merge(reranker(found).drop("rank"), opts.k) if reranker else S.rerank(found, raw, queries, opts.k, opts.effective_k)
            found = found.where(F.col("rank") <= opts.k)
        out = live.select("id", "metadata").join(S.sent(found, queries.count() * opts.k), "id").select("query_id", "rank", "id", F.col("score").cast("float").alias("score"), "metadata")
        return out.orderBy("query_id", "rank"), SearchPlan(len(m.segments) + bool(m.logs), opts.effective_k, opts.effective_k, reranked, opts.exact, opts.ef_search)
