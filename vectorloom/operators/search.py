"""Maximum-inner-product search: exact, over codes, and over codes with exact reranking.

Rows and queries become numbers whose inner product is the score. A task looks through tiles of scores in single
precision for those that may reach the k-th best so far, and works these out in doubles, so ranks and scores are those
of doubles, equal for equal vectors wherever they lie. It keeps its best k of each query: k rows a query and task are
shuffled, whatever the corpus holds.

Few queries are a checked matrix broadcast to every task. More are dealt out in groups of bounded size; a group and a
share of the rows, packed where they lie, meet in one task, through which the rows stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.errors import InvalidArgument
from vectorloom.functions.columns import binary_rows, inner_product
from vectorloom.functions.quantize import ProdQuantizer, Quantizer
from vectorloom.functions.rotation import rotate
from vectorloom.plans.options import MAX_K, SearchOptions
from vectorloom.runtime import ship

#: Numbers in a query matrix that is broadcast; of a larger query set, in a task's group of queries; in a packed block.
MAX_QUERY_NUMBERS, GROUP_NUMBERS, BLOCK_NUMBERS = 1 << 18, 1 << 21, 1 << 18
#: Queries and rows of a tile of scores.
TILE_QUERIES, TILE_ROWS = 1024, 4096
#: Scores worked out in doubles at a time.
RESCORED = 1 << 16
#: Candidate rows that may be sent whole to every executor; more are joined by a shuffle.
MAX_SENT_ROWS = 1_000_000


def _checked(rows: list, dim: int) -> tuple[list[str], np.ndarray]:
    for name, v in rows:
        if v is None or len(v) != dim or any(x is None for x in v) or not np.isfinite(v).all():
            raise InvalidArgument(f"query {name}: {dim} finite numbers are needed")
    return [name for name, _ in rows], np.array([v for _, v in rows], np.float64).reshape(len(rows), dim)


def query_matrix(queries: DataFrame, dim: int) -> tuple[list[str], np.ndarray] | None:
    """(ids, rows) of queries (query_id, values), checked; None if they are too many to broadcast."""
    most = MAX_QUERY_NUMBERS // dim
    rows = queries.select(F.col("query_id").cast("string").alias("query_id"), "values").limit(most + 1).collect()
    return None if len(rows) > most else _checked([tuple(r) for r in rows], dim)


def _reduced(x: np.ndarray) -> tuple[np.ndarray, float]:
    """``x`` over a power of two, so that no number is above 1, and that power."""
    most = float(np.abs(x).max(initial=0.0))
    unit = 2.0 ** min(1023, max(-1021, math.frexp(most)[1])) if most else 1.0
    return x / unit, unit


class _Best:
    """The best k rows of each query so far: scores down (NaN first, as Spark sorts it), ties to the smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.k, self.q, self.qt = k, queries, np.ascontiguousarray(queries.T)
        self.small, self.unit = _reduced(queries)
        self.single = self.small.astype(np.float32)
        self.length = np.sqrt((self.small * self.small).sum(axis=1))
        self.score, self.ids = np.full((len(queries), k), -np.inf), np.full((len(queries), k), None, object)
        self.n = np.zeros(len(queries), np.int64)

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        """``x``: the numbers of a row each, ``ids``: their ids."""
        for at in range(0, len(ids) if len(self.q) else 0, TILE_ROWS):
            self._block(x[at : at + TILE_ROWS], ids[at : at + TILE_ROWS])

    def _block(self, x: np.ndarray, ids: np.ndarray) -> None:
        good = np.isfinite(x).all(axis=1)
        if not good.all():
            self._not_finite(x[~good], ids[~good])
            x, ids = x[good], ids[good]
        x, ids = self._thinned(x, ids)
        if not len(ids):
            return
        xt = np.ascontiguousarray(x.T)
        small, unit = _reduced(x)
        single, longest = small.astype(np.float32), float(np.sqrt((small * small).sum(axis=1)).max())
        scores = np.empty((min(TILE_QUERIES, len(self.q)), len(ids)), np.float32)
        for at in range(0, len(self.q), TILE_QUERIES):
            part = slice(at, min(at + TILE_QUERIES, len(self.q)))
            tile = np.matmul(self.single[part], single.T, out=scores[: part.stop - at])
            off = (x.shape[1] + 8) * 1.1 * 2.0**-24 * longest * self.length[part] + 1e-30
            q, i = self._reaching(tile, part, unit, off)
            if len(q) > max(tile.size // 32, 4 * self.k * len(tile)):  # single precision can't tell these rows apart
                tile = self.small[part] @ small.T
                off = (x.shape[1] + 8) * 1.1 * 2.0**-53 * longest * self.length[part] + 1e-290
                q, i = self._reaching(tile, part, unit, off)
            for cut in range(0, len(q), RESCORED):
                self._compete(q[cut : cut + RESCORED] + at, i[cut : cut + RESCORED], xt, ids)

    def _reaching(self, tile: np.ndarray, part: slice, unit: float, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and rows of a tile whose score may reach the k-th best; a score is at most ``off`` beside the true one."""
        n = tile.shape[1]
        bar = np.where(self.n[part] >= self.k, self.score[part, -1] / self.unit / unit - off, -np.inf)
        bar[np.isnan(bar)] = np.inf  # k rows without a finite score are before all others
        if n >= self.k and (self.n[part] < self.k).any():
            bar = np.maximum(bar, np.partition(tile, n - self.k, axis=1)[:, n - self.k] - 2 * off)
        with np.errstate(over="ignore"):
            bar = np.nextafter(bar.astype(tile.dtype), tile.dtype.type(-np.inf))
        found = (tile >= bar[:, None]).ravel()
        if len(found) % 8 == 0:  # eight at a time: nearly all are False
            eight = np.flatnonzero(found.view(np.uint64))
            at = np.nonzero(found.reshape(-1, 8)[eight])
            found = eight[at[0]] * 8 + at[1]
        else:
            found = np.flatnonzero(found)
        return np.divmod(found, n)

    def _thinned(self, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without all but the k smallest ids of equal rows: no other can be among a query's best k."""
        if len(ids) <= self.k:
            return x, ids
        x = np.ascontiguousarray(x) + 0.0  # one zero
        kinds, kind = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
        if len(kinds) == len(ids):
            return x, ids
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(kind[order], kind="stable")]
        first = np.searchsorted(kind[order], kind[order])
        kept = np.sort(order[np.arange(len(ids)) - first < self.k])
        return x[kept], ids[kept]

    def _not_finite(self, x: np.ndarray, ids: np.ndarray) -> None:
        for at in range(0, len(ids), max(1, RESCORED // len(self.q))):
            few = slice(at, at + max(1, RESCORED // len(self.q)))
            q, i = np.divmod(np.arange(len(self.q) * len(ids[few])), len(ids[few]))
            with np.errstate(invalid="ignore"):
                self._compete(q, i, np.ascontiguousarray(x[few].T), ids[few])

    def _compete(self, q: np.ndarray, i: np.ndarray, xt: np.ndarray, ids: np.ndarray) -> None:
        """Take in rows ``i`` for queries ``q``: products are added one after the other, as SQL adds them."""
        score = np.zeros(len(q))
        for a, b in zip(self.qt, xt, strict=True):
            score += a[q] * b[i]
        low = self.score[q, -1]
        in_time = (self.n[q] < self.k) | (score >= low) | np.isnan(score)
        q, i, score = q[in_time], i[in_time], score[in_time]
        if not len(q):
            return
        them, place = np.unique(q, return_inverse=True)
        old, col = np.nonzero(np.arange(self.k) < self.n[them][:, None])
        place = np.concatenate((old, place))
        score = np.concatenate((self.score[them[old], col], score))
        name = np.concatenate((self.ids[them[old], col], ids[i]))
        key, nan = np.where(np.isnan(score), np.inf, score), ~np.isnan(score)
        order = np.lexsort((nan, -key, place))
        same = (np.diff(place[order]) == 0) & (np.diff(key[order]) == 0) if np.isinf(key).any() else (np.diff(place[order]) == 0) & (score[order][1:] == score[order][:-1])
        if same.any():
            tied = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
            rank = np.zeros(len(order), np.int64)
            rank[tied] = np.unique(name[tied], return_inverse=True)[1]
            order = np.lexsort((rank, nan, -key, place))
        place, score, name = place[order], score[order], name[order]
        at = np.arange(len(place)) - np.searchsorted(place, place)
        kept = at < self.k
        self.score[them[place[kept]], at[kept]], self.ids[them[place[kept]], at[kept]] = score[kept], name[kept]
        self.n[them] = np.minimum(self.k, np.bincount(place, minlength=len(them)))

    def batches(self, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, RESCORED // self.k)
        for low in range(0, len(self.n), step):
            q, at = np.nonzero(np.arange(self.k) < self.n[low : low + step, None])
            q += low
            cols = [pa.array(names[q], pa.string()), pa.array(self.ids[q, at], pa.string()), pa.array(self.score[q, at], pa.float64(), from_pandas=False)]
            yield pa.RecordBatch.from_arrays(cols, ["query_id", "id", "score"])


_FOUND = "query_id string, id string, score double"


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return np.array(b.column("id").to_pylist(), dtype=object)


def _search(rows: DataFrame, columns: list[str], queries: DataFrame, dim: int, k: int, prepare, numbers) -> DataFrame:
    """The best k of ``rows`` (id and columns) for each query: ``prepare`` makes a query matrix, ``numbers`` a batch of rows
    into numbers whose inner product is the score."""
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select("id", *columns)
    found = query_matrix(queries, dim)
    if found is None:
        return merge(_met_in_blocks(rows, queries, dim, k, prepare, numbers), k)
    names, q = found
    shared = spark.sparkContext.broadcast((names, prepare(q)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        best = _Best(q, k)
        for whole in batches:
            for at in range(0, whole.num_rows if names else 0, TILE_ROWS):
                b = whole.slice(at, TILE_ROWS)
                best.add(numbers(b), _ids(b))
        yield from best.batches(np.array(names, dtype=object))

    return merge(rows.mapInArrow(run, _FOUND), k)


def _cells(spark, queries: int, rows: int, dim: int, k: int) -> tuple[int, int]:
    """Groups of queries and shares of rows, whose product is the number of tasks.

    A group more sends all rows once more, a share more k found rows a query; one of these costs some 50 times as much.
    """
    cores, least = spark.sparkContext.defaultParallelism, -(-queries * dim // GROUP_NUMBERS)
    tasks = cores * max(2, -(-least // cores))
    groups = max(1, min(tasks, queries, max(least, round(math.sqrt(tasks * 5 * k * queries / max(1, rows))))))
    if 2 * groups > tasks:  # as many groups as tasks, whose shares are whole
        groups = max(1, min(tasks, queries))
    return groups, -(-tasks // groups)


def _met_in_blocks(rows: DataFrame, queries: DataFrame, dim: int, k: int, prepare, numbers) -> DataFrame:
    """(query_id, id, score) of each query's best k in each share of the rows."""
    spark = rows.sparkSession
    queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "values")
    groups, shares = _cells(spark, queries.count(), rows.count(), dim, k)
    n = max(1, BLOCK_NUMBERS // dim)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, n):
                sink = pa.BufferOutputStream()
                part = pa.Table.from_batches([whole.slice(at, n)])
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_table(part.combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["data"])

    def unpacked(raw: pa.Scalar) -> pa.RecordBatch:
        return pa.ipc.open_stream(raw.as_buffer()).read_all().combine_chunks().to_batches()[0]

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.repartition(groups).mapInArrow(packed, "data binary").select("data", F.spark_partition_id().alias("group"))
    asked = asked.select("data", "group", each(shares).alias("share"), F.lit(0).alias("kind"))
    data = rows.mapInArrow(packed, "data binary").select("data", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shares)).cast("int").alias("share"))
    data = data.select("data", each(groups).alias("group"), "share", F.lit(1).alias("kind"))
    cells = asked.unionByName(data).select("data", "kind", (F.col("group") * shares + F.col("share")).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found, best = [], [], None
        for b in batches:
            for raw, kind in zip(b.column("data"), b.column("kind").to_pylist(), strict=True):
                part = unpacked(raw)
                if kind == 0:
                    got, x = _checked(list(zip(part.column("query_id").to_pylist(), part.column("values").to_pylist(), strict=True)), dim)
                    names += got
                    found.append(prepare(x))
                    continue
                if best is None and found:
                    best, found = _Best(np.concatenate(found), k), []
                if best is not None:
                    best.add(numbers(part), _ids(part))
        if best is not None:
            yield from best.batches(np.array(names, dtype=object))

    return cells.repartitionById(groups * shares, "cell").sortWithinPartitions("kind").mapInArrow(run, _FOUND)


def merge(partial: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score: the best k of each query; ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def raw_numbers(dim: int):
    """The numbers of a batch of raw vectors."""

    def numbers(b: pa.RecordBatch) -> np.ndarray:
        return b.column("values").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)

    return numbers


def exact(rows: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """Search raw vectors (id, values)."""
    return _search(rows, ["values"], queries, dim, k, lambda q: q, raw_numbers(dim))


def exact_sql(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    """One query on the JVM alone: id, score by a top-k plan."""
    lit = F.array(*[F.lit(float(x)) for x in query])
    return rows.select("id", inner_product(F.col("values"), lit).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def quantized(rows: DataFrame, queries: DataFrame, quantizer: Quantizer, k: int, query_codes: bool = False) -> DataFrame:
    """Search codes (id, codes, norm) in the rotated space; ``query_codes`` codes the queries too."""
    width = (quantizer.out_dim * quantizer.bits + 7) // 8

    def numbers(b: pa.RecordBatch) -> np.ndarray:
        return quantizer.rotated(binary_rows(b.column("codes"), width), b.column("norm").to_numpy(zero_copy_only=False))

    prepare = lambda q: rotate(quantizer.decode(*quantizer.encode(q)) if query_codes else q, quantizer.seed)
    return _search(rows, ["codes", "norm"], queries, quantizer.dim, k, prepare, numbers)


def prod(rows: DataFrame, queries: DataFrame, quantizer: ProdQuantizer, k: int, estimator: str = "unbiased") -> DataFrame:
    """Search product codes (id, codes, norm, signs, residual_norm)."""
    width, wide = (quantizer.mse.out_dim * quantizer.mse.bits + 7) // 8, (quantizer.rows + 7) // 8

    def numbers(b: pa.RecordBatch) -> np.ndarray:
        norm, rest = (b.column(c).to_numpy(zero_copy_only=False) for c in ("norm", "residual_norm"))
        return quantizer.numbers(binary_rows(b.column("codes"), width), norm, binary_rows(b.column("signs"), wide), rest)

    prepare = lambda q: quantizer.asked(q, estimator)
    return _search(rows, ["codes", "norm", "signs", "residual_norm"], queries, quantizer.dim, k, prepare, numbers)


def sent(few: DataFrame, rows: int) -> DataFrame:
    """A frame of at most ``rows`` rows, marked for broadcast if that is little enough."""
    return F.broadcast(few) if rows <= MAX_SENT_ROWS else few


def rerank(candidates: DataFrame, rows: DataFrame, queries: DataFrame, k: int, per_query: int = MAX_K) -> DataFrame:
    """Exact scores of candidates (query_id, id), at most ``per_query`` a query, from raw vectors; the best k by them.

    Ids of few candidates are sent to the raw rows; many are joined by a shuffle. The queries' vectors are joined
    after that, to the candidates' rows alone.
    """
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("values").alias("asked"))
    n = asked.count()
    few = sent(candidates.select("query_id", "id"), n * per_query)
    scored = rows.select("id", "values").join(few, "id").join(sent(asked, n * len(asked.columns)), "query_id")
    return merge(scored.select("query_id", "id", inner_product(F.col("values"), F.col("asked")).alias("score")), k)


def search(rows: DataFrame, queries: DataFrame, options: SearchOptions, dim: int, quantizer: Quantizer | None = None, raw: DataFrame | None = None, reranker=None) -> DataFrame:
    """Search by options; over codes if a quantizer is given, reranked if asked and raw vectors are there."""
    if quantizer is None or options.exact and raw is not None:
        return exact(raw if raw is not None else rows, queries, dim, options.k)
    found = quantized(rows, queries, quantizer, options.effective_k)
    if options.rerank and reranker is not None:
        return merge(reranker(found), options.k)
    if options.rerank and raw is not None:
        return rerank(found, raw, queries, options.k, options.effective_k)
    return found.where(F.col("rank") <= options.k)
