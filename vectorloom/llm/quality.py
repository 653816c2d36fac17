"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words and their shapes (letters, capitals, digits and marks, each run as one; a word that repeats the one
before has a shape of its own) are hashed into a fixed vocabulary. Random indexing: every vocabulary entry has a
sparse ternary index vector made from its number, and an entry's word vector is the sum of the index vectors of
its neighbours over the whole corpus. A document is the mean and the spread of its words' vectors. The network
(one hidden layer, numpy) is trained on the driver on a bounded sample of labelled rows, and its logit is
divided by a temperature fitted on a part of the sample that training didn't see.

Bounds: VOCABULARY * DIMENSIONS numbers are sent by each task and broadcast; at most MAX_TRAINING labelled rows
(those of smallest hash) are trained on. Corpus counts cover all documents.

Edge cases: a null or empty text pools to zeros and is scored like any other; labels that are null, of unknown
documents or held out aren't learnt from; without labels of both kinds every score is the share of label 1 (0.5
without labels); rows that repeat are scored alike; an empty table gives no rows; other columns are carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vectorloom.llm import memo
from vectorloom.runtime import ship

VOCABULARY, SHAPES, DIMENSIONS, NONZERO = 1 << 13, 1 << 9, 48, 4
HIDDEN, EPOCHS, BATCH, MAX_TRAINING = 32, 30, 256, 12_000
CUT = 0.7
#: ASCII capitals, small letters and digits to one of their kind; bytes of other letters count as small letters.
_KIND = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
#: Words kept per worker process; the table is emptied when full.
MAX_WORDS = 150_000


def _shape(word: bytes) -> bytes:
    return _RUN.sub(rb"\1\1", word.translate(_KIND))


class _Numbers(dict):
    """The vocabulary number of a word and of its shape, as one integer."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        w = xxhash.xxh32_intdigest(word.lower()) % VOCABULARY
        s = VOCABULARY + xxhash.xxh32_intdigest(_shape(word), 1) % (SHAPES - 1)
        n = self[word] = w << 16 | s
        return n


_REPEAT = VOCABULARY + SHAPES - 1
_ENTRIES = VOCABULARY + SHAPES


def entries_of(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary numbers of the words and of their shapes, in order."""
    words = text.split() if text else []
    numbers = memo.table("numbers", _Numbers)
    if len(numbers) > MAX_WORDS:
        numbers.clear()
    both = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    word, shape = both >> 16, both & 0xFFFF
    if len(word) > 1:
        shape[1:][word[1:] == word[:-1]] = _REPEAT
    return word, shape


def _sparse_index(seed: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each entry's index vector, made from its number alone."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, DIMENSIONS, (entries, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (entries, NONZERO))


def index_vectors(seed: int, entries: int) -> np.ndarray:
    at, sign = _sparse_index(seed, entries)
    out = np.zeros((entries, DIMENSIONS))
    for k in range(NONZERO):
        np.add.at(out, (np.arange(entries), at[:, k]), sign[:, k])
    return out


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, sign = _sparse_index(5, VOCABULARY)
    total = np.zeros((_ENTRIES, DIMENSIONS))
    pairs = np.zeros(SHAPES * SHAPES)

    def add(target: np.ndarray, near: np.ndarray) -> None:
        """Each target entry takes its neighbour's few non-zeros."""
        place = target[:, None] * DIMENSIONS + at[near]
        total[:VOCABULARY] += np.bincount(place.ravel(), sign[near].ravel(), VOCABULARY * DIMENSIONS).reshape(VOCABULARY, DIMENSIONS)

    words: list[np.ndarray] = []
    shapes: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        w, s = np.concatenate(words), np.concatenate(shapes)
        inner = (w[:-1] >= 0) & (w[1:] >= 0)  # no pair across documents
        a, b, sa, sb = w[:-1][inner], w[1:][inner], s[:-1][inner], s[1:][inner]
        if len(a):
            add(a, b)
            add(b, a)
            pairs[:] += np.bincount((sa - VOCABULARY) * SHAPES + (sb - VOCABULARY), minlength=SHAPES * SHAPES)
        words.clear()
        shapes.clear()

    gap = np.array([-1])
    for batch in batches:
        for text in batch.column("text").cast(pa.large_binary()).to_pylist():
            w, s = entries_of(text)
            words.extend((w, gap))
            shapes.extend((s, gap))
            held += len(w)
            if held >= 200_000:
                flush()
                held = 0
    if words:
        flush()
    near = pairs.reshape(SHAPES, SHAPES)  # few enough to count, then sum
    total[VOCABULARY:] = (near + near.T) @ index_vectors(7, SHAPES)
    step = 512
    some = [k for k in range(0, _ENTRIES, step) if total[k : k + step].any()]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([total[k : k + step].astype("<f4").tobytes() for k in some], pa.binary())], ["at", "sums"])


def _add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    raw = table.column("sums").to_pylist()
    total = np.zeros(len(raw[0]) // 4, np.float64)
    for r in raw:
        total += np.frombuffer(r, "<f4")
    return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total.astype("<f8").tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Random-indexing vectors of all entries from all of ``docs`` (text), each of length one."""
    got = docs.select("text").mapInArrow(_context, "at long, sums binary").groupBy("at").applyInArrow(_add_up, "at long, sums binary").collect()
    out = np.zeros((_ENTRIES, DIMENSIONS), np.float64)  # 3 MB
    for r in got:
        part = np.frombuffer(r["sums"], "<f8").reshape(-1, DIMENSIONS)
        out[r["at"] : r["at"] + len(part)] = part
    mean = out.sum(axis=0) / max(1e-9, np.abs(out).sum())
    out = out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True)) - mean
    own = index_vectors(6, _ENTRIES)  # an entry without neighbours of its own still tells itself from others
    return (out + 0.5 * own / np.linalg.norm(own, axis=1, keepdims=True).clip(1e-9)).astype(np.float32)


FEATURES = 4 * DIMENSIONS + 3


def pool(text: bytes | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a document's word and shape vectors, and its length on a log scale."""
    word, shape = entries_of(text)
    out = np.zeros(FEATURES, np.float32)
    if not len(word):
        return out
    for k, ids in enumerate((word, shape)):
        n = np.bincount(ids - (VOCABULARY if k else 0), minlength=SHAPES if k else VOCABULARY)
        some = np.flatnonzero(n)
        share = (n[some] / len(ids)).astype(np.float32)
        v = vectors[some + (VOCABULARY if k else 0)]
        mean = share @ v
        at = 2 * k * DIMENSIONS
        out[at : at + DIMENSIONS] = mean
        out[at + DIMENSIONS : at + 2 * DIMENSIONS] = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
        out[-2 + k] = (share * share).sum()
    out[-3] = np.log1p(len(word)) / 10
    return out


@dataclass
class Network:
    """Two layers and a temperature; ``probability`` is calibrated."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) * self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    """Adam on the logistic loss with weight decay; a fifth of the rows fits the temperature."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    mean, sd = x[fit].mean(axis=0), x[fit].std(axis=0)
    net = Network(mean, 1 / np.maximum(sd, 1e-4), rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    net.scale = np.minimum(net.scale, 1e3)
    params = [net.w1, net.b1, net.w2, np.array([0.0])]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - net.mean) * net.scale
    for epoch in range(EPOCHS):
        rate = 3e-3 * (1 - epoch / EPOCHS)
        fit = rng.permutation(fit)
        for at in range(0, len(fit), BATCH):
            rows = fit[at : at + BATCH]
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            d = (p - y[rows]) / len(rows)
            dh = np.outer(d, params[2]) * (1 - h * h)
            grads = [z[rows].T @ dh + 1e-4 * params[0], dh.sum(axis=0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(held):
        s, target = net.logit(x[held]), y[held]
        loss = lambda temp: np.mean(np.logaddexp(0, s / temp) - target * s / temp)
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def held_out(doc_id) -> F.Column:
    """Rows that no label is learnt from: crc32 of the id as text leaves 2 by 4 (a null id: never)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Network | float:
    """A network from at most MAX_TRAINING labelled rows, or the share of label 1 where there is but one label."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("__vl_id"), F.col("quality").cast("int").alias("__vl_y"))
    known = known.where(~held_out(F.col("__vl_id")))
    chosen = known.orderBy(F.xxhash64("__vl_id"), "__vl_id", "__vl_y").limit(MAX_TRAINING)
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pool(t, shared.value).tobytes() for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__vl_id"), b.column("__vl_y"), pa.array(x, pa.binary())], ["id", "y", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("__vl_id"), "text").join(F.broadcast(chosen.withColumn("__vl_id", F.col("__vl_id").cast("long"))), "__vl_id")
    got = rows.mapInArrow(features, "id long, y int, x binary").orderBy("id", "y", "x").toPandas()
    y = got["y"].to_numpy(dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return train(np.stack([np.frombuffer(r, np.float32) for r in got["x"]]).astype(np.float64), y)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.7 on)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    vectors = word_vectors(docs)
    model = fit(docs, labels, vectors)
    shared = spark.sparkContext.broadcast((vectors, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, model = shared.value
        for b in batches:
            texts = b.column("text").cast(pa.large_binary()).to_pylist()
            if isinstance(model, float):
                p = np.full(len(texts), model)
            else:
                p = model.probability(np.stack([pool(t, vectors) for t in texts]).astype(np.float64)) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "score"])

    out = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
