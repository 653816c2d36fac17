"""Toxicity by a classifier chain of linear models over label columns.

Every category is a 0/1 column of ``labels`` (``CATEGORIES``: here low quality, that is ``quality`` turned round, and
``toxic``; any set of columns will do). Models run in that order. Each is a logistic model over the presence of
selected words and the probabilities of the earlier categories; while training, those probabilities are out-of-fold
predictions, so a later model learns from scores as unsure as those it will see. Words are selected by a
log-likelihood test for each category. A row whose label of a category is null takes no part in that model's training.

Bounds: at most MAX_TRAINING labelled rows (those of smallest hash) and FEATURES words a category (documented settings).
Every text is scored whole; of words of over KEPT bytes a digest stands for the word.

Edge cases: a null or empty text has no words and is scored like any other; labels that are null, of unknown documents
or held out (crc32 of the id as text leaves 2 by 4) aren't learnt from; labels that contradict each other are each a
row; a category without rows of both kinds has the share of 1 (0 without rows) as its probability; rows that repeat
are scored alike; an empty table gives no rows; other columns are carried, those named like an output are replaced.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from vectorloom.llm.quality import held_out
from vectorloom.runtime import Scratch, ship

MAX_TRAINING, FEATURES, FOLDS, LEAST_DF, STEM, KEPT = 20_000, 384, 5, 5, 4, 40
#: Categories in the chain's order: the label column, and the value of it that counts as 1. The last is the score.
CATEGORIES = (("quality", 0), ("toxic", 1))
#: A-Z to a-z; ASCII marks and control characters to spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> set[bytes]:
    """The words of a text, and the beginnings of the longer ones (marked by ^), which inflected forms share."""
    words = set(text.translate(_TABLE).split()) if text else set()
    if any(len(w) > KEPT for w in words):
        words = {w if len(w) <= KEPT else b"#" + hashlib.blake2b(w, digest_size=12).hexdigest().encode() for w in words}
    return words | {b"^" + w[:STEM] for w in words if len(w) > STEM}


def _weight(pos: int, neg: int, n_pos: int, n_neg: int) -> float:
    """Signed log-likelihood ratio of a word's presence in toxic and other texts."""
    total, have = n_pos + n_neg, pos + neg
    out = 0.0
    for k, row, col in ((pos, n_pos, have), (neg, n_neg, have), (n_pos - pos, n_pos, total - have), (n_neg - neg, n_neg, total - have)):
        if k:
            out += k * np.log(k * total / (row * col))
    return 2 * out if pos * n_neg >= neg * n_pos else -2 * out


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the bias and isn't shrunk."""
    a = np.hstack((x, np.ones((len(x), 1))))
    w, ridge = np.zeros(a.shape[1]), np.full(a.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def apply_linear(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    """Models in order: weights, or the probability itself where there was nothing to learn."""

    words: list[bytes]
    weights: list[np.ndarray | float]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), 0))
        for w in self.weights:
            p = np.full(len(x), w) if isinstance(w, float) else apply_linear(w, np.hstack((x, out)))
            out = np.hstack((out, p[:, None]))
        return out


def train_chain(x: np.ndarray, targets: np.ndarray, words: list[bytes], seed: int = 9) -> Chain:
    """One model a column of ``targets`` (0, 1 or NaN); earlier ones enter later ones' training as out-of-fold probabilities."""
    fold = np.random.Generator(np.random.PCG64(seed)).permutation(len(x)) % FOLDS
    earlier, weights = np.empty((len(x), 0)), []
    for k in range(targets.shape[1]):
        full, y = np.hstack((x, earlier)), targets[:, k]
        known = ~np.isnan(y)
        if len(set(y[known].tolist())) < 2:
            weights.append(float(y[known].mean()) if known.any() else 0.0)
            out = np.full(len(x), weights[-1])
        else:
            weights.append(fit_linear(full[known], y[known]))
            out = np.empty(len(x))
            for f in range(FOLDS):
                rest = known & (fold != f)
                out[fold == f] = apply_linear(fit_linear(full[rest], y[rest]), full[fold == f]) if rest.any() else y[known].mean()
        earlier = np.hstack((earlier, out[:, None]))
    return Chain(words, weights)


def fit(docs: DataFrame, labels: DataFrame, categories=CATEGORIES) -> Chain:
    """A chain from at most MAX_TRAINING labelled rows."""
    spark = docs.sparkSession
    ship(spark)
    names = [f"__vl_y{k}" for k in range(len(categories))]
    marks = [F.when(F.col(c).isin(0, 1), (F.col(c) == v).cast("int")).alias(n) for n, (c, v) in zip(names, categories, strict=True)]
    known = labels.select(F.col("doc_id").cast("long").alias("__vl_id"), *marks).where(F.coalesce(*names).isNotNull())
    chosen = known.where(~held_out(F.col("__vl_id"))).orderBy(F.xxhash64("__vl_id"), "__vl_id", *names).limit(MAX_TRAINING)
    rows = docs.select(F.col("doc_id").cast("long").alias("__vl_id"), "text").join(F.broadcast(chosen), "__vl_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(Counter(), Counter()) for _ in names]
        for b in batches:
            marks = zip(*(b.column(n).to_pylist() for n in names), strict=True)
            for ys, t in zip(marks, b.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                words = words_of(t) | {b""}  # the empty word counts the rows
                for two, y in zip(seen, ys, strict=True):
                    if y is not None:
                        two[y].update(words)
        for k, two in enumerate(seen):
            all_words = list(two[0] | two[1])
            cols = [pa.array([k] * len(all_words), pa.int32()), pa.array(all_words, pa.binary()), *(pa.array([two[y][w] for w in all_words], pa.int64()) for y in (1, 0))]
            yield pa.RecordBatch.from_arrays(cols, ["k", "word", "pos", "neg"])

    counts = rows.mapInArrow(count, "k int, word binary, pos long, neg long").groupBy("k", "word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = Scratch(spark, "toxicity").keep(counts, "counts")
    totals = {r["k"]: (r["pos"], r["neg"]) for r in counts.where(F.length("word") == 0).collect()}  # a row a category
    chosen_words: set[bytes] = set()
    for k in range(len(categories)):
        n_pos, n_neg = totals.get(k, (0, 0))
        if not n_pos or not n_neg:
            continue
        often = counts.where((F.col("k") == k) & (F.length("word") > 0) & (F.col("pos") + F.col("neg") >= LEAST_DF))
        lift = F.abs(F.col("pos") / F.lit(float(n_pos)) - F.col("neg") / F.lit(float(n_neg)))
        spread = lift / F.sqrt((F.col("pos") + F.col("neg")) / F.lit(float(n_pos + n_neg)))
        top = often.orderBy(spread.desc(), "word").limit(8 * FEATURES).collect()
        ranked = sorted(((_weight(r["pos"], r["neg"], n_pos, n_neg), bytes(r["word"])) for r in top), key=lambda r: (-abs(r[0]), r[1]))
        chosen_words |= {w for _, w in ranked[:FEATURES]}
    words = sorted(chosen_words)
    place = {w: i for i, w in enumerate(words)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = []
            for t in b.column("text").cast(pa.large_binary()).to_pylist():
                row = np.zeros(len(words), np.uint8)
                row[[place[w] for w in place.keys() & words_of(t)]] = 1
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("__vl_id"), *(b.column(n) for n in names), pa.array(bits, pa.binary())], ["id", *names, "x"])

    schema = "id long, " + ", ".join(f"{n} int" for n in names) + ", x binary"
    got = rows.mapInArrow(present, schema).orderBy("id", *names, "x").toPandas()  # MAX_TRAINING rows of FEATURES bits a category
    x = np.stack([np.unpackbits(np.frombuffer(r, np.uint8), count=len(words)) for r in got["x"]]).astype(np.float64) if len(got) else np.empty((0, len(words)))
    return train_chain(x, got[names].to_numpy(dtype=np.float64), words)


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.5, categories=CATEGORIES) -> DataFrame:
    """``docs`` with a probability for each category (p_<column>), ``score`` (the last one's) and ``predicted``."""
    spark = docs.sparkSession
    names = [f"p_{c}" for c, _ in categories]
    docs = docs.select(*[c for c in docs.columns if c not in (*names, "score", "predicted")])
    shared = spark.sparkContext.broadcast(fit(docs, labels, categories))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = {w: i for i, w in enumerate(model.words)}
        for b in batches:
            texts = b.column("text").cast(pa.large_binary()).to_pylist()
            x = np.zeros((len(texts), len(place)))
            for i, t in enumerate(texts):
                x[i, [place[w] for w in place.keys() & words_of(t)]] = 1
            p = model.probabilities(x)
            extra = [pa.array(p[:, k], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra, extra[-1], pa.array((p[:, -1] >= cut).astype(np.int32))], [*b.schema.names, *names, "score", "predicted"])

    fields = [*docs.schema.fields, *(StructField(n, DoubleType()) for n in (*names, "score")), StructField("predicted", IntegerType())]
    return docs.mapInArrow(run, StructType(fields))
