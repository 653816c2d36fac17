"""Attention over cached keys and values that are held as codes.

A cache is rows (sequence, position, key, value); codes replace both vectors, each with its own bit width. A task
folds its rows into one partial softmax a sequence (the highest score, the sum of weights, the weighted sum of values),
scored once; partial ones are merged by sequence. So a sequence of any length is spread over all tasks and none holds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField, StructType

from vectorloom.errors import InvalidArgument
from vectorloom.functions import columns as C
from vectorloom.functions.quantize import Quantizer
from vectorloom.runtime import ship


#: Sequences of which a task holds partial sums before it hands them on.
HELD = 4_096
#: What names of cache types begin with; the bits of keys and values follow (fixed value).
DTYPE_PREFIX = "turboquant"


def is_cache_dtype(name: str) -> bool:
    bits = name.removeprefix(DTYPE_PREFIX)
    return name.startswith(DTYPE_PREFIX) and bits.isascii() and bits.isdigit() and 1 <= int(bits) <= 8


@dataclass(frozen=True)
class CacheConfig:
    """Head dimension, bits of keys and of values, tokens a page."""

    d_head: int
    b_key: int = 4
    b_val: int = 4
    page_size: int = 16
    seed: int = 42

    def __post_init__(self):
        if self.d_head < 1 or self.page_size < 1:
            raise InvalidArgument("head dimension and page size from 1")
        if not (1 <= self.b_key <= 8 and 1 <= self.b_val <= 8):
            raise InvalidArgument("bit width from 1 to 8")

    @classmethod
    def from_dtype(cls, name: str, d_head: int, page_size: int = 16) -> CacheConfig:
        """Both bit widths from a cache type's name."""
        if not is_cache_dtype(name):
            raise InvalidArgument(f"{name!r} isn't {DTYPE_PREFIX} and 1 to 8 bits")
        bits = int(name.removeprefix(DTYPE_PREFIX))
        return cls(d_head, bits, bits, page_size)

    @property
    def keys(self) -> Quantizer:
        return Quantizer(self.d_head, self.b_key, self.seed)

    @property
    def values(self) -> Quantizer:
        return Quantizer(self.d_head, self.b_val, self.seed)

    def code_bytes(self, tokens: int) -> tuple[int, int]:
        """Bytes of packed key and value codes."""
        return tuple(tokens * ((q.out_dim * q.bits + 7) // 8) for q in (self.keys, self.values))


def encode(cache: DataFrame, config: CacheConfig) -> DataFrame:
    """(sequence, position, key, value) to the same with key and value as struct(codes, norm)."""
    ship(cache.sparkSession)
    return cache.select("sequence", "position", C.quantize(config.keys)("key").alias("key"), C.quantize(config.values)("value").alias("value"))


def attention(coded: DataFrame, queries: DataFrame, config: CacheConfig) -> DataFrame:
    """sequence, output: softmax(q k / sqrt(d)) v for the query (sequence, query) of each sequence.

    One query a sequence; a sequence without cached rows has no output.
    """
    ship(coded.sparkSession)
    q, v = config.keys, config.values
    width, wide = ((x.out_dim * x.bits + 7) // 8 for x in (q, v))
    scale = 1 / math.sqrt(config.d_head)
    kind = coded.schema["sequence"].dataType
    partial = StructType([StructField("sequence", kind), StructField("top", DoubleType()), StructField("total", DoubleType()), StructField("part", BinaryType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        schema = None

        def out() -> pa.RecordBatch:
            rows = [(s, t, w, x.tobytes()) for s, (t, w, x) in held.items()]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], schema), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.binary())], ["sequence", "top", "total", "part"])

        for b in batches:
            if not b.num_rows:
                continue
            schema = b.column("sequence").type
            keys = q.decode(C.binary_rows(b.column("k_codes"), width), b.column("k_norm").to_numpy(zero_copy_only=False))
            values = v.decode(C.binary_rows(b.column("v_codes"), wide), b.column("v_norm").to_numpy(zero_copy_only=False))
            score = (keys * C.matrix(b.column("query"), config.d_head)).sum(axis=1) * scale
            names = b.column("sequence").to_pylist()
            where: dict = {}
            for i, s in enumerate(names):
                where.setdefault(s, []).append(i)
            for s, at in where.items():
                top = float(score[at].max())
                w = np.exp(score[at] - top)
                one = (top, float(w.sum()), w @ values[at])
                held[s] = _merged(held[s], one) if s in held else one
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = zip(table.column("top").to_pylist(), table.column("total").to_pylist(), table.column("part").to_pylist(), strict=True)
        got = None
        for t, w, x in rows:
            one = (t, w, np.frombuffer(x, np.float64))
            got = _merged(got, one) if got else one
        return pa.table({"sequence": pa.array([key[0].as_py()], key[0].type), "output": pa.array([(got[2] / got[1]).tolist()], pa.list_(pa.float64()))})

    rows = coded.join(queries.select("sequence", "query"), "sequence")
    rows = rows.selectExpr("sequence", "query", "key.codes AS k_codes", "key.norm AS k_norm", "value.codes AS v_codes", "value.norm AS v_norm")
    result = StructType([StructField("sequence", kind), StructField("output", ArrayType(DoubleType()))])
    return rows.mapInArrow(fold, partial).groupBy("sequence").applyInArrow(merge, result)


def _merged(a: tuple, b: tuple) -> tuple:
    """Two partial softmaxes as one."""
    top = max(a[0], b[0])
    x, y = math.exp(a[0] - top), math.exp(b[0] - top)
    return top, x * a[1] + y * b[1], x * a[2] + y * b[2]
