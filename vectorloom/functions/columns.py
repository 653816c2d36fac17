"""The kernels as column functions and SQL functions: Arrow batches in, one numpy call a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions import rotation
from vectorloom.functions.quantize import ProdQuantizer, Quantizer

CODE = "codes binary, norm float"
PROD = "codes binary, norm float, signs binary, residual_norm float"


def inner_product(a, b) -> Column:
    """Sum over the shorter length, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(inner_product(a, a))


def normalize(a) -> Column:
    n = norm(a)
    return F.when(n < 1e-30, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def problem(a, dim: int) -> Column:
    """Why a vector can't be stored, or null."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(a.isNull() | (F.size(a) <= 0), "empty").when(F.size(a) != dim, "dim").when(bad, "not finite")


def matrix(values: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as float64 rows."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), dim)


def binary_rows(values: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(len(values), width)


def rows_of(m: np.ndarray, kind=pa.float64()) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(m).ravel(), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1] or 1), pa.int32()), flat)


def _binary(m: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in m], pa.binary())


def rotate(dim: int, seed: int, inverse: bool = False):
    """array<double> -> array<double>."""

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        x = matrix(v, rotation.next_pow2(dim) if inverse else dim)
        return rows_of(rotation.unrotate(x, seed, dim) if inverse else rotation.rotate(x, seed))

    return run


def quantize(q: Quantizer):
    """array<float> -> struct(codes, norm)."""

    @F.arrow_udf(CODE)
    def run(v: pa.Array) -> pa.Array:
        packed, n = q.encode(matrix(v, q.dim))
        return pa.StructArray.from_arrays([_binary(packed), pa.array(n, pa.float32())], ["codes", "norm"])

    return run


def code_indices(q: Quantizer):
    """array<float> -> array<int>: centroid numbers of each rotated coordinate."""

    @F.arrow_udf("array<int>")
    def run(v: pa.Array) -> pa.Array:
        return rows_of(q.indices(matrix(v, q.dim))[0], pa.int32())

    return run


def dequantize(q: Quantizer):
    """(codes, norm) -> array<double>."""

    @F.arrow_udf("array<double>")
    def run(codes: pa.Array, n: pa.Array) -> pa.Array:
        width = (q.out_dim * q.bits + 7) // 8
        return rows_of(q.decode(binary_rows(codes, width), n.to_numpy(zero_copy_only=False)))

    return run


def prod_quantize(q: ProdQuantizer):
    """array<float> -> struct(codes, norm, signs, residual_norm)."""

    @F.arrow_udf(PROD)
    def run(v: pa.Array) -> pa.Array:
        codes, n, signs, rest = q.encode(matrix(v, q.dim))
        return pa.StructArray.from_arrays([_binary(codes), pa.array(n, pa.float32()), _binary(signs), pa.array(rest, pa.float32())], ["codes", "norm", "signs", "residual_norm"])

    return run


def prod_estimate(q: ProdQuantizer, query: list[float], estimator: str = "unbiased"):
    """(codes, norm, signs, residual_norm) -> double: estimated inner product with one query."""
    asked = np.asarray([query], np.float64)

    @F.arrow_udf("double")
    def run(codes: pa.Array, n: pa.Array, signs: pa.Array, rest: pa.Array) -> pa.Array:
        width = (q.mse.out_dim * q.mse.bits + 7) // 8
        s = binary_rows(signs, (q.rows + 7) // 8)
        got = q.estimate(asked, binary_rows(codes, width), n.to_numpy(zero_copy_only=False), s, rest.to_numpy(zero_copy_only=False), estimator)
        return pa.array(got[:, 0], pa.float64())

    return run


def register(spark: SparkSession, dim: int, bits: int = 4, seed: int = 42) -> None:
    """SQL functions vec_rotate, vec_quantize and vec_dequantize for one setting."""
    q = Quantizer(dim, bits, seed)
    spark.udf.register("vec_rotate", rotate(dim, seed))
    spark.udf.register("vec_quantize", quantize(q))
    spark.udf.register("vec_dequantize", dequantize(q))


def parse_vector(text) -> Column:
    """``[1, 2]`` or ``{1,2}`` as array<float>; null where any element isn't a number or there is none."""
    body = F.regexp_extract(text, r"^\s*[\[{](.*)[\]}]\s*$", 1)
    parts = F.transform(F.split(body, ","), lambda x: F.trim(x).try_cast("float"))
    return F.when(text.isNotNull() & (F.trim(body) != "") & ~F.exists(parts, lambda x: x.isNull()), parts)


def id_text(value) -> Column:
    """Ids as text: a number without fraction drops it; empty is null."""
    whole = F.regexp_replace(value.cast("string"), r"^(-?[0-9]+)\.0+$", "$1")
    return F.when(whole != "", whole)


def segment_bytes(count, out_dim: int, bits: int) -> Column:
    """Estimated bytes of a sealed segment: codes of the padded dimension, norm and row overhead."""
    return (count * ((out_dim * bits + 7) // 8 + 4 + 24)).cast("long")
