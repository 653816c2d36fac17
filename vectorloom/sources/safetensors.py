"""SafeTensors files: header rules, reading rows of a tensor, writing vectors."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition
from pyspark.sql.types import StructType

from vectorloom.errors import CorruptFile, InvalidArgument
from vectorloom.sources.writing import TensorWriter

MAX_HEADER = 100 << 20
SIZES = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4, "I16": 2, "I8": 1, "U8": 1, "BOOL": 1}
FLOATS = ("F64", "F32", "F16", "BF16")


def read_header(path: str) -> tuple[dict[str, dict], dict[str, str], int]:
    """(tensors, metadata, start of data); ranges must tile the data."""
    with open(path, "rb") as f:
        size = f.seek(0, 2)
        f.seek(0)
        head = f.read(8)
        if len(head) < 8:
            raise CorruptFile("shorter than its header length")
        n = struct.unpack("<Q", head)[0]
        if n > MAX_HEADER or 8 + n > size:
            raise CorruptFile("header length out of range")
        try:
            header = json.loads(f.read(n))
        except ValueError as e:
            raise CorruptFile(f"header isn't JSON: {e}") from None
    if not isinstance(header, dict):
        raise CorruptFile("header isn't an object")
    meta = header.pop("__metadata__", {})
    at = 0
    for name, t in sorted(header.items(), key=lambda x: x[1].get("data_offsets", [0])[0]):
        try:
            dtype, shape, (begin, end) = t["dtype"], t["shape"], t["data_offsets"]
        except (KeyError, TypeError, ValueError):
            raise CorruptFile(f"tensor {name} is incomplete") from None
        if dtype not in SIZES:
            raise CorruptFile(f"tensor {name}: unknown dtype {dtype}")
        if begin != at or end < begin:
            raise CorruptFile(f"tensor {name}: gap or overlap at {begin}")
        if any(d < 0 for d in shape) or end - begin != SIZES[dtype] * int(np.prod(shape, dtype=object)):
            raise CorruptFile(f"tensor {name}: its range isn't its shape")
        at = end
    if 8 + n + at != size:
        raise CorruptFile("data doesn't end with the last tensor")
    return header, meta, 8 + n


def to_float32(raw: bytes, dtype: str) -> np.ndarray:
    if dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
    if dtype not in FLOATS:
        raise InvalidArgument(f"{dtype} isn't a float type")
    return np.frombuffer(raw, {"F64": "<f8", "F32": "<f4", "F16": "<f2"}[dtype]).astype(np.float32)


def shape_2d(shape: list[int]) -> tuple[int, int]:
    """One dimension is one row; more than two are refused."""
    if len(shape) == 1:
        return 1, shape[0]
    if len(shape) == 2:
        return shape[0], shape[1]
    raise InvalidArgument("one or two dimensions")


def pick(names: list[str], wanted: str | None, required: bool = False) -> str:
    if wanted:
        if wanted not in names:
            raise InvalidArgument(f"no tensor {wanted}")
        return wanted
    if required or len(names) != 1:
        raise InvalidArgument("name a tensor: " + ", ".join(sorted(names)))
    return names[0]


def _head(tensors: dict[str, dict], metadata: dict[str, str] | None) -> bytes:
    raw = json.dumps(({"__metadata__": dict(sorted(metadata.items()))} if metadata else {}) | tensors).encode()
    raw += b" " * (-len(raw) % 8)
    if len(raw) > MAX_HEADER:
        raise InvalidArgument("a header has at most 100 MB: write parts, or leave out ids")
    return struct.pack("<Q", len(raw)) + raw


def _one_tensor(name: str, rows: int, dim: int, ids: list[str] | None) -> bytes:
    return _head({name: {"dtype": "F32", "shape": [rows, dim], "data_offsets": [0, rows * dim * 4]}}, None if ids is None else {"ids": "\n".join(ids)})


def write(path: str, tensors: dict[str, np.ndarray], metadata: dict[str, str] | None = None) -> None:
    """Arrays in order of name."""
    kinds = {"float64": "F64", "float32": "F32", "float16": "F16", "int64": "I64", "int32": "I32", "int16": "I16", "int8": "I8", "uint8": "U8", "bool": "BOOL"}
    header, at = {}, 0
    for name, a in sorted(tensors.items()):
        header[name] = {"dtype": kinds[a.dtype.name], "shape": list(a.shape), "data_offsets": [at, at + a.nbytes]}
        at += a.nbytes
    with open(path, "wb") as f:
        f.write(_head(header, metadata))
        for _, a in sorted(tensors.items()):
            f.write(np.ascontiguousarray(a).tobytes())


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SafetensorsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.inspect = options["path"], options.get("mode") == "inspect"
        self.wanted, self.rows = options.get("tensor"), int(options.get("rowsPerPartition", 100_000))

    def _tensor(self) -> tuple[dict, int, int, int]:
        tensors, _, start = read_header(self.path)
        t = tensors[pick(list(tensors), self.wanted)]
        rows, dim = shape_2d(t["shape"])
        return t, rows, dim, start + t["data_offsets"][0]

    def partitions(self) -> list[InputPartition]:
        if self.inspect:
            return [_Rows(0, 0)]
        n = self._tensor()[1]
        return [_Rows(i, min(n, i + self.rows)) for i in range(0, n, self.rows)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        if self.inspect:
            tensors, meta, _ = read_header(self.path)
            rows = [(n, t["dtype"], t["shape"], None) for n, t in sorted(tensors.items())] + [(n, None, None, v) for n, v in sorted(meta.items())]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()), strict=True)], ["name", "dtype", "shape", "value"])
            return
        t, _, dim, start = self._tensor()
        width = SIZES[t["dtype"]] * dim
        with open(self.path, "rb") as f:
            for at in range(partition.first, partition.last, 8192):
                n = min(8192, partition.last - at)
                f.seek(start + at * width)
                x = to_float32(f.read(n * width), t["dtype"])
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), values], ["row", "values"])


class SafetensorsSource(DataSource):
    """``format("safetensors")``: rows (row, values) of one tensor; option mode=inspect lists tensors and metadata.

    Writing (values[, id]) makes one file of tensor ``vectors`` (option ``tensor``) with ids in its metadata.
    """

    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return "name string, dtype string, shape array<long>, value string" if self.options.get("mode") == "inspect" else "row long, values array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SafetensorsReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TensorWriter(dict(self.options), schema, overwrite, _one_tensor, half=False, pad=1, keep_ids=True)


#: Keys and version of the quantiser's parameters in a file's metadata (fixed values).
META_KEYS = {"version": "turboquant_version", "rotator_seed": "rotator_seed", "rotator_type": "rotator_type", "codebook_id": "codebook_id", "bit_width": "bit_width", "variant": "variant"}
META_VERSION = "0.1"


def quantiser_metadata(dim: int, bits: int, seed: int, variant: str = "mse") -> dict[str, str]:
    """A quantiser's parameters as a file's metadata."""
    values = {"version": META_VERSION, "rotator_seed": seed, "rotator_type": "hadamard", "codebook_id": f"d{dim}_b{bits}_lloyd_max_v1", "bit_width": bits, "variant": variant}
    return {META_KEYS[k]: str(v) for k, v in values.items()}


def read_quantiser_metadata(metadata: dict[str, str]) -> dict[str, str | int]:
    """The parameters back: missing numbers are 0, missing texts empty; a number that isn't one is refused."""
    out: dict[str, str | int] = {}
    for name, key in META_KEYS.items():
        text = metadata.get(key, "")
        if name in ("rotator_seed", "bit_width"):
            if text and not (text.isascii() and text.isdigit()):
                raise InvalidArgument(f"{key}: {text!r} is not a number")
            out[name] = int(text or 0)
        else:
            out[name] = text
    return out


def export_collection(collection, path: str) -> int:
    """A collection's live rows as one file with the quantiser's parameters; codes without raw vectors are reconstructed."""
    c = collection.config
    return export(collection.snapshot(), path, quantiser_metadata(c.dim, c.bit_width, c.rotator_seed, c.variant))


def import_collection(engine, path: str, config, prefix: str = "", tensor: str | None = None, source: str = "safetensors") -> int:
    """A new collection from a tensor's rows; ids are a prefix and the row's number."""
    return engine.import_rows(import_rows(engine.spark, path, prefix, tensor, source), config)


def export(rows: DataFrame, path: str, parameters: dict[str, str] | None = None, most: int = 1 << 26) -> int:
    """One file of tensor ``vectors`` and ids in its metadata, from (id, values) in id order.

    The format is one file, so its numbers pass through the driver: at most ``most`` of them.
    """
    got = rows.select("id", "values").orderBy("id").limit(most + 1).toPandas()
    if len(got) and len(got) * len(got["values"].iloc[0]) > most:
        raise InvalidArgument(f"more than {most} numbers; export parts")
    x = np.stack([np.asarray(v, np.float32) for v in got["values"]]) if len(got) else np.empty((0, 0), np.float32)
    write(path, {"vectors": x}, {"ids": "\n".join(got["id"]), **(parameters or {})})
    return len(got)


def import_rows(spark: SparkSession, path: str, prefix: str = "", tensor: str | None = None, source: str = "safetensors") -> DataFrame:
    """(id, values) of a tensor; ids are a prefix and the row's number."""
    from pyspark.sql import functions as F

    reader = spark.read.format(source)
    if tensor:
        reader = reader.option("tensor", tensor)
    return reader.load(path).select(F.concat(F.lit(prefix), F.col("row").cast("string")).alias("id"), "values")
