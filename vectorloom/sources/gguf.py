"""GGUF version 3 files: metadata, tensor infos, dequantising reader, writer, conversion from SafeTensors."""

from __future__ import annotations

import functools
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition
from pyspark.sql.types import StructType

from vectorloom.errors import CorruptFile, InvalidArgument
from vectorloom.functions import packing
from vectorloom.sources import safetensors
from vectorloom.sources.writing import TensorWriter

# Fixed values of the format: metadata kinds, and tensor types with (block length, block bytes).
SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
STRING, ARRAY = 8, 9
TYPES = {0: ("F32", 1, 4), 1: ("F16", 1, 2), 2: ("Q4_0", 32, 18), 3: ("Q4_1", 32, 20), 8: ("Q8_0", 32, 34)}
MAX_COUNT, MAX_STRING = 1 << 20, 1 << 26
ALIGN, BLOCK = 32, 32


class _Cursor:
    def __init__(self, raw: memoryview):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise CorruptFile("ends early")
        self.at += n
        return bytes(self.raw[self.at - n : self.at])

    def number(self, kind: str):
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]

    def text(self) -> str:
        n = self.number("<Q")
        if n > min(MAX_STRING, len(self.raw) - self.at):
            raise CorruptFile("string length out of range")
        return self.take(n).decode("utf-8", "replace")

    def value(self, kind: int, depth: int = 0):
        if kind in SCALARS:
            return self.number(SCALARS[kind])
        if kind == STRING:
            return self.text()
        if kind != ARRAY or depth > 4:
            raise CorruptFile(f"metadata kind {kind}")
        inner, n = self.number("<I"), self.number("<Q")
        if n > len(self.raw) - self.at:
            raise CorruptFile("array length out of range")
        return [self.value(inner, depth + 1) for _ in range(n)]


def read_header(path: str) -> tuple[dict[str, object], dict[str, dict], int]:
    """(metadata, tensors, start of data). Counts are checked before anything is allocated for them."""
    raw = memoryview(np.memmap(path, np.uint8, "r")) if os.path.getsize(path) else memoryview(b"")
    c = _Cursor(raw)
    if c.take(4) != b"GGUF" or c.number("<I") != 3:
        raise CorruptFile("not GGUF version 3")
    n_tensors, n_meta = c.number("<Q"), c.number("<Q")
    if max(n_tensors, n_meta) > min(MAX_COUNT, len(raw)):
        raise CorruptFile("count out of range")
    meta = {}
    for _ in range(n_meta):
        key = c.text()
        meta[key] = c.value(c.number("<I"))
    tensors: dict[str, dict] = {}
    for _ in range(n_tensors):
        name, dims = c.text(), c.number("<I")
        if dims > 8:
            raise CorruptFile("too many dimensions")
        shape = [c.number("<Q") for _ in range(dims)]
        tensors[name] = {"dims": shape, "type": c.number("<I"), "offset": c.number("<Q")}
    align = int(meta.get("general.alignment", 32))
    if align < 1:
        raise CorruptFile("alignment")
    return meta, tensors, -(-c.at // align) * align


def dequantize(raw: bytes, kind: int) -> np.ndarray:
    """Numbers of whole blocks."""
    if kind not in TYPES:
        raise InvalidArgument(f"tensor type {kind} isn't decoded")
    name, _, width = TYPES[kind]
    if name in ("F32", "F16"):
        return np.frombuffer(raw, "<f4" if name == "F32" else "<f2").astype(np.float32)
    block = np.frombuffer(raw, np.uint8).reshape(-1, width)
    half = lambda a: np.ascontiguousarray(a).view("<f2").astype(np.float32)
    scale = half(block[:, :2])
    if name == "Q8_0":
        return (scale * block[:, 2:].view(np.int8)).ravel()
    codes = block[:, 2 if name == "Q4_0" else 4 :]
    nibbles = np.concatenate((codes & 15, codes >> 4), axis=1).astype(np.float32)
    return (scale * (nibbles - 8)).ravel() if name == "Q4_0" else (scale * nibbles + half(block[:, 2:4])).ravel()


def _head(infos: list[tuple[str, list[int], int, int]], metadata: dict[str, object] | None, align: int) -> bytes:
    """The padded header of tensors (name, shape, kind, offset); str, bool, int, float metadata."""

    def text(s: str) -> bytes:
        return struct.pack("<Q", len(s.encode())) + s.encode()

    def value(v) -> bytes:
        kind = STRING if isinstance(v, str) else 7 if isinstance(v, bool) else 11 if isinstance(v, int) else 12
        return struct.pack("<I", kind) + (text(v) if kind == STRING else struct.pack(SCALARS[kind], v))

    meta = {"general.alignment": align, **(metadata or {})}
    head = b"GGUF" + struct.pack("<IQQ", 3, len(infos), len(meta))
    for k, v in meta.items():
        head += text(k) + (struct.pack("<II", 4, v) if k == "general.alignment" else value(v))
    for name, shape, kind, at in infos:
        head += text(name) + struct.pack("<I", len(shape)) + b"".join(struct.pack("<Q", d) for d in reversed(shape)) + struct.pack("<IQ", kind, at)
    return head + b"\0" * (-len(head) % align)


def write(path: str, tensors: dict[str, np.ndarray], metadata: dict[str, object] | None = None, align: int = 32) -> None:
    """float32 and float16 arrays in the given order."""
    at, infos, body = 0, [], []
    for name, a in tensors.items():
        infos.append((name, list(a.shape), {"float32": 0, "float16": 1}[a.dtype.name], at))
        raw = np.ascontiguousarray(a).tobytes()
        raw += b"\0" * (-len(raw) % align)
        body.append(raw)
        at += len(raw)
    with open(path, "wb") as f:
        f.write(_head(infos, metadata, align) + b"".join(body))


def _one_tensor(kind: int, name: str, rows: int, dim: int, ids: list[str] | None) -> bytes:
    return _head([(name, [rows, dim], kind, 0)], None, ALIGN)


def block_bytes(bits: int) -> int:
    """Bytes of a block of codes: half-precision norm, 16-bit seed offset, 32 packed codes."""
    if not 1 <= bits <= 8:
        raise InvalidArgument("bit width from 1 to 8")
    return 4 + BLOCK * bits // 8


def encode_blocks(norms: np.ndarray, offsets: np.ndarray, codes: np.ndarray, bits: int) -> bytes:
    """Blocks of (rows, 32) codes with a norm and a seed offset each."""
    codes = np.asarray(codes)
    if codes.ndim != 2 or codes.shape[1] != BLOCK:
        raise InvalidArgument(f"a block has {BLOCK} codes")
    out = np.empty((len(codes), block_bytes(bits)), np.uint8)
    out[:, :2] = np.asarray(norms, "<f2").reshape(-1, 1).view(np.uint8)
    out[:, 2:4] = np.asarray(offsets, "<u2").reshape(-1, 1).view(np.uint8)
    out[:, 4:] = packing.pack(codes, bits)
    return out.tobytes()


def decode_blocks(raw: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(norms, seed offsets, codes) of whole blocks."""
    width = block_bytes(bits)
    if len(raw) % width:
        raise CorruptFile(f"a block has {width} bytes")
    block = np.frombuffer(raw, np.uint8).reshape(-1, width)
    norms = np.ascontiguousarray(block[:, :2]).view("<f2").astype(np.float32).ravel()
    return norms, np.ascontiguousarray(block[:, 2:4]).view("<u2").ravel(), packing.unpack(np.ascontiguousarray(block[:, 4:]), bits, BLOCK)


def convert(source: str, target: str) -> None:
    """SafeTensors to GGUF: floats become F16 or F32, other types are refused; metadata gets a prefix."""
    tensors, meta, start = safetensors.read_header(source)
    out = {}
    with open(source, "rb") as f:
        for name, t in sorted(tensors.items()):
            if t["dtype"] not in safetensors.FLOATS:
                raise InvalidArgument(f"{name}: {t['dtype']} can't be converted")
            f.seek(start + t["data_offsets"][0])
            x = safetensors.to_float32(f.read(t["data_offsets"][1] - t["data_offsets"][0]), t["dtype"]).reshape(t["shape"])
            out[name] = x.astype(np.float16) if t["dtype"] == "F16" else x
    write(target, out, {f"safetensors.{k}": v for k, v in meta.items()})


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class GgufReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.inspect = options["path"], options.get("mode") == "inspect"
        self.wanted, self.rows = options.get("tensor"), int(options.get("rowsPerPartition", 100_000))

    def _tensor(self) -> tuple[dict, int, int, int]:
        _, tensors, start = read_header(self.path)
        t = tensors[safetensors.pick(list(tensors), self.wanted, required=True)]
        dim = t["dims"][0] if t["dims"] else 1
        rows = int(np.prod(t["dims"][1:], dtype=object)) if len(t["dims"]) > 1 else 1
        return t, rows, dim, start + t["offset"]

    def partitions(self) -> list[InputPartition]:
        if self.inspect:
            return [_Rows(0, 0)]
        n = self._tensor()[1]
        return [_Rows(i, min(n, i + self.rows)) for i in range(0, n, self.rows)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        if self.inspect:
            meta, tensors, _ = read_header(self.path)
            rows = [(n, TYPES.get(t["type"], (f"type {t['type']}",))[0], t["dims"], None) for n, t in sorted(tensors.items())] + [(n, None, None, str(v)) for n, v in sorted(meta.items())]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()), strict=True)], ["name", "dtype", "shape", "value"])
            return
        t, _, dim, start = self._tensor()
        if t["type"] not in TYPES:
            raise InvalidArgument(f"tensor type {t['type']} isn't decoded")
        _, length, width = TYPES[t["type"]]
        if dim % length:
            raise CorruptFile("rows aren't whole blocks")
        row = dim // length * width
        with open(self.path, "rb") as f:
            for at in range(partition.first, partition.last, 8192):
                n = min(8192, partition.last - at)
                f.seek(start + at * row)
                raw = f.read(n * row)
                if len(raw) < n * row:
                    raise CorruptFile("data ends early")
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(dequantize(raw, t["type"])))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), values], ["row", "values"])


class GgufSource(DataSource):
    """``format("gguf")``: rows (row, values) of the tensor named by option ``tensor``; mode=inspect lists.

    Writing (values) makes one file of that tensor, as F32, or as F16 by option ``dtype``.
    """

    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return "name string, dtype string, shape array<long>, value string" if self.options.get("mode") == "inspect" else "row long, values array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return GgufReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        half = self.options.get("dtype", "F32") == "F16"
        return TensorWriter(dict(self.options), schema, overwrite, functools.partial(_one_tensor, int(half)), half=half, pad=ALIGN, keep_ids=False)


def register(spark) -> None:
    """Both formats in a session."""
    from vectorloom.runtime import ship

    ship(spark)
    spark.dataSource.register(safetensors.SafetensorsSource)
    spark.dataSource.register(GgufSource)
