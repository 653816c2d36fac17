"""Token-id store: one concatenated id array per segment, document boundaries Elias-Fano encoded.

A segment is one binary value (fixed layout below) in a Parquet row, so any store that Spark writes to can
hold it, and a task that is lost is simply run again. Documents stand in ascending ``doc_id`` order: range
partitions follow each other, and so do the segments of a partition. Their number follows the bytes of the texts. Rows
of one doc_id (or none) may fill many partitions: text and place decide among them. ``start`` of a document is the ids
of earlier partitions, plus the ids of earlier segments, plus a select on the segment's boundaries.

Segment layout (little endian): magic ``EFTS``, then uint32 version, uint64 n_docs, uint64 n_null, uint64 n_ids, uint32
id width in bytes, int64 smallest doc_id, then two Elias-Fano sequences (the boundaries; the doc_ids that aren't null
less the smallest), each as uint32 low bits, uint64 bytes of low part and of high part, low part, high part; then the
ids. Select directories are counts of bits at every SAMPLE_EVERY bytes, made when a segment is opened.

Edge cases: a null or empty text has no ids but its end id; null doc_ids come first; rows that repeat are
each stored; an empty table gives no segment and no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import tokens
from vectorloom.runtime import Scratch, ship

#: Segments are closed once they hold so many ids; one document is never cut. Bytes of text of a range partition.
SEGMENT_IDS, PART_BYTES = 1 << 20, 1 << 26
SAMPLE_EVERY = 32
_HEAD, _SEQUENCE = struct.Struct("<4sIQQQIq"), struct.Struct("<IQQ")
_VERSION = 2
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the k-th set bit of each byte.
_NTH = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence in about ``n * (2 + log2(universe / n))`` bits, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        pad = np.zeros(-len(high) % SAMPLE_EVERY, np.uint8)
        blocks = _ONES[np.concatenate((high, pad))].reshape(-1, SAMPLE_EVERY).sum(axis=1)
        self.ahead = np.concatenate(([0], np.cumsum(blocks))).astype(np.uint32)  # ones before each block of bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.empty(0, np.uint8)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        unary[at] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"))

    def select(self, i) -> np.ndarray:
        """The i-th values: the block of the i-th one by the directory, its byte within, its bit within that."""
        asked = np.asarray(i, np.int64)
        i = asked.ravel()
        if not i.size:
            return np.zeros(asked.shape, np.uint64)
        if i.min() < 0 or i.max() >= self.n:
            raise IndexError("no such value")
        block = np.searchsorted(self.ahead, i, side="right") - 1
        left, byte = i - self.ahead[block], block * SAMPLE_EVERY
        todo = np.arange(len(i))
        while True:
            ones = _ONES[self.high[byte[todo]]]
            on = ones <= left[todo]
            todo = todo[on]
            if not len(todo):
                break
            left[todo] -= ones[on]
            byte[todo] += 1
        high = (8 * byte + _NTH[self.high[byte], left] - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits) | self._low(i)).reshape(asked.shape)

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(i.shape, np.uint64)
        first = i * self.low_bits
        for k in range(self.low_bits):
            bit = first + k
            out |= (self.low[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def pack(self) -> bytes:
        return _SEQUENCE.pack(self.low_bits, self.low.nbytes, self.high.nbytes) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def unpack(cls, raw: bytes, at: int, n: int) -> tuple[EliasFano, int]:
        """A sequence of n values at a place of ``raw``, and the place after it."""
        low_bits, n_low, n_high = _SEQUENCE.unpack_from(raw, at)
        at += _SEQUENCE.size
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, n_low, at), np.frombuffer(raw, np.uint8, n_high, at + n_low)), at + n_low + n_high


def write_segment(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One segment from documents in order, null doc_ids first; ids are little-endian uint32 bytes."""
    ends = EliasFano.encode(np.cumsum([len(x) >> 2 for x in ids]))
    all_ids = np.frombuffer(b"".join(ids), "<u4").astype("<u2" if width == 2 else "<u4")
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    named = EliasFano.encode(np.array([d - least for d in known], np.uint64))
    return _HEAD.pack(b"EFTS", _VERSION, len(ids), len(ids) - len(known), len(all_ids), width, least) + ends.pack() + named.pack() + all_ids.tobytes()


class Segment:
    """A segment read back: document ``i`` has the ids between select(i - 1) and select(i)."""

    def __init__(self, raw: bytes):
        magic, version, self.n_docs, self.n_null, self.n_ids, width, self.least = _HEAD.unpack_from(raw)
        if magic != b"EFTS" or version != _VERSION:
            raise ValueError("not a token segment")
        self.ends, at = EliasFano.unpack(raw, _HEAD.size, self.n_docs)
        self.named, at = EliasFano.unpack(raw, at, self.n_docs - self.n_null)
        self.ids = np.frombuffer(raw, "<u2" if width == 2 else "<u4", self.n_ids, at)

    def document(self, i: int) -> np.ndarray:
        """The ids of one document: two selects, nothing else is unpacked."""
        return self.ids[int(self.ends.select(i - 1)) if i else 0 : int(self.ends.select(i))]

    def doc_ids(self, i: np.ndarray) -> pa.Array:
        """The doc_ids of documents, by select."""
        i = np.asarray(i, np.int64)
        out = np.zeros(len(i), np.int64)
        known = i >= self.n_null
        out[known] = (self.named.select(i[known] - self.n_null) + np.uint64(self.least & (1 << 64) - 1)).view(np.int64)
        return pa.array(out, mask=~known)


_SEGMENT_SCHEMA = "part int, seg int, start_in_part long, n_docs long, n_ids long, segment binary"


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, parts: int | None = None) -> None:
    """Tokenise ``docs`` (doc_id, text) and write the store's segments as a Parquet table at ``path``."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    end = struct.pack("<I", end_id)
    width = 2 if max(tokens.tokenizer(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_docs: list[int | None] = []
        held_ids: list[bytes] = []
        now, seg, before, n = None, 0, 0, 0

        def close() -> pa.RecordBatch:
            raw = write_segment(held_docs, held_ids, width)
            row = [[now], [seg], [before], [len(held_docs)], [n], [raw]]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)

        names = ["part", "seg", "start_in_part", "n_docs", "n_ids", "segment"]
        for b in batches:
            for part, doc, ids in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), tokens.encode_column(tokenizer_path, b.column("text")), strict=True):
                if held_docs and (part != now or n >= SEGMENT_IDS):
                    yield close()
                    seg, before = (seg + 1, before + n) if part == now else (0, 0)
                    held_docs, held_ids, n = [], [], 0
                now = part
                held_docs.append(doc)
                held_ids.append(ids + end)
                n += len(ids) // 4 + 1
        if held_docs:
            yield close()

    # texts are dealt out before they are tokenised: finding the ranges evaluates what is dealt twice
    order = [F.col("doc_id").asc_nulls_first(), "tie", "came_from"]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.spark_partition_id().alias("came_from"))
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    placed.mapInArrow(segments, _SEGMENT_SCHEMA).write.parquet(path)


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a store: doc_id, start, n_tokens, ids_crc32 (and ids, where asked), read from its segments.

    The ids of earlier partitions are one sum for each range partition; their number is set when the store is
    written (PART_BYTES of text each).
    """
    ship(spark)
    table = spark.read.schema(_SEGMENT_SCHEMA).parquet(path)
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, at = {}, 0
    for row in totals:
        before[row["part"]] = at
        at += row["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base, raw in zip(b.column("part").to_pylist(), b.column("start_in_part").to_pylist(), b.column("segment").to_pylist(), strict=True):
                s = Segment(raw)
                asked = np.arange(s.n_docs)
                ends = s.ends.select(asked).astype(np.int64)
                starts = np.concatenate(([0], s.ends.select(asked[1:] - 1).astype(np.int64)))
                wide = s.ids.astype("<u4").tobytes()
                cuts = [wide[4 * i : 4 * j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [s.doc_ids(asked), pa.array(starts + (before[part] + base)), pa.array(ends - starts), pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(c, "<u4").astype(np.int64).tolist() for c in cuts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return table.select("part", "start_in_part", "segment").mapInArrow(decode, schema)


def store_and_read(docs: DataFrame, tokenizer_path: str, end_id: int, parts: int | None = None) -> DataFrame:
    """Write a store in the shared folder and return its documents."""
    scratch = Scratch(docs.sparkSession, "tokens")
    path = scratch.path("store")
    write_store(docs, path, tokenizer_path, end_id, parts)
    return read_store(docs.sparkSession, path)
