"""Exact Jaccard join on word shingles by vertical partitioning of a global shingle order.

1. One pass hashes every text's distinct shingles. Texts with equal sets are one class from here on. Of each set
   only the first three tenths or so in hash order are kept.
2. Two linked sets share at least a tenth of the smaller one within those prefixes. Prefixes meet by hash range;
   classes with fewer shared shingles than that have no partner and leave. A map task settles shingles that it
   has seen twice by itself, so a common shingle is sent once a task, not once a document.
3. The sets of the classes that stay are read again and their shingles are counted by hash range, each chunk of
   sets asking for its own; (count, hash) is the global order, rarest first. Shingles of one set alone are left out
   from here on. Sets that share none of the first ``n - ceil(0.8 n) + 1`` shingles in the order can't link; the
   others form candidate clusters. Counts are of 40 bits of a hash and more, at any size of the table; they order
   shingles and say which may be shared, so a collision costs time, never a link.
4. The global order is cut into FRAGMENTS of equal weight, and every set with it. A cluster is cut into blocks of
   bounded size. For each two blocks each fragment is a task of its own: it counts the partial overlaps of its pairs
   (a product of two small 0/1 matrices) and hands on one dense matrix of small numbers. Another stage sums the
   fragments' matrices for each pair and compares. Only the number of links of each class and a spanning forest leave
   it, never the pairs.
5. Components of the links, over classes; copies follow their class.

No step drops, caps or samples: the prefix tests are necessary conditions, the last counts are complete. Sets
hold 64-bit hashes of shingles.

Edge cases: a text with fewer words than a shingle is one shingle; one without words (or null) is empty, linked
with nothing, its own component; a null doc_id is linked with nothing and has a null component; rows that repeat
a doc_id are one vertex; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm import memo
from vectorloom.llm.components import connected_components
from vectorloom.runtime import Scratch, ship

#: Entries that a map task holds before it sends them; documents and shingles of a block; numbers in a fragment.
FLUSH, BLOCK_DOCS, BLOCK_SHINGLES, FRAGMENT = 1 << 20, 512, 1 << 20, 1 << 22
#: Parts of the global order that are counted apart.
FRAGMENTS = 4
#: Rows that a broadcast of class ids may have; beyond, the same join is shuffled.
BROADCAST_ROWS = 1 << 20
#: Fixed multipliers of the five word positions.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


#: Words kept per worker process; the table is emptied when full.
MAX_WORDS = 150_000


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; A-Z are lower-cased."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = memo.table("hashes", _WordHashes)
    if len(hashes) > MAX_WORDS:
        hashes.clear()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(w)
    if n < width:
        h = (w * _MIX[:n]).sum(keepdims=True, dtype=np.uint64) ^ np.uint64(n)
    else:
        h = w[: n - width + 1] * _MIX[0]
        for k in range(1, width):
            h += w[k : n - width + 1 + k] * _MIX[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _need(n: int, percent: int) -> int:
    """The overlap that a set of n must have with any partner."""
    return -(-percent * n // 100)


def _extra(n: int) -> int:
    return 1 + n // 10


def _signature(h: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(h.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _describe(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            n, hi, lo, prefix = [], [], [], []
            for d, text in zip(ids, b.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                h = shingle_set(text, width)
                n.append(len(h))
                if len(h) and d is not None:
                    s = _signature(h)
                    new = s[1] not in seen
                    seen.add(s[1])
                    prefix.append(h[: len(h) - _need(len(h), percent) + _extra(len(h))].tobytes() if new else None)
                else:
                    s = (-1, d if d is not None else 0)  # a class of its own
                    prefix.append(None)
                hi.append(s[0])
                lo.append(s[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(prefix, pa.binary())], ["doc_id", "n", "hi", "lo", "prefix"]
            )

    return run


def _emit(bucket: list[int], columns: list[list[bytes]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", *names])


def _cut(key: np.ndarray, buckets: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Arrays cut by hash range of ``key`` (sorted by it)."""
    b = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    at = np.searchsorted(b, np.arange(buckets + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(at)).tolist():
        yield k, [a[at[k] : at[k + 1]].tobytes() for a in arrays]


def _flushes(batches: Iterator[pa.RecordBatch], take) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, owners) of many rows at a time; ``take`` gives a batch's rows as (owner, hashes)."""
    owners, held, n = [], [], 0
    for b in batches:
        for owner, h in take(b):
            owners.append(np.full(len(h), owner, np.int64))
            held.append(h)
            n += len(h)
            if n >= FLUSH:
                yield np.concatenate(held), np.concatenate(owners)
                owners, held, n = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(owners)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights=values, minlength=len(u)).astype(np.int64)


def _pairs(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (shingle, owner) pairs in order."""
    o = np.lexsort((own, h))
    h, own = h[o], own[o]
    new = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])][: len(h)]
    return h[new], own[new]


def _prefix_parts(buckets: int):
    """Prefix entries by bucket; shingles of two classes in this task are settled here and sent once, without owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def take(b):
            for lo, raw in zip(b.column("lo").to_pylist(), b.column("prefix").to_pylist(), strict=True):
                yield lo, np.frombuffer(raw, "<u8")

        for h, own in _flushes(batches, take):
            h, own = _pairs(h, own)
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            n = np.diff(np.r_[first, len(h)])
            many = np.repeat(n > 1, n)
            who, count = _sums(own[many], np.ones(int(many.sum())))
            keep = np.zeros(len(h), bool)
            keep[first] = True
            sent = np.where(many, 0, own)[keep]
            bucket, cols = [], [[], [], [], []]
            for k, parts in _cut(h[keep], buckets, h[keep], sent):
                bucket.append(k)
                for c, p in zip(cols, [*parts, b"", b""], strict=True):
                    c.append(p)
            for j in range(0, len(who), 1 << 16):  # counts settled here, spread over the buckets
                bucket.append(int(who[j]) % buckets)
                for c, p in zip(cols, [b"", b"", who[j : j + (1 << 16)].tobytes(), count[j : j + (1 << 16)].tobytes()], strict=True):
                    c.append(p)
            yield _emit(bucket, cols, ["h", "own", "who", "count"])

    return run


def _blob(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _shared_counts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    h, own = _pairs(_blob(table, "h", "<u8"), _blob(table, "own", "<i8"))
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    n = np.diff(np.r_[first, len(h)])
    settled = np.logical_or.reduceat(own == 0, first) if len(first) else n > 0  # sent without owner: two classes or more
    shared = np.repeat((n > 1) | settled, n) & (own != 0)
    who, count = _sums(np.concatenate((own[shared], _blob(table, "who", "<i8"))), np.concatenate((np.ones(int(shared.sum())), _blob(table, "count", "<i8"))))
    return pa.table({"lo": pa.array(who, pa.int64()), "c": pa.array(count, pa.int64())})


def _sets(width: int):
    """The sets of classes that stay, each once a task, in chunks of about FLUSH shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        chunks = _Chunks()
        for b in batches:
            chunk, cid, n, cnt, raw = [], [], [], [], []
            for d, text, hi, lo, c in zip(*(b.column(x).to_pylist() for x in ("doc_id", "text", "hi", "lo", "cnt")), strict=True):
                h = shingle_set(text.encode() if text else None, width)
                if len(h) and d not in seen and _signature(h) == (hi, lo):
                    seen.add(d)
                    chunk.append(chunks.of(len(h)))
                    cid.append(d)
                    n.append(len(h))
                    cnt.append(c)
                    raw.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (chunk, cid, n, cnt)), pa.array(raw, pa.binary())], ["chunk", "cid", "n", "cnt", "set"])

    return run


class _Chunks:
    """Numbers for the chunks of one task's sets."""

    def __init__(self):
        from pyspark import TaskContext

        self.number, self.held = TaskContext.get().partitionId() << 32, 0

    def of(self, n: int) -> int:
        if self.held >= FLUSH:
            self.number, self.held = self.number + 1, 0
        self.held += n
        return self.number


def _rechunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks = _Chunks()
    for b in batches:
        chunk = pa.array([chunks.of(n) for n in b.column("n").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([chunk, *(b.column(x) for x in ("cid", "n", "cnt", "set"))], ["chunk", "cid", "n", "cnt", "set"])


def _key(h: np.ndarray) -> np.ndarray:
    """What shingles are counted by within a hash range."""
    return (h >> np.uint64(24)).astype("<u4")


def _chunk_parts(buckets: int):
    """Each chunk's distinct shingles by bucket, with how many of its sets hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(chunk: int, held: list[bytes]) -> pa.RecordBatch:
            h, times = np.unique(np.frombuffer(b"".join(held), "<u8"), return_counts=True)
            bucket, keys, counts = [], [], []
            for k, (key, n) in _cut(h, buckets, _key(h), times.astype("<u4")):
                bucket.append(k)
                keys.append(key)
                counts.append(n)
            out = _emit(bucket, [keys, counts], ["keys", "counts"])
            return out.append_column("chunk", pa.array([chunk] * len(bucket), pa.int64()))

        now, held = -1, []
        for b in batches:
            for chunk, raw in zip(b.column("chunk").to_pylist(), b.column("set").to_pylist(), strict=True):
                if chunk != now and held:
                    yield sent(now, held)
                    held = []
                now = chunk
                held.append(raw)
        if held:
            yield sent(now, held)

    return run


def _coarse(counts: np.ndarray) -> np.ndarray:
    """Counts to eight significant bits, so that there are few different ones."""
    counts = np.minimum(counts, 0xFFFFFFFF).astype(np.uint64)
    shift = np.maximum(np.frexp(counts.astype(np.float64))[1] - 8, 0).astype(np.uint64)
    return (counts >> shift << shift).astype("<u4")


def _bucket_counts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each chunk its shingles of this bucket that are counted more than once."""
    keys = _blob(table, "keys", "<u4")
    _, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, weights=_blob(table, "counts", "<u4"))[at].astype(np.int64) if len(keys) else np.empty(0, np.int64)
    cuts = np.cumsum([0, *(len(raw) // 4 for raw in table.column("keys").to_pylist())]).tolist()
    kept_keys, kept_counts = [], []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        many = total[i:j] > 1
        kept_keys.append(keys[i:j][many].tobytes())
        kept_counts.append(_coarse(total[i:j][many]).tobytes())
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "keys": pa.array(kept_keys, pa.binary()), "counts": pa.array(kept_counts, pa.binary())})


_ORDERED = "cid long, n long, cnt long, prefix binary, set binary, counts binary"


def _in_order(percent: int, buckets: int):
    """Each set's shingles in the global order, without those counted once, with their counts; and of these its prefix."""

    def run(key: tuple[pa.Scalar, ...], sets: pa.Table, counted: pa.Table) -> pa.Table:
        bucket = np.repeat(counted.column("bucket").to_numpy().astype(np.uint64), np.array([len(x) // 4 for x in counted.column("keys").to_pylist()], np.int64))
        known, at = np.unique(bucket << np.uint64(32) | _blob(counted, "keys", "<u4"), return_index=True)
        count = _blob(counted, "counts", "<u4")[at]
        raw = sets.column("set").to_pylist()
        h = np.frombuffer(b"".join(raw), "<u8")
        row = np.repeat(np.arange(len(raw)), np.array([len(x) // 8 for x in raw], np.int64))
        own = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32) << np.uint64(32) | _key(h)
        at = np.searchsorted(known, own)
        found = at < len(known)
        found[found] = known[at[found]] == own[found]
        row, h, c = row[found], h[found], count[at[found]]
        order = np.lexsort((h, c, row))
        row, h, c = row[order], h[order], c[order]
        cuts = np.searchsorted(row, np.arange(len(raw) + 1)).tolist()
        prefix, kept, counts = [], [], []
        for i, j, n in zip(cuts[:-1], cuts[1:], sets.column("n").to_pylist(), strict=True):
            alone = n - (j - i)  # they come first in the order
            prefix.append(h[i : i + max(0, n - _need(n, percent) + 1 - alone)].tobytes())
            kept.append(h[i:j].tobytes())
            counts.append(c[i:j].tobytes())
        return pa.table({**{x: sets.column(x) for x in ("cid", "n", "cnt")}, **{x: pa.array(y, pa.binary()) for x, y in (("prefix", prefix), ("set", kept), ("counts", counts))}})

    return run


def in_order(sets: DataFrame, total: int, percent: int) -> DataFrame:
    """``sets`` (chunk, cid, n, cnt, set), which hold ``total`` shingles, as _ORDERED says."""
    buckets = max(128, total >> 21)
    parts = sets.select("chunk", "set").mapInArrow(_chunk_parts(buckets), "bucket long, keys binary, counts binary, chunk long")
    counted = parts.groupBy("bucket").applyInArrow(_bucket_counts, "chunk long, bucket long, keys binary, counts binary")
    return sets.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_in_order(percent, buckets), _ORDERED)


def _entries_by_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        value, times = np.unique(np.frombuffer(b"".join(b.column("counts").to_pylist()), "<u4"), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(times.astype(np.int64))], ["value", "times"])


def _stars(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of entries: each shingle once with its smallest owner, and the edges from its other owners to that one."""
    o = np.lexsort((own, h))
    h, own = h[o], own[o]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    least = np.repeat(own[first], np.diff(np.r_[first, len(h)]))
    pairs = np.unique(np.stack((own, least), axis=1)[own != least], axis=0)
    return h[first], own[first], pairs[:, 0], pairs[:, 1]


def _prefix_stars(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def take(b):
            for cid, raw in zip(b.column("cid").to_pylist(), b.column("prefix").to_pylist(), strict=True):
                yield cid, np.frombuffer(raw, "<u8")

        for h, own in _flushes(batches, take):
            h, own, a, b = _stars(h, own)
            bucket, cols = [], [[], [], [], []]
            for k, parts in _cut(h, buckets, h, own):
                bucket.append(k)
                for c, p in zip(cols, [*parts, b"", b""], strict=True):
                    c.append(p)
            for j in range(0, len(a), 1 << 16):
                bucket.append(int(a[j]) % buckets)
                for c, p in zip(cols, [b"", b"", a[j : j + (1 << 16)].tobytes(), b[j : j + (1 << 16)].tobytes()], strict=True):
                    c.append(p)
            yield _emit(bucket, cols, ["h", "own", "a", "b"])

    return run


def _star_edges(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    _, _, a, b = _stars(_blob(table, "h", "<u8"), _blob(table, "own", "<i8"))
    pairs = np.unique(np.stack((np.concatenate((a, _blob(table, "a", "<i8"))), np.concatenate((b, _blob(table, "b", "<i8")))), axis=1), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap sizes of all pairs, a bounded number of shingles at a time."""
    sets = left + right
    flat = np.concatenate(sets)
    if not len(flat):
        return np.zeros((len(left), len(right)))
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    both = n > 1
    place = np.cumsum(both) - 1
    keep = both[col]
    row, col = row[keep], place[col[keep]]
    width = int(both.sum())
    out = np.zeros((len(left), len(right)), np.float64)
    step = max(1, FRAGMENT // len(sets))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, width, step):
        i, j = np.searchsorted(col, (at, at + step))
        x = np.zeros((len(sets), min(step, width - at)), np.float32)
        x[row[i:j], col[i:j] - at] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out


def _forest(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each vertex the smallest id that it reaches."""
    root, open_ = ids.copy(), np.ones(len(ids), bool)
    for v in np.argsort(ids, kind="stable").tolist():
        if not open_[v]:
            continue
        open_[v] = False
        todo = [v]
        while todo:
            near = linked[todo].any(axis=0) & open_
            todo = np.flatnonzero(near).tolist()
            open_[todo] = False
            root[todo] = ids[v]
    return root


def fragment_bounds(counts: np.ndarray, fragments: int, entries: np.ndarray | None = None) -> np.ndarray:
    """Places that cut the global order into parts with about equally many entries.

    ``counts``: the count of each shingle; with ``entries`` each distinct count, and how many entries have it.
    """
    if entries is None:
        value, times = np.unique(counts[counts > 1], return_counts=True)
        entries = value.astype(np.float64) * times
    else:
        o = np.argsort(counts)
        value, entries = counts[o], entries[o].astype(np.float64)
    if not len(value):
        return np.empty(0, np.uint64)
    done = np.cumsum(entries)
    out = []
    for k in range(1, fragments):
        i = int(np.searchsorted(done, done[-1] * k / fragments))
        share = 1 - (done[i] - done[-1] * k / fragments) / entries[i]
        out.append(int(value[i]) << 32 | min(int(share * 2**32), 2**32 - 1))
    return np.array(out, np.uint64)


def _fragments(bounds: np.ndarray):
    """Each set as FRAGMENTS rows, one a part of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts, numbers = [], [], []
            for r, (raw, counts) in enumerate(zip(b.column("set").to_pylist(), b.column("counts").to_pylist(), strict=True)):
                h = np.frombuffer(raw, "<u8")
                at = np.frombuffer(counts, "<u4").astype(np.uint64) << np.uint64(32) | h >> np.uint64(32)
                which = np.searchsorted(bounds, at, side="right")
                for k in range(FRAGMENTS):
                    rows.append(r)
                    numbers.append(k)
                    parts.append(h[which == k].tobytes())
            rest = b.select([n for n in b.schema.names if n not in ("set", "counts")]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], [*rest.schema.names, "fragment", "part"])

    return run


def _members(cluster: np.ndarray, block: np.ndarray, left: int, right: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Of rows in order of cluster: each cluster's rows, and which of them are of the left and of the right block."""
    cuts = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1], True])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        i, j = np.flatnonzero(block[a:b] == left), np.flatnonzero(block[a:b] == right)
        if len(i) and len(j):
            yield slice(a, b), i, j


_PARTIAL = "task long, left_block int, right_block int, fragment int, members binary, counts binary"


def _partial(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The overlaps of all pairs of two blocks within one fragment, cluster by cluster; the first fragment names the members."""
    task, left, right, fragment = (k.as_py() for k in key)
    rows = np.stack([table.column(n).to_numpy().astype(np.int64) for n in ("cluster", "cid", "block", "n", "cnt")])
    order = np.lexsort((rows[1], rows[0]))
    rows = rows[:, order]
    raw = table.column("part").to_pylist()
    sets = [np.frombuffer(raw[i], "<u8") for i in order.tolist()]
    counts = []
    for at, i, j in _members(rows[0], rows[2], left, right):
        own = sets[at]
        counts.append(overlaps([own[k] for k in i.tolist()], [own[k] for k in j.tolist()]).astype("<u4").ravel())
    blob = np.concatenate(counts).tobytes() if counts else b""
    schema = pa.schema([("task", pa.int64()), ("left_block", pa.int32()), ("right_block", pa.int32()), ("fragment", pa.int32()), ("members", pa.binary()), ("counts", pa.binary())])
    return pa.table([[task], [left], [right], [fragment], [rows.tobytes() if fragment == 0 else None], [blob]], schema=schema)


def _summed(percent: int):
    """Links from the fragments' counts, summed for each pair."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, left, right = (k.as_py() for k in key)
        total = 0
        for raw in table.column("counts").to_pylist():
            total = total + np.frombuffer(raw, "<u4").astype(np.int64)
        cluster, cid, block, n, cnt = np.frombuffer(next(m for m in table.column("members").to_pylist() if m is not None), np.int64).reshape(5, -1)
        a, b, links, done = [], [], [], 0
        for at, i, j in _members(cluster, block, left, right):
            ids, sizes = cid[at], n[at]
            o = total[done : done + len(i) * len(j)].reshape(len(i), len(j))
            done += len(i) * len(j)
            hit = 100 * o >= percent * (sizes[i][:, None] + sizes[j][None, :] - o)
            if left == right:
                np.fill_diagonal(hit, False)
            linked = np.zeros((len(ids), len(ids)), bool)
            linked[np.ix_(i, j)] |= hit
            linked[np.ix_(j, i)] |= hit.T
            count = linked @ cnt[at]
            some = count > 0
            a.append(ids[some])
            b.append(_forest(linked, ids)[some])
            links.append(count[some])
        empty = [np.empty(0, np.int64)]
        return pa.table({n: pa.array(np.concatenate(x or empty).astype(np.int64), pa.int64()) for n, x in (("a", a), ("b", b), ("links", links))})

    return run


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of ``docs`` (doc_id, text)."""
    if not 50 <= percent <= 100:
        raise ValueError("percent from 50 to 100")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ngrams")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = scratch.keep(docs.mapInArrow(_describe(width, percent), "doc_id long, n long, hi long, lo long, prefix binary"), "described")
    slim = scratch.keep(described.select("doc_id", "n", "hi", "lo"), "slim")  # the prefixes go as soon as they have met
    classes = scratch.keep(slim.where("doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("cid"), F.count(F.lit(1)).alias("cnt"), F.max("n").alias("n")), "classes")

    entries = int(described.where("prefix is not null").agg(F.sum(F.length("prefix"))).first()[0] or 0) // 8
    buckets = max(128, entries >> 19)
    parts = described.where("prefix is not null").select("lo", "prefix").mapInArrow(_prefix_parts(buckets), "bucket long, h binary, own binary, who binary, count binary")
    shared = parts.groupBy("bucket").applyInArrow(_shared_counts, "lo long, c long").groupBy("lo").agg(F.sum("c").alias("c"))
    least = F.ceil(F.lit(percent) * F.col("n") / 100)  # a partner may be as small as this
    stay = classes.where("n > 0").join(shared, "lo").where(F.col("c") >= 1 + F.floor(least / 10))
    stay = scratch.keep(stay.select("cid", "hi", "lo", "cnt"), "stay")
    scratch.drop(described)

    n_stay = stay.count()
    stay_side = stay.withColumnRenamed("cid", "doc_id")
    again = docs.join(F.broadcast(stay_side) if n_stay <= BROADCAST_ROWS else stay_side, "doc_id")
    sets = scratch.keep(again.mapInArrow(_sets(width), "chunk long, cid long, n long, cnt long, set binary"), "sets")
    rows, distinct, total = sets.agg(F.count(F.lit(1)), F.count_distinct("cid"), F.sum("n")).first()
    if rows > distinct:  # rows that repeat a doc_id
        once = scratch.keep(sets.dropDuplicates(["cid"]).mapInArrow(_rechunked, "chunk long, cid long, n long, cnt long, set binary"), "sets")
        scratch.drop(sets)
        sets, total = once, once.agg(F.sum("n")).first()[0]
    total = int(total or 0)
    ordered = scratch.keep(in_order(sets, total, percent), "ordered")
    scratch.drop(sets)
    buckets = max(128, total >> 19)
    stars = ordered.select("cid", "prefix").mapInArrow(_prefix_stars(buckets), "bucket long, h binary, own binary, a binary, b binary")
    clusters = connected_components(stars.groupBy("bucket").applyInArrow(_star_edges, "a long, b long"), scratch)

    sets = ordered.drop("prefix")
    members = sets.join(clusters.select(F.col("v").alias("cid"), F.col("label").alias("cluster")), "cid")
    sizes = clusters.join(sets.select(F.col("cid").alias("v"), (F.length("set") / 8).alias("n")), "v").groupBy("label").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    members = members.join(sizes.select(F.col("label").alias("cluster"), blocks.alias("blocks")), "cluster")
    batches = max(64, total // BLOCK_SHINGLES)
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    cut = members.select("cluster", "blocks", "cid", "n", "cnt", own.alias("block"), "set", "counts")
    by_count = ordered.select("counts").mapInArrow(_entries_by_count, "value long, times long").groupBy("value").agg(F.sum("times")).collect()  # a few thousand rows at most
    bounds = fragment_bounds(np.array([r[0] for r in by_count], np.int64), FRAGMENTS, np.array([r[1] for r in by_count], np.int64))
    cut = cut.mapInArrow(_fragments(bounds), "cluster long, blocks int, cid long, n long, cnt long, block int, fragment int, part binary")
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({
        "left_block": F.least("block", "other"), "right_block": F.greatest("block", "other"),
        "task": F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("cluster"), F.lit(batches))).otherwise(F.col("cluster")),
    })
    met = met.select("task", "left_block", "right_block", "fragment", "cluster", "block", "cid", "n", "cnt", "part")
    partial = met.groupBy("task", "left_block", "right_block", "fragment").applyInArrow(_partial, _PARTIAL)
    found = partial.groupBy("task", "left_block", "right_block").applyInArrow(_summed(percent), "a long, b long, links long")
    found = scratch.keep(found, "links")
    joined = connected_components(found.select("a", "b"), scratch).select(F.col("v").alias("cid"), F.col("label").alias("component_id"))
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))

    labelled = classes.join(joined, "cid", "left").join(links, "cid", "left")
    labelled = labelled.select("hi", "lo", F.coalesce("component_id", "cid").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("n_links"))
    out = slim.select("doc_id", F.col("n").alias("n_shingles"), "hi", "lo").join(labelled, ["hi", "lo"], "left")
    known = F.col("doc_id").isNotNull()
    n_links = F.when(known & (F.col("n_shingles") > 0), F.col("n_links")).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "n_shingles", F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"), n_links.alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the one row of each component that has its smallest doc_id; rows with a null doc_id stay."""
    first = ngram_join(docs.select("doc_id", "text"), **options).where("doc_id = component_id").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(first, "doc_id", "left_semi")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    known = known.withColumn("__vl_k", F.row_number().over(one)).where("__vl_k = 1").select(*docs.columns)
    return known.unionByName(docs.where("doc_id is null"))
