"""Copies of images, cropped or edited, by local descriptors.

Each image gets corners at two scales, an orientation from the centroid of brightness around each, and 256
binary brightness tests in the turned frame. Equal images are one class from here on. Descriptors are cut into
tables: two descriptors that agree on a whole table meet by hash range. Two images that meet by SHARED corners each are a
candidate pair, and only these are compared: all Hamming distances of their descriptors, mutual nearest matches, then
geometric consensus: enough matches must agree on one turn, scale and shift. No other image decides about a pair.

Values with at most WIDE holders: a task writes their pairs as packed numbers (at most WIDE / 2 a holder), another adds
up each pair's corners, and the candidates are compared in tasks that hold each image once. Values with more holders
never make pairs: images connected by such values are a cluster, clusters are cut into blocks of bounded size, and two
blocks meet in a task that finds candidates by a product of two 0/1 matrices and compares them there. Only links a class
and a spanning forest leave such a task.

Edge cases: an image that is null, too small or has a size that doesn't fit its pixels has no corners and is
linked with its exact copies only (null pixels: with nothing); a null id is linked with nothing and has a null
component; rows that repeat an id are one vertex, whose links are those of all its images; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.components import connected_components, thinned
from vectorloom.llm.ngram_join import BROADCAST_ROWS, _blob, _cut, _emit, _forest, overlaps
from vectorloom.runtime import Scratch, ship

#: The strongest corners kept of each CELL x CELL pixels, at full and half size: their number grows with the area.
CORNERS, CELL = (16, 8), 96
RADIUS, BITS, TABLES, TABLE_BITS, TURNS = 6, 256, 6, 42, 32
#: Corners of each image that have to take part in table matches; holders of a value up to which its pairs are written.
SHARED, WIDE = 2, 128
MAX_DISTANCE, MIN_AGREE, BLOCK = 48, 4, 96
#: Distances that a task holds at a time.
PRODUCT = 1 << 26
_MARGIN = RADIUS + 2


def _pattern() -> np.ndarray:
    """(TURNS, BITS, 4): the tests' two places (dy, dx) for each turn, from a fixed seed."""
    rng = np.random.Generator(np.random.PCG64(21))
    p = np.clip(rng.normal(0, RADIUS / 2, (BITS, 2, 2)), -RADIUS, RADIUS)
    p *= np.minimum(1, RADIUS / np.maximum(1e-9, np.hypot(p[..., 0], p[..., 1])))[..., None]
    a = np.arange(TURNS) * 2 * np.pi / TURNS
    c, s = np.cos(a)[:, None, None], np.sin(a)[:, None, None]
    y, x = p[None, ..., 0], p[None, ..., 1]
    return np.rint(np.stack((c * y + s * x, c * x - s * y), axis=-1)).astype(np.int64).reshape(TURNS, BITS, 4)


_TESTS = _pattern()
_DISC = np.array([(dy, dx) for dy in range(-RADIUS, RADIUS + 1) for dx in range(-RADIUS, RADIUS + 1) if dy * dy + dx * dx <= RADIUS * RADIUS])


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r + 1)-squares, zeros outside."""
    n, h, w = a.shape
    p = np.zeros((n, h + 2 * r, w), np.float32)
    p[:, r : r + h] = a
    rows = p[:, :h].copy()
    for k in range(1, 2 * r + 1):
        rows += p[:, k : k + h]
    q = np.zeros((n, h, w + 2 * r), np.float32)
    q[:, :, r : r + w] = rows
    out = q[:, :, :w].copy()
    for k in range(1, 2 * r + 1):
        out += q[:, :, k : k + w]
    return out


def _highest(a: np.ndarray) -> np.ndarray:
    """Maxima over 7-squares, by doubling: two, four, then seven wide."""
    n, h, w = a.shape
    p = np.full((n, h + 6, w), -np.inf, np.float32)
    p[:, 3 : 3 + h] = a
    p = np.maximum(p[:, :-1], p[:, 1:])
    p = np.maximum(p[:, :-2], p[:, 2:])
    p = np.maximum(p[:, :h], p[:, 3 : 3 + h])
    q = np.full((n, h, w + 6), -np.inf, np.float32)
    q[:, :, 3 : 3 + w] = p
    q = np.maximum(q[:, :, :-1], q[:, :, 1:])
    q = np.maximum(q[:, :, :-2], q[:, :, 2:])
    return np.maximum(q[:, :, :w], q[:, :, 3 : 3 + w])


def describe(stack: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each image of a stack (n, h, w): corners (y, x, scale, turn) and descriptors (k, BITS / 8)."""
    n = len(stack)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
    level = stack.astype(np.float32)
    for octave, most in enumerate(CORNERS):
        scale = 1 << octave
        if octave:
            h, w = level.shape[1] // 2 * 2, level.shape[2] // 2 * 2
            level = (level[:, 0:h:2, 0:w:2] + level[:, 1:h:2, 0:w:2] + level[:, 0:h:2, 1:w:2] + level[:, 1:h:2, 1:w:2]) / 4
        h, w = level.shape[1:]
        if min(h, w) <= 2 * _MARGIN:
            break
        gy, gx = np.zeros_like(level), np.zeros_like(level)
        gy[:, 1:-1] = level[:, 2:] - level[:, :-2]
        gx[:, :, 1:-1] = level[:, :, 2:] - level[:, :, :-2]
        yy, xx, xy = _box(gy * gy, 2), _box(gx * gx, 2), _box(gy * gx, 2)
        r = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
        peak = np.zeros(r.shape, bool)
        inner = (slice(None), slice(_MARGIN, h - _MARGIN), slice(_MARGIN, w - _MARGIN))
        peak[inner] = (r == _highest(r))[inner] & (r > 1e3)[inner]
        image, y, x = np.nonzero(peak)
        side = CELL >> octave
        across = -(-w // side)
        cell = (image * -(-h // side) + y // side) * across + x // side
        order = np.lexsort((x, y, -r[image, y, x], cell))
        cell = cell[order]
        order = order[np.arange(len(cell)) - np.searchsorted(cell, cell) < most]
        image, y, x = image[order], y[order], x[order]
        if not len(image):
            continue
        smooth = _box(level, 1)
        disc = level[image[:, None], y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
        angle = np.arctan2(disc @ _DISC[:, 0].astype(np.float32), disc @ _DISC[:, 1].astype(np.float32))
        turn = np.rint(angle * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
        t = _TESTS[turn]
        at = image[:, None]
        a = smooth[at, y[:, None] + t[:, :, 0], x[:, None] + t[:, :, 1]]
        b = smooth[at, y[:, None] + t[:, :, 2], x[:, None] + t[:, :, 3]]
        bits = np.packbits(a < b, axis=1, bitorder="little")
        place = np.stack((scale * (y + 0.5), scale * (x + 0.5), np.full(len(y), scale), angle), axis=1).astype("<f4")
        for i, part in zip(*np.unique(image, return_index=True), strict=True):
            stop = np.searchsorted(image, i, side="right")
            found[i].append((place[part:stop], bits[part:stop]))
    none = (np.empty((0, 4), "<f4"), np.empty((0, BITS // 8), np.uint8))
    return [tuple(np.concatenate(c) for c in zip(*f, strict=True)) if f else none for f in found]


def table_keys(descriptors: np.ndarray) -> np.ndarray:
    """A 64-bit key for each table of each descriptor, spread over the whole range."""
    bits = np.unpackbits(descriptors, axis=1, bitorder="little")[:, : TABLES * TABLE_BITS].reshape(-1, TABLES, TABLE_BITS).astype(np.uint64)
    v = (bits << np.arange(TABLE_BITS, dtype=np.uint64)).sum(axis=2, dtype=np.uint64) | (np.arange(TABLES, dtype=np.uint64) << np.uint64(TABLE_BITS))
    v *= np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(32)
    return (v * np.uint64(0xD6E8FEB86659FD93)).ravel()


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """The most matches (rows of corners a and b) that one similarity transform explains."""
    ratio = b[:, 2] / a[:, 2]
    turn = b[:, 3] - a[:, 3]
    best = 0
    for i in range(len(a)):
        c, s = ratio[i] * np.cos(turn[i]), ratio[i] * np.sin(turn[i])
        dy, dx = a[:, 0] - a[i, 0], a[:, 1] - a[i, 1]
        y, x = b[i, 0] + c * dy + s * dx, b[i, 1] + c * dx - s * dy
        near = np.hypot(y - b[:, 0], x - b[:, 1]) <= 2.5 + 0.1 * np.hypot(dy, dx)
        near &= (np.abs(np.angle(np.exp(1j * (turn - turn[i])))) < 0.5) & (ratio == ratio[i])
        best = max(best, int(near.sum()))
    return best


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        ids, widths, heights = (b.column(c).to_pylist() for c in ("id", "width", "height"))
        pixels = b.column("pixels").to_pylist()
        by_size: dict[tuple[int, int], list[int]] = {}
        hi, lo, n, corners, bits = [], [], [0] * len(ids), [b""] * len(ids), [b""] * len(ids)
        for i, (d, w, h, p) in enumerate(zip(ids, widths, heights, pixels, strict=True)):
            if p is None or d is None:
                hi.append(-1)
                lo.append(d or 0)
                continue
            x = xxhash.xxh3_128(p)
            x.update(f"{w}x{h}")
            hi.append(int.from_bytes(x.digest()[:8], "little", signed=True))
            lo.append(int.from_bytes(x.digest()[8:], "little", signed=True))
            if w and h and w * h == len(p) and min(w, h) > 2 * _MARGIN:
                by_size.setdefault((h, w), []).append(i)
        for (h, w), rows in by_size.items():
            step = max(1, (1 << 17) // (h * w))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                stack = np.stack([np.frombuffer(pixels[i], np.uint8).reshape(h, w) for i in part])
                for i, (c, d) in zip(part, describe(stack), strict=True):
                    n[i], corners[i], bits[i] = len(c), c.tobytes(), d.tobytes()
        cols = [pa.array(ids, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int64()), pa.array(corners, pa.binary()), pa.array(bits, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["id", "hi", "lo", "n", "corners", "bits"])


#: Entries that a map task holds before it sends them.
FLUSH = 1 << 19
_ENTRY = np.dtype([("h", "<u8"), ("own", "<i8"), ("corner", "<i4")])
#: As they are sent where all corners of a blob have small numbers; the first byte tells which it is.
_SHORT = np.dtype([("h", "<u8"), ("own", "<i8"), ("corner", "<u2")])


def _packed(e: np.ndarray) -> bytes:
    return b"\0" + e.astype(_SHORT).tobytes() if not len(e) or e["corner"].max() < 1 << 16 else b"\1" + e.tobytes()


def _unpacked(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([np.empty(0, _ENTRY), *(np.frombuffer(b, _ENTRY if b[0] else _SHORT, offset=1).astype(_ENTRY) for b in blobs)])


def entries_of(own: int, descriptors: np.ndarray) -> np.ndarray:
    """One entry for each different table value of an image, with the first corner that has it."""
    keys = table_keys(descriptors)
    h, first = np.unique(keys, return_index=True)
    out = np.empty(len(h), _ENTRY)
    out["h"], out["own"], out["corner"] = h, own, first // TABLES
    return out


def _bits_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8)


def _parts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def send() -> pa.RecordBatch:
            e = np.concatenate(held)
            e = e[np.argsort(e["h"], kind="stable")]
            bucket, col = [], []
            for k, parts in _cut(e["h"], buckets, e):
                bucket.append(k)
                col.append(_packed(np.frombuffer(parts[0], _ENTRY)))
            return _emit(bucket, [col], ["entries"])

        for b in batches:
            for cid, raw in zip(b.column("cid").to_pylist(), b.column("bits").to_pylist(), strict=True):
                held.append(entries_of(cid, _bits_of(raw)))
                n += len(held[-1])
                if n >= FLUSH:
                    yield send()
                    held, n = [], 0
        if held:
            yield send()

    return run


_MEETING = np.dtype([("a", "<i8"), ("b", "<i8"), ("ca", "<i4"), ("cb", "<i4")])
_HELD_PAIRS = 1 << 18


def _meetings(buckets: int):
    """Of one range of values: who meets whom by which corners, packed by pair; of wide values the stars' edges (a, b)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        e = _unpacked(table.column("entries").to_pylist())
        e = e[np.lexsort((e["own"], e["h"]))]
        first = np.flatnonzero(np.r_[True, e["h"][1:] != e["h"][:-1]][: len(e)])
        n = np.diff(np.r_[first, len(e)])
        bucket, packed, stars = [], [], [np.empty((0, 2), np.int64)]

        def send(found: list[np.ndarray]) -> None:
            m = np.unique(np.concatenate(found))
            m = m[m["a"] != m["b"]]  # an id with two images
            to = ((m["a"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ m["b"].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)
            to = (to % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                bucket.append(k)
                packed.append(m[order[cuts[k] : cuts[k + 1]]].tobytes())

        found, held = [], 0
        for m in np.unique(n[n > 1]).tolist():
            at = first[n == m][:, None] + np.arange(m)
            if m > WIDE:
                own = e["own"][at]
                stars.append(np.stack((own[:, 1:].ravel(), np.repeat(own[:, 0], m - 1)), axis=1))
                continue
            i, j = np.triu_indices(m, 1)
            step = max(1, _HELD_PAIRS // len(i))
            for k in range(0, len(at), step):
                x, y = e[at[k : k + step][:, i]].ravel(), e[at[k : k + step][:, j]].ravel()
                one = np.empty(len(x), _MEETING)
                one["a"], one["b"], one["ca"], one["cb"] = x["own"], y["own"], x["corner"], y["corner"]
                found.append(one)
                held += len(one)
                if held >= _HELD_PAIRS:
                    send(found)
                    found, held = [], 0
        if found:
            send(found)
        stars = np.unique(np.concatenate(stars), axis=0)
        none = len(packed)
        return pa.table({
            "bucket": pa.concat_arrays([pa.array(bucket, pa.int64()), pa.nulls(len(stars), pa.int64())]), "meetings": pa.concat_arrays([pa.array(packed, pa.binary()), pa.nulls(len(stars), pa.binary())]),
            "a": pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(stars[:, 0], pa.int64())]), "b": pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(stars[:, 1], pa.int64())]),
        })

    return run


def _candidates(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Pairs that meet by SHARED different corners of each."""
    m = np.unique(_blob(table, "meetings", _MEETING))
    pair = np.cumsum(np.r_[False, (m["a"][1:] != m["a"][:-1]) | (m["b"][1:] != m["b"][:-1])]) if len(m) else np.empty(0, np.int64)
    enough = np.ones(int(pair[-1]) + 1 if len(m) else 0, bool)
    for c in ("ca", "cb"):
        enough &= np.bincount(np.unique(np.stack((pair, m[c]), axis=1), axis=0)[:, 0], minlength=len(enough)) >= SHARED
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(m)])[enough]
    return pa.table({"a": pa.array(m["a"][first], pa.int64()), "b": pa.array(m["b"][first], pa.int64())})


def _signed(raw: bytes) -> np.ndarray:
    return np.unpackbits(_bits_of(raw), axis=1).astype(np.float32) * 2 - 1


def are_copies(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two images, given as (corners, +-1 descriptors), are copies; the same in either order."""
    (ca, da), (cb, db) = a, b
    if min(len(da), len(db)) < MIN_AGREE:
        return False
    near, distance, back = _nearest(da, db)
    ok = (distance <= MAX_DISTANCE) & (back[near] == np.arange(len(da)))
    return bool(ok.sum() >= MIN_AGREE and agreeing(ca[ok], cb[near[ok]]) >= MIN_AGREE)


def _compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links of one task's candidates, as each image's number and a forest: rows with ``other`` are pairs, the others images."""
    cid, cnt, other = (table.column(n).to_pylist() for n in ("cid", "cnt", "other"))
    corners, bits = table.column("corners").to_pylist(), table.column("bits").to_pylist()
    raw: dict[int, list[int]] = {}  # an id may have several images
    for k, (c, o) in enumerate(zip(cid, other, strict=True)):
        if o is None:
            raw.setdefault(c, []).append(k)
    held: dict[int, list[tuple]] = {}

    def images(c: int) -> list[tuple]:
        if c not in held:
            if len(held) >= 512:
                held.clear()
            held[c] = [(np.frombuffer(corners[k], "<f4").reshape(-1, 4), _signed(bits[k])) for k in raw[c]]
        return held[c]

    links: dict[int, int] = {}
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for c, o in sorted((c, o) for c, o in zip(cid, other, strict=True) if o is not None):
        if any(are_copies(x, y) for x in images(c) for y in images(o)):
            links[c] = links.get(c, 0) + cnt[raw[o][0]]
            links[o] = links.get(o, 0) + cnt[raw[c][0]]
            x, y = find(c), find(o)
            root[max(x, y)] = min(x, y)
    a = sorted(links)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array([find(c) for c in a], pa.int64()), "links": pa.array([links[c] for c in a], pa.int64())})


def _block(column: str) -> F.Column:
    return F.pmod(F.xxhash64(column), F.col("blocks")).cast("int")


def _nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of +-1 descriptors: each a's nearest b, its distance, and each b's nearest a; PRODUCT distances at a time."""
    near, back, best = np.empty(len(a), np.int64), np.zeros(len(b), np.int64), np.full(len(b), np.inf)
    distance = np.empty(len(a), np.float32)
    step = max(1, PRODUCT // len(b))
    for at in range(0, len(a), step):
        d = (BITS - a[at : at + step] @ b.T) / 2
        near[at : at + step], distance[at : at + step] = d.argmin(axis=1), d.min(axis=1)
        first, least = d.argmin(axis=0), d.min(axis=0)
        back[least < best] = at + first[least < best]
        best = np.minimum(best, least)
    return near, distance, back


def _met_corners(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corners by which two images meet, one pair for each common value; entries in order of value."""
    _, i, j = np.intersect1d(left["h"], right["h"], assume_unique=True, return_indices=True)
    return left["corner"][i], right["corner"][j]


def _evaluate(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    cluster, ids, block, cnt = (table.column(c).to_numpy() for c in ("cluster", "cid", "block", "cnt"))
    corners = [np.frombuffer(r, "<f4").reshape(-1, 4) for r in table.column("corners").to_pylist()]
    bits = table.column("bits").to_pylist()
    entries = [entries_of(int(c), _bits_of(r)) for c, r in zip(ids, bits, strict=True)]
    a, b, links = [], [], []
    order = np.lexsort((ids, cluster))
    for at in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
        i, j = np.flatnonzero(block[at] == key[1].as_py()), np.flatnonzero(block[at] == key[2].as_py())
        if not len(i) or not len(j):
            continue
        meet = overlaps([entries[k]["h"] for k in at[i]], [entries[k]["h"] for k in at[j]]) >= SHARED
        linked = np.zeros((len(at), len(at)), bool)
        signed = {k: _signed(bits[at[k]]) for k in set(i) | set(j)}
        for x, y in zip(*(v.tolist() for v in np.nonzero(meet)), strict=True):
            p, q = int(i[x]), int(j[y])
            if ids[at[p]] == ids[at[q]] or key[1] == key[2] and p > q:
                continue
            p, q = min(p, q), max(p, q)  # in order of id, as everywhere
            if all(len(np.unique(c)) >= SHARED for c in _met_corners(entries[at[p]], entries[at[q]])):
                linked[p, q] = linked[q, p] = are_copies((corners[at[p]], signed[p]), (corners[at[q]], signed[q]))
        count = linked @ cnt[at]
        some = count > 0
        a.append(ids[at][some])
        b.append(_forest(linked, ids[at])[some])
        links.append(count[some])
    empty = [np.empty(0, np.int64)]
    return pa.table({n: pa.array(np.concatenate(x or empty).astype(np.int64), pa.int64()) for n, x in (("a", a), ("b", b), ("links", links))})


_LINKS = "a long, b long, links long"


def _wide_links(sets: DataFrame, clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """Links within clusters (v, label) of wide values, block by block."""
    members = sets.join(clusters.select(F.col("v").alias("cid"), F.col("label").alias("cluster")), "cid")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / (BLOCK * sum(CORNERS)))).cast("int")
    sizes = members.groupBy("cluster").agg(blocks.alias("blocks"))
    met = members.join(sizes, "cluster").withColumn("block", _block("cid"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"left_block": F.least("block", "other"), "right_block": F.greatest("block", "other")})
    met = met.select("cluster", "left_block", "right_block", "block", "cid", "cnt", "corners", "bits")
    return scratch.keep(met.groupBy("cluster", "left_block", "right_block").applyInArrow(_evaluate, _LINKS), "wide")


def links_of(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, links): edges that connect the copies among ``sets`` (cid, cnt, n, corners, bits); ``links`` of a add up to its number."""
    total = int(sets.agg(F.sum("n")).first()[0] or 0)
    buckets = max(128, TABLES * total >> 19)
    entries = sets.select("cid", "bits").mapInArrow(_parts(buckets), "bucket long, entries binary")
    met = scratch.keep(entries.groupBy("bucket").applyInArrow(_meetings(buckets), "bucket long, meetings binary, a long, b long"), "met")
    pairs = met.where("meetings is not null").select("bucket", "meetings").groupBy("bucket").applyInArrow(_candidates, "a long, b long")
    stars = met.where("a is not null").select("a", "b")
    wide = None
    if stars.head(1):
        clusters = connected_components(stars, scratch)
        wide = _wide_links(sets, clusters, scratch)
        few = clusters.count() <= BROADCAST_ROWS
        side = lambda name: (F.broadcast if few else lambda df: df)(clusters.select(F.col("v").alias(name), F.col("label").alias(f"of_{name}")))
        # two images of one wide cluster are compared there
        pairs = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where("of_a is null or of_b is null or of_a <> of_b").select("a", "b")
    pairs = scratch.keep(pairs, "pairs")
    tasks = max(64, total // (BLOCK * sum(CORNERS)))
    pairs = pairs.withColumn("task", F.pmod(F.xxhash64("a"), F.lit(tasks)))
    images = pairs.select("task", F.explode(F.array("a", "b")).alias("cid")).distinct()
    images = scratch.keep(images, "images")
    images = sets.join(F.broadcast(images) if images.count() <= BROADCAST_ROWS else images, "cid").select("task", "cid", "cnt", "corners", "bits", F.lit(None).cast("long").alias("other"))
    asked = pairs.select("task", F.col("a").alias("cid"), F.lit(None).cast("long").alias("cnt"), F.lit(None).cast("binary").alias("corners"), F.lit(None).cast("binary").alias("bits"), F.col("b").alias("other"))
    found = scratch.keep(images.unionByName(asked).groupBy("task").applyInArrow(_compare, _LINKS), "links")
    return found if wide is None else found.unionByName(wide)


def image_copies(images: DataFrame) -> DataFrame:
    """id, n_corners, component_id, n_links of every row of ``images`` (id, width, height, pixels: grey bytes)."""
    spark = images.sparkSession
    ship(spark)
    scratch = Scratch(spark, "images")
    images = images.select(F.col("id").cast("long").alias("id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("pixels").cast("binary").alias("pixels"))
    described = scratch.keep(images.mapInArrow(_describe, "id long, hi long, lo long, n long, corners binary, bits binary"), "described")
    classes = scratch.keep(described.where("id is not null").groupBy("hi", "lo").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("cnt"), F.max("n").alias("n")), "classes")
    rep = classes.where(F.col("n") > 0).select(F.col("cid").alias("id"), "hi", "lo", "cid", "cnt")
    few = classes.count() <= BROADCAST_ROWS
    sets = described.join(F.broadcast(rep) if few else rep, ["id", "hi", "lo"]).select("cid", "cnt", "n", "corners", "bits")
    if described.groupBy("id", "hi", "lo").count().where("id is not null and count > 1").head(1):  # rows that repeat whole
        sets = sets.dropDuplicates(["cid", "bits"])
    found = links_of(sets, scratch)
    joined = connected_components(thinned(found), scratch).select(F.col("v").alias("cid"), F.col("label").alias("component_id"))
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    labelled = classes.join(joined, "cid", "left").join(links, "cid", "left")
    labelled = labelled.select("hi", "lo", F.coalesce("component_id", "cid").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("n_links"))
    out = described.select("id", F.col("n").alias("n_corners"), "hi", "lo").join(labelled, ["hi", "lo"], "left")
    known = F.col("id").isNotNull()
    return out.select("id", "n_corners", F.when(known, F.coalesce("component_id", "id")).alias("component_id"), F.when(known & (F.col("hi") != -1), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


TILES, TILE = 6, 16


def page_pictures(pages: DataFrame) -> DataFrame:
    """id, width, height, pixels: a grey picture of each page (page_id, html), made from all of its markup.

    The test tables have no media column. A page is cut at words into a grid of parts; each part paints one tile
    with a texture drawn from a seed that is its own content, so pages that share most parts give edited copies.
    """
    ship(pages.sparkSession)

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rng = np.random.Generator(np.random.PCG64(33))
        bank = rng.integers(0, 80, (4096, TILE // 2, TILE // 2), dtype=np.uint8).repeat(2, axis=1).repeat(2, axis=2)
        side = TILES * TILE
        for b in batches:
            out = []
            for html in b.column("html").cast(pa.large_binary()).to_pylist():
                words = html.split() if html else []
                seeds = [xxhash.xxh64_intdigest(b" ".join(words[len(words) * k // TILES**2 : len(words) * (k + 1) // TILES**2])) for k in range(TILES**2)]
                s = np.array(seeds, np.uint64)
                tiles = bank[s & np.uint64(4095)] + bank[(s >> np.uint64(12)) & np.uint64(4095)].transpose(0, 2, 1)[:, ::-1] + bank[(s >> np.uint64(24)) & np.uint64(4095)][:, ::-1]
                out.append(tiles.reshape(TILES, TILES, TILE, TILE).swapaxes(1, 2).reshape(side, side).tobytes() if words else None)
            size = pa.array([side] * len(out), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), size, size, pa.array(out, pa.binary())], ["id", "width", "height", "pixels"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(paint, "id long, width int, height int, pixels binary")
