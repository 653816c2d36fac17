"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows are written once, so that partition and place of each row are fixed. Partitions are cells. The driver counts
them and draws, for each, how many of its rows go to each shard: a multivariate hypergeometric row after row, so the
matrix has the cells' sizes and the shards' exact sizes as its margins, as if all rows had been permuted at once. A
cell's rows are permuted (the local permutation) and cut by the matrix row; what a cell sends to a shard has its own
range of places there, which a second permutation, one a shard, turns into slots. Both permutations are keyed Feistel
networks over exactly as many places as there are rows, so a row's shard and slot follow from its place alone; rows
then move once, by shard and strip of slots, and are put in slot order.

Law: ``rows``: shard sizes differ by one at most (the first ``n mod shards`` shards have one more).

Edge cases: rows with equal or null keys, and rows that repeat, are rows of their own and are spread like any
others; texts of any length are only carried; an empty table gives no rows; columns named shard or slot are replaced,
all others are carried, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.runtime import Scratch, ship

#: Cells and numbers of the matrix at most: partitions beyond share a cell.
MAX_CELLS, MAX_NUMBERS = 16_384, 1 << 22
#: Kinds from which numpy's sampler is replaced (it takes fewer than 10**9 of either), and rows of a strip.
LARGE, STRIP = 10**9, 1 << 15
_INDEX = (1 << 33) - 1


def communication_matrix(cells: np.ndarray, shards: np.ndarray, seed: int) -> np.ndarray:
    """Counts with the two given margins, distributed as those of a uniform permutation."""
    if cells.sum() != shards.sum():
        raise ValueError("margins differ")
    rng = np.random.Generator(np.random.PCG64(seed))
    left = shards.astype(np.int64).copy()
    out = np.zeros((len(cells), len(shards)), np.int64)
    for i, n in enumerate(cells.tolist()):
        out[i] = _multivariate(rng, left, int(n))
        left -= out[i]
    return out


def _multivariate(rng: np.random.Generator, colors: np.ndarray, n: int) -> np.ndarray:
    """n draws without replacement; each colour given those before it is hypergeometric."""
    out, rest = np.zeros_like(colors), int(colors.sum())
    for j, c in enumerate(colors.tolist()):
        rest -= c
        if n == 0:
            break
        if rest == 0:
            out[j] = n
            break
        k = int(rng.hypergeometric(c, rest, n)) if max(c, rest) < LARGE else invert(rng, c, rest, n)
        out[j] = k
        n -= k
    return out


def invert(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric number by inversion, for urns of any size.

    The probabilities follow from their exact ratios to each other, outwards from the likeliest number; what lies
    too far out for a double to tell from 0 is left out.
    """
    total = good + bad
    low, high = max(0, n - bad), min(good, n)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    deviation = math.sqrt(max(0.0, n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))))
    wide = int(10 * deviation) + 64
    up, down = np.arange(mode, min(high, mode + wide)), np.arange(mode, max(low, mode - wide), -1)
    p_up = np.cumprod((good - up) / (up + 1.0) * ((n - up) / (bad - n + up + 1.0)))
    p_down = np.cumprod(down / (good - down + 1.0) * ((bad - n + down) / (n - down + 1.0)))
    p = np.concatenate((p_down[::-1], [1.0], p_up))
    c = np.cumsum(p)
    return int(mode - len(p_down) + min(np.searchsorted(c, rng.random() * c[-1], side="right"), len(p) - 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each place (from 0, under its n) in the keyed permutation of range(n); all arrays of one length.

    A balanced Feistel network over the next power of four; a place that falls beyond n goes round again.
    """
    out, n = place.astype(np.uint64), n.astype(np.uint64)
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2 + 1e-9).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    key = _mixed(key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    todo = np.arange(len(out))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        left, right = out[todo] >> b, out[todo] & m
        for r in range(6):
            left, right = right, left ^ (_mixed(right + k + np.uint64(r * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) & m)
        out[todo] = left << b | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def hypergeometric_shuffle(df: DataFrame, n_shards: int, seed: int = 7) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (from 0 without gaps in each shard), dealt out by shard and in slot order."""
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "shards")
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    at, dealt = (next(f"{name}{k or ''}" for k in range(len(keep) + 1) if f"{name}{k or ''}" not in {c.lower() for c in keep}) for name in ("row_at", "dealt_to"))
    rows = scratch.keep(df.select(*keep, F.monotonically_increasing_id().alias(at)), "rows")
    counted = rows.groupBy(F.shiftrightunsigned(at, 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # a row a partition
    parts = np.zeros(counted[-1]["p"] + 1 if counted else 1, np.int64)
    for r in counted:
        parts[r["p"]] = r["n"]
    n_cells = max(1, min(len(parts), MAX_CELLS, MAX_NUMBERS // n_shards))
    cell_of = np.arange(len(parts)) % n_cells
    cells = np.bincount(cell_of, weights=parts, minlength=n_cells).astype(np.int64)
    in_cell = np.zeros(len(parts), np.int64)  # rows of the cell in earlier partitions
    for c in range(0, len(parts), n_cells):
        in_cell[c + n_cells : c + 2 * n_cells] = (in_cell[c : c + n_cells] + parts[c : c + n_cells])[: len(in_cell[c + n_cells : c + 2 * n_cells])]
    n = int(parts.sum())
    shards = np.array([n // n_shards + (i < n % n_shards) for i in range(n_shards)], np.int64)
    matrix = communication_matrix(cells, shards, seed)
    cuts, before = np.cumsum(matrix, axis=1), np.cumsum(matrix, axis=0) - matrix
    shared = spark.sparkContext.broadcast((cell_of, in_cell, cells, shards, cuts, before))  # two matrices of MAX_NUMBERS at most

    @F.arrow_udf("struct<shard:int,slot:long>")
    def place(at: pa.Array) -> pa.Array:
        cell_of, in_cell, cells, shards, cuts, before = shared.value
        at = at.to_numpy(zero_copy_only=False)
        part = at >> 33
        cell = cell_of[part]
        rank = permuted(in_cell[part] + (at & _INDEX), cells[cell], cell + (seed << 32))
        shard = np.zeros(len(at), np.int64)
        for c in np.unique(cell):
            shard[cell == c] = np.searchsorted(cuts[c], rank[cell == c], side="right")
        first = np.where(shard > 0, cuts[cell, np.maximum(shard - 1, 0)], 0)
        slot = permuted(before[cell, shard] + rank - first, shards[shard], shard + ((seed + 1) << 32))
        return pa.StructArray.from_arrays([pa.array(shard, pa.int32()), pa.array(slot, pa.int64())], ["shard", "slot"])

    placed = rows.select(*keep, place(at).alias(dealt)).select(*keep, F.col(f"{dealt}.shard").alias("shard"), F.col(f"{dealt}.slot").alias("slot"))
    tasks = max(n_shards, -(-n // STRIP), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(tasks, "shard", F.floor(F.col("slot") / STRIP)).sortWithinPartitions("shard", "slot")
