"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a share of a total by its weight; a target stops at ``max_repeat`` times the source's size
and what is cut off goes to the others by weight. A document of a source with rate ``r = target / size`` is
taken ``floor(r)`` times for sure and once more with probability ``frac(r)``. The extra copies are drawn by the
cube method: the vector of fractional probabilities moves through the null space of two constraints, the
number of documents and the number of tokens, one unit settling at each step, so both totals stay as expected
until fewer than three units are open. Documents are dealt into small groups by hash, each group flies on its
own, and what is left open goes up into wider groups until one small landing problem remains in each source.

Edge cases: a null text has size 0; a null source is a source of its own, the last one; rows that repeat are
units of their own; a source of size 0 has target 0 and is not taken; an empty table gives no rows; other
columns are ignored or, in ``mix_rows``, carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.runtime import Scratch, ship

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
GROUP = 1_024
_UNITS = "doc_id long, source string, size long, s int, g long, base int, pi double"


def water_fill(sizes: list[int], weights: list[float], share: float, max_repeat: float) -> list[float]:
    """Targets that sum to ``share`` of all sizes, in proportion to weight, none above ``max_repeat`` times its size."""
    total = share * sum(sizes)
    caps = [max_repeat * s for s in sizes]
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = min(total, float(sum(caps)))
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > caps[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / whole
            break
        for i in over:
            target[i] = caps[i]
            left -= caps[i]
            open_.discard(i)
    return target


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``pi`` (all strictly between 0 and 1) until fewer than three entries are fractional."""
    out = pi.tolist()
    sizes = size.tolist()
    draws = iter(rng.random(len(out) + 3).tolist())
    todo = iter(range(len(out)))
    held: list[int] = []
    for i in todo:
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # orthogonal to (1, 1, 1) and to the sizes
        u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
        if not any(u):
            u = (1, -1, 0)
        up = down = float("inf")
        for k, d in zip(held, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - out[k]) / d), min(down, out[k] / d)
            elif d < 0:
                up, down = min(up, out[k] / -d), min(down, (1 - out[k]) / -d)
        step = up if next(draws) * (up + down) < down else -down
        for k, d in zip(held, u, strict=True):
            x = out[k] + step * d
            out[k] = 0.0 if x < 1e-12 else 1.0 if x > 1 - 1e-12 else x
        held = [k for k in held if 0 < out[k] < 1]
    return np.array(out)


def landing(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the few open units: of all roundings the one that keeps the token total nearest, then the count.

    What the total is still off by is made up by one exchange of a taken and an untaken unit, where one helps.
    """
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    out = pi.copy()
    if not len(open_):
        return out
    off_by = lambda m: sum(size[k] * ((m >> j & 1) - pi[k]) for j, k in enumerate(open_))
    best = min(range(1 << len(open_)), key=lambda m: (abs(off_by(m)), abs(sum((m >> j & 1) - pi[k] for j, k in enumerate(open_))), m))
    for j, k in enumerate(open_):
        out[k] = best >> j & 1
    off = float(off_by(best))
    taken, rest = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
    if len(taken) and len(rest):
        rest = rest[np.argsort(size[rest], kind="stable")]
        want = size[taken] - off
        at = np.searchsorted(size[rest], want)
        near = np.stack((np.maximum(at - 1, 0), np.minimum(at, len(rest) - 1)))
        gap = np.abs(size[rest][near] - want)
        r, c = np.unravel_index(np.argmin(gap), gap.shape)
        if gap[r, c] < abs(off):
            out[taken[c]], out[rest[near[r, c]]] = 0.0, 1.0
    return out


def _fly(units: DataFrame, groups: list[str], seed: int, last: bool) -> DataFrame:
    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id"], kind="stable", na_position="first").reset_index(drop=True)
        pi = pdf["pi"].to_numpy().copy()
        at = np.flatnonzero((pi > 0) & (pi < 1))
        size = pdf["size"].to_numpy()
        if len(at):
            rng = np.random.Generator(np.random.Philox(key=[seed, (int(key[0]) << 40) + int(key[1])]))
            order = rng.permutation(len(at))
            pi[at[order]] = flight(pi[at[order]], size[at[order]], rng)
        pdf["pi"] = landing(pi, size) if last else pi
        return pdf

    return units.groupBy(*groups).applyInPandas(one, _UNITS)


def targets(sized: DataFrame, share: float, weights: tuple[float, ...], max_repeat: float) -> list[dict]:
    """One entry for each source in order of code points, null last."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # a row a source
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    got = water_fill([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, max_repeat)
    return [{"s": i, "source": r["source"], "source_size": r["size"], "n": r["n"], "target": t} for i, (r, t) in enumerate(zip(rows, got, strict=True))]


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = 2.0, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row of ``docs`` (doc_id, source, text)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    sized = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "sized")
    plan = targets(sized, share, weights, max_repeat)
    if not plan:
        return sized.select("*", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("copies"))
    rows = []
    for p in plan:
        rate = p["target"] / p["source_size"] if p["source_size"] else 0.0
        base = min(int(rate + 1e-9), int(max_repeat))
        frac = rate - base
        rows.append((p["s"], p["source"], p["source_size"], p["target"], base, frac if 1e-9 < frac < 1 - 1e-9 else 0.0, max(1, p["n"] // GROUP)))
    table = spark.createDataFrame(rows, "s int, source string, source_size long, target double, base int, pi double, n_groups long")

    group = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("n_groups"))
    units = sized.join(F.broadcast(table.select(F.col("source").alias("named"), "s", "base", "pi", "n_groups")), sized["source"].eqNullSafe(F.col("named")))
    units = units.select("doc_id", "source", "size", "s", group.alias("g"), "base", F.col("pi"))
    most = max(r[6] for r in rows)
    done: list[DataFrame] = []
    while True:
        last = most == 1
        flown = scratch.keep(_fly(units, ["s", "g"], seed, last), "flown")
        settled = (F.col("pi") == 0) | (F.col("pi") == 1)
        done.append(flown.where(settled))
        if last:
            break
        most = 1 if most <= GROUP else -(-most // GROUP)
        units = flown.where(~settled).withColumn("g", F.lit(0).cast("long") if most == 1 else F.floor(F.col("g") / GROUP))
        seed += 1
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    out = every.join(F.broadcast(table.select("s", "source_size", "target")), "s")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("pi")).cast("int").alias("copies"))


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` itself as the mix takes it: each row as often as it is taken, with all its columns.

    Rows are matched by (doc_id, source, size); of rows equal in all three any may be the one taken.
    """
    key = ["__vl_doc", "__vl_source", "__vl_size"]
    took = mix(docs, **options).groupBy(F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.col("size").alias(key[2]))
    took = took.agg(F.sort_array(F.collect_list("copies"), asc=False).alias("__vl_copies"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    keyed = docs.withColumns({key[0]: F.col("doc_id").cast("long"), key[1]: F.col("source").cast("string"), key[2]: size})
    keyed = keyed.withColumn("__vl_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text"))))
    took = took.toDF("__b0", "__b1", "__b2", "__vl_copies")
    same = F.lit(True)
    for a, b in zip(key, took.columns, strict=False):
        same = same & F.col(a).eqNullSafe(F.col(b))
    copies = F.element_at("__vl_copies", F.col("__vl_k"))
    out = keyed.join(took, same).withColumn("__vl_copies", copies).where("__vl_copies > 0")
    return out.withColumn("__vl_copy", F.explode(F.sequence(F.lit(1), F.col("__vl_copies")))).select(*docs.columns)
