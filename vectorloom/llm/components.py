"""Connected components of an edge table, by smallest label with pointer jumping; every round is one written table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.runtime import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a long, b long); label is the smallest vertex it reaches.

    Labels only fall, and each round both takes the smallest label around and jumps to the label's own label,
    so the rounds grow with the logarithm of the longest path.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.keep(both, "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v", "left").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        step = step.join(jump, "label", "left").select("v", "old", F.least("label", "far").alias("label"))
        new = scratch.keep(step, "labels")
        moved = new.where("label <> old").limit(1).count()
        scratch.drop(labels)
        labels = new.select("v", "label")
        labels._scratch_path = new._scratch_path
        if not moved:
            return labels


#: Edges of one group that a task thins out, about.
THIN = 1 << 18


def _forest_edges(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    kept = [(v, find(v)) for v in sorted(root) if find(v) != v]
    a, b = zip(*kept, strict=True) if kept else ([], [])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def thinned(edges: DataFrame) -> DataFrame:
    """Edges that connect the same vertices: groups of bounded size, each cut down to a spanning forest."""
    groups = max(1, edges.count() // THIN)
    return edges.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(groups)).alias("g")).groupBy("g").applyInArrow(_forest_edges, "a long, b long")
