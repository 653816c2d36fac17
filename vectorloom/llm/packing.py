"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Documents are placed class by class, long ones first; a class is those within a factor of CLASS. In a round the
documents of the class that aren't placed yet and the gaps of all sequences are range-sorted together, by falling size. A
gap that holds several documents of the class is that many slots. Each task sweeps its range: a document takes the
smallest slot at hand that holds it, its successor. What a task can't match goes by rank: the driver, which knows only
how many documents and slots each range has left, gives each range's documents the last ranks of the nearest slots
above, and a join carries that out. Then gaps shrink and the next round begins. Once a round matches few, or its gaps
have room for few, what is left opens new sequences, as many as its tokens fill. The last LANDING documents of a class
(or of all classes that follow), at any size of the table, are placed by the driver in its largest gaps; else nothing
but counts of ranges and classes reaches it.

Edge cases: a null or empty text is its end id alone; a document longer than a sequence is cut into full
sequences, the last piece may be shorter; equal lengths are told apart by their place in the written table; repeated
rows are each packed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.llm import tokens
from vectorloom.runtime import Scratch, ship

#: Longest to shortest of a class of lengths (the first class is half a sequence and more, the second a quarter).
CLASS = 4
#: Documents of a class (and gaps for them) that the driver places at the end, and the share that a round has to match.
LANDING, FEW = 512, 0.02
#: Documents of a range that a task sweeps.
RANGE = 1 << 15

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Every document's ids and end id, cut where longer than a sequence; one row a piece."""
    ship(docs.sparkSession)
    end = struct.pack("<I", end_id)
    most = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            for d, ids in zip(b.column("doc_id").to_pylist(), tokens.encode_column(tokenizer_path, b.column("text")), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), most)):
                    part = ids[at : at + most]
                    doc.append(d)
                    piece.append(k)
                    start.append(at >> 2)
                    length.append(len(part) >> 2)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES + (", ids binary" if with_ids else ""))


_SWEPT = "part int, what int, rank long, rid long, length long, seq long"
_MATCH, _DOCUMENT, _SLOT = 0, 1, 2


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match documents (kind 1) with slots (kind 0) within one range, both by falling size, slots first.

    The slots passed are a stack, whose top is the smallest; unmatched documents keep their order, and slots theirs.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "id", "size")) for b in batches]
    if not held:
        return
    kinds, ids, sizes = (np.concatenate(c) for c in zip(*held, strict=True))
    stack: list[int] = []
    documents: list[int] = []
    pairs: list[tuple[int, int]] = []
    for i, kind in enumerate(kinds.tolist()):
        if kind == 0:
            stack.append(i)
        elif stack:
            pairs.append((i, stack.pop()))
        else:
            documents.append(i)
    matched = np.array(pairs, np.int64).reshape(-1, 2)
    for what, document, slot in ((_MATCH, matched[:, 0], matched[:, 1]), (_DOCUMENT, np.array(documents, np.int64), None), (_SLOT, None, np.array(stack, np.int64))):
        some = slot if document is None else document
        for at in range(0, len(some), 1 << 16):
            n = len(some[at : at + (1 << 16)])
            d, s = (None if k is None else k[at : at + n] for k in (document, slot))
            nothing = pa.nulls(n, pa.int64())
            cols = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, what, np.int32)), pa.array(np.arange(at, at + n))]
            cols += [nothing, nothing] if d is None else [pa.array(ids[d]), pa.array(sizes[d])]
            yield pa.RecordBatch.from_arrays([*cols, nothing if s is None else pa.array(ids[s])], ["part", "what", "rank", "rid", "length", "seq"])


def settle(left: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """Who takes what across ranges: (range, first rank, number) of documents, and the range and last rank of their slots.

    ``left``: how many documents and slots (range, what) are unmatched. Ranges go by falling size, so the nearest
    slots above are those passed last; of a range's slots the last rank is the smallest.
    """
    stack: list[list[int]] = []
    out = []
    for part in sorted({p for p, _ in left}):
        first, n = 0, left.get((part, _DOCUMENT), 0)
        while n and stack:
            take = min(n, stack[-1][1])
            out.append((part, first, take, stack[-1][0], stack[-1][1] - 1))
            first, n = first + take, n - take
            stack[-1][1] -= take
            if not stack[-1][1]:
                stack.pop()
        if left.get((part, _SLOT), 0):
            stack.append([part, left[part, _SLOT]])
    return out


def _round(state: DataFrame, low: int, high: int, parts: int, scratch: Scratch) -> tuple[list[DataFrame], int]:
    """One round over ``state`` (kind, id, size), slots for documents of up to ``high``: written tables that hold placements, and their number."""
    spark = state.sparkSession
    documents = state.where(F.col("kind") == 1).withColumn("slot", F.lit(0))
    slots = F.greatest(F.lit(1), F.floor(F.col("size") / high)).cast("int")
    gaps = state.where(F.col("kind") == 0).where(F.col("size") > low).withColumn("slots", slots)
    gaps = gaps.select("kind", "id", F.floor(F.col("size") / F.col("slots")).cast("long").alias("size"), F.explode(F.sequence(F.lit(1), "slots")).alias("slot"))
    order = [F.col("size").desc(), "kind", "id", "slot"]
    both = documents.select(*gaps.columns).unionByName(gaps).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    swept = scratch.keep(both.select("kind", "id", "size").mapInArrow(_sweep, _SWEPT), "swept")
    left = {(r["part"], r["what"]): r["n"] for r in swept.groupBy("part", "what").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows a range
    matched = sum(n for (_, what), n in left.items() if what == _MATCH)
    tables = [swept] if matched else []
    across = settle(left)
    if across:
        matched += sum(x[2] for x in across)
        table = F.broadcast(spark.createDataFrame(across, "part int, first long, n long, slot_part int, last long"))  # two rows a range
        takers = swept.where(F.col("what") == _DOCUMENT).join(table, "part").where("rank >= first and rank < first + n")
        takers = takers.select("rid", "length", F.col("slot_part").alias("part"), (F.col("last") - (F.col("rank") - F.col("first"))).alias("rank"))
        pairs = takers.join(swept.where(F.col("what") == _SLOT).select("part", "rank", "seq"), ["part", "rank"]).withColumn("what", F.lit(_MATCH))
        tables.append(scratch.keep(pairs.select("part", "what", "rank", "rid", "length", "seq"), "across"))
    if not tables:
        scratch.drop(swept)
    return tables, matched


def _moved(old: DataFrame, placed: DataFrame, scratch: Scratch) -> DataFrame:
    """``old`` without the documents ``placed`` (rid, length, seq), its gaps as much smaller: one sum by (kind, id)."""
    less = placed.select(F.lit(1).alias("kind"), F.col("rid").alias("id"), (-F.col("length")).alias("size"))
    less = less.unionByName(placed.select(F.lit(0).alias("kind"), F.col("seq").alias("id"), (-F.col("length")).alias("size")))
    new = old.unionByName(less).groupBy("kind", "id").agg(F.sum("size").alias("size")).where("size > 0")
    new = scratch.keep(new, "state")
    scratch.drop(old)
    return new


def _beside(state: DataFrame, more: DataFrame) -> DataFrame:
    """Both, not written; the next written state takes their place."""
    out = state.unionByName(more)
    out._scratch_path = getattr(state, "_scratch_path", None)
    return out


def _fresh(spark: SparkSession, first: int, n: int, capacity: int) -> DataFrame:
    """New sequences -first - 1, -first - 2, ..., as gaps."""
    return spark.range(first, first + n).select(F.lit(0).alias("kind"), (-1 - F.col("id")).alias("id"), F.lit(capacity).cast("long").alias("size"))


_PLACED = "rid long, length long, seq long"


def _landing(state: DataFrame, capacity: int, opened: int) -> tuple[list[tuple], int]:
    """Placements of the last documents, in the largest gaps and in new sequences, by best fit; and the number of sequences opened."""
    documents = state.where(F.col("kind") == 1).select("size", "id").collect()  # LANDING rows
    gaps = state.where(F.col("kind") == 0).orderBy(F.col("size").desc(), "id").limit(LANDING).select("size", "id").collect()
    free = sorted((g, i) for g, i in gaps)
    rows = []
    for size, rid in sorted(map(tuple, documents), key=lambda d: (-d[0], d[1])):
        at = bisect.bisect_left(free, (size, -(1 << 63)))
        if at == len(free):
            opened += 1
            free.append((capacity, -opened))
        gap, seq = free.pop(at)
        rows.append((rid, size, seq))
        if gap > size:
            bisect.insort(free, (gap - size, seq))
    return rows, opened


def best_fit(sizes: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """(rid, seq, offset) of every row of ``sizes`` (rid long, length long).

    Sizes are written once, a folder a class, so that a class reads its own documents only. Places in a sequence go by
    rid and are worked out once, after the last round.
    """
    spark = sizes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    classes, high = [], capacity // 2
    while high:
        low = high // 2 if not classes else high // CLASS
        classes.append((low, high))
        high = low
    lows = [capacity // 2, *(low for low, _ in classes)]
    of_class = F.coalesce(*[F.when(F.col("length") > low, F.lit(k)) for k, low in enumerate(lows)])
    sizes = scratch.keep(sizes.withColumn("class", of_class), "sizes", partition_by=["class"])
    number = dict(sizes.groupBy("class").agg(F.count(F.lit(1))).collect())  # a row a class
    # more than half a sequence: each opens one of its own, named as itself
    large = sizes.where(F.col("class") == 0)
    state = large.where(F.col("length") < capacity).select(F.lit(0).alias("kind"), F.col("rid").alias("id"), (F.lit(capacity) - F.col("length")).alias("size"))
    swept: list[str] = []  # where the rounds' placements lie
    landed: list[tuple] = []  # LANDING rows a class
    opened, k = 0, 1
    while k < len(lows):
        # the gaps and the documents of this class, or of all that follow where they are few
        rest = sum(number.get(c, 0) for c in range(k, len(lows)))
        last = k if rest > LANDING else len(lows) - 1
        low, high = classes[last - 1][0], classes[k - 1][1]
        left = sum(number.get(c, 0) for c in range(k, last + 1))
        if left:
            state = _beside(state, sizes.where(F.col("class").between(k, last)).select(F.lit(1).alias("kind"), F.col("rid").alias("id"), F.col("length").alias("size")))
        k, few = last + 1, False
        while left:
            if left <= LANDING:
                rows, more = _landing(state, capacity, opened)
                landed += rows
                if left < rest:
                    state = _moved(_beside(state, _fresh(spark, opened, more - opened, capacity)), spark.createDataFrame(rows, _PLACED), scratch)
                opened = more
                break
            document, gap = F.when(F.col("kind") == 1, F.col("size")), F.when((F.col("kind") == 0) & (F.col("size") > low), F.col("size"))
            least, top, tokens, widest, room, slots = state.agg(F.min(document), F.max(document), F.sum(document), F.max(gap), F.sum(F.floor(gap / (low + 1))), F.sum(F.greatest(F.lit(1), F.floor(gap / high)) * F.when(gap > 0, 1))).first()
            if few or not widest or widest < least or room < FEW * left:  # too few would match
                need = max(1, -(-tokens // capacity), left // (capacity // (low + 1)))
                state = _beside(state, _fresh(spark, opened, need, capacity))
                opened, slots = opened + need, (slots or 0) + need * (capacity // top)
            tables, n = _round(state, low, top, min(parts, max(4, (left + slots) // RANGE)), scratch)
            few = n < FEW * left
            if n:
                paths = [t._scratch_path for t in tables]
                state = _moved(state, _placements(spark, paths), scratch)
                swept += paths
                left, rest = left - n, rest - n
    out = large.select("rid", "length", F.col("rid").alias("seq"))
    if landed:
        out = out.unionByName(spark.createDataFrame(landed, _PLACED))
    if swept:
        out = out.unionByName(_placements(spark, swept))
    ahead = Window.partitionBy("seq").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)  # the documents of one sequence
    return out.select("rid", "seq", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"))


def _placements(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(_SWEPT).parquet(*paths).where(F.col("what") == _MATCH).select("rid", "length", "seq")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, where asked) of every piece."""
    if capacity < 2:
        raise ValueError("a sequence holds two ids or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = pieces_of(docs, tokenizer_path, end_id, capacity, with_ids).withColumn("rid", F.monotonically_increasing_id())
    pieces = scratch.keep(cut, "pieces")
    placed = scratch.keep(best_fit(pieces.select("rid", "length"), capacity, scratch), "places")
    out = pieces.join(placed, "rid")
    return out.select(*[c for c in pieces.columns if c != "rid"], F.col("seq").alias("sequence_id"), "offset")
