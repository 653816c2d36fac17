"""Personal data: fixed base patterns, and bootstrapped contextual extraction of what they miss.

The base kinds (email, ip, card, phone) and secrets of unmistakable form (long mixed hexadecimal strings, cloud access
ids) seed the bootstrap. Each seed induces lexical patterns: the two words before (A), the word on either side (B), the
two words after (C), the name it is assigned to (K), the assignment mark alone (O) and its own character shape (S).
Patterns induced by enough different seeds are looked up in the whole corpus. What fills a slot is an instance if it
holds a digit or an @, else it counts against the pattern. Spark scores the graph of patterns and instances in rounds:
a pattern's confidence for a kind is its fillers' score by all its fillers (those not known yet count UNKNOWN), an
instance's score is the noisy-or of its confident patterns; seeds keep the score 1 for their kind. Accepted instances
induce patterns as seeds do; the corpus is read for the new ones, until there are none or PASSES are done. Seeds that are
secrets and accepted instances are the new spans.

A pattern is kept if MIN_SEEDS different seeds of a kind induce it, however large the corpus. Up to MAX_BROADCAST
patterns are sent to every task; beyond, tasks get a sketch of fixed size that misses none of them, and what passes
it is joined with the table of patterns.

Edge cases: a null or empty text has no spans; offsets are code points, the end is exclusive; new spans never
overlap base ones; of new spans that overlap, kind order and start decide; rows that repeat get the same spans;
an empty table gives no rows; other columns are carried by ``redact`` and ignored by ``find``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm import memo
from vectorloom.runtime import Scratch, ship

#: The base kinds, then those that only the bootstrap finds.
KINDS, BASE = ("email", "ip", "card", "phone", "secret"), 4
MIN_SEEDS, CONFIDENT, ACCEPT, UNKNOWN, ROUNDS, PASSES = 3, 0.5, 0.8, 0.5, 3, 4
#: Patterns sent to every task; bits of their sketch beyond that, and of one part of it; counts and words a task holds.
MAX_BROADCAST, SKETCH_BITS, _PART_BITS, HELD = 1 << 16, 27, 17, 1 << 17
#: Words kept per worker process; the table is emptied when full.
MAX_WORDS = 200_000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|AKIA[0-9A-Z]{16})(?![0-9A-Za-z])")
_ASSIGNED = re.compile(r"([A-Za-z_][A-Za-z0-9_-]*)\s?([=:])\s?[\"']?$")
_HEX, _CAPITALS = re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{12,}"), re.compile(r"(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]{12,}")
_DIGITS, _SMALL, _LARGE = re.compile(r"[0-9]+"), re.compile(r"[a-z]+"), re.compile(r"[A-Z]+")
_WORD = re.compile(r"\S+")
_EDGE = ".,;:!?()[]{}<>\"'"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end), leftmost and non-overlapping for each kind; matches that fail their test are dropped."""
    out: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        # a match has to hold this @; the leftmost one starts where the run of local characters does
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NO_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def secrets(text: str, base: list[Span]) -> list[Span]:
    """Spans of secrets of unmistakable form that touch no base span."""
    out = []
    for m in _SECRET.finditer(text):
        x, y = m.span()
        if not m[0].isdigit() and not m[0].isalpha() and not any(s < y and x < e for _, s, e in base):
            out.append((4, x, y))
    return out


def shape(word: str) -> str:
    """What characters a word is made of: mixed hexadecimal, mixed capitals, the length of a number, or its runs."""
    if word.isdigit():
        return f"9x{len(word)}"
    if len(word) >= 12 and (_HEX.fullmatch(word) or _CAPITALS.fullmatch(word)):
        return "hex" if word[0].islower() or word.lower() == word else "capitals"
    return _LARGE.sub("A", _SMALL.sub("a", _DIGITS.sub("9", word)))


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Two whole words before and after the words that hold a span."""
    while start and not text[start - 1].isspace():
        start -= 1
    n = len(text)
    while end < n and not text[end].isspace():
        end += 1
    width = 120
    while True:
        left = text[max(0, start - width) : start].lower().split()
        if len(left) > 2 or start <= width:
            break
        width *= 4
    width = 120
    while True:
        right = text[end : end + width].lower().split()
        if len(right) > 2 or end + width >= n:
            break
        width *= 4
    return left[-2:], right[:2]


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """The patterns that a span fills."""
    left, right = _around(text, start, end)
    out = []
    if len(left) > 1:
        out.append(f"A {left[-2]} {left[-1]}")
    if left and right:
        out.append(f"B {left[-1]} {right[0]}")
    if len(right) > 1:
        out.append(f"C {right[0]} {right[1]}")
    m = _ASSIGNED.search(text, max(0, start - 64), start)
    if m:
        out += [f"K {m[1].lower()}{m[2]}", f"O {m[2]}"]
    word = text[start:end]
    return out if any(c.isspace() for c in word) else [*out, f"S {shape(word)}"]


class _Marks(dict):
    """Of a word: 1 if an identifier could fill it (it holds a digit or an @), 2 if it assigns something."""

    def __missing__(self, word: str) -> int:
        some = any(c.isdigit() for c in word) or "@" in word
        got = int(some) | (2 if word[-1] in "=:" or "=" in word else 0)
        if len(word) <= 64:
            self[word] = got
        return got


_SPANS = "array<struct<k:int,s:long,e:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = pa.list_(pa.struct([("k", pa.int32()), ("inst", pa.string()), ("pat", pa.string())]))
    for b in batches:
        base, more, context = [], [], []
        for text in b.column("text").to_pylist():
            spans = base_spans(text) if text else []
            base.append([{"k": k, "s": s, "e": e} for k, s, e in spans])
            hidden = secrets(text, spans) if text else []
            more.append([{"k": k, "s": s, "e": e} for k, s, e in hidden])
            around = []
            for k, s, e in spans + hidden:
                inst = text[s:e]
                around += [{"k": k, "inst": inst, "pat": p} for p in patterns_of(text, s, e)]
            context.append(around)
        cols = [b.column("doc_id"), b.column("rid"), pa.array(base, _SPAN_TYPE), pa.array(more, _SPAN_TYPE), pa.array(context, seeds)]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rid", "base", "more", "context"])


def _place(key: str, bits: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key) >> (64 - bits)


def _sketch_parts(bits: int):
    """Set bits of a sketch of patterns and their first words, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << bits, bool)
        for b in batches:
            for p in b.column("pat").to_pylist():
                flags[_place(p, bits)] = True
                if p[0] in "ABC":
                    flags[_place(p.split(" ")[1], bits)] = True
        parts = [(k, flags[k << _PART_BITS : (k + 1) << _PART_BITS]) for k in range(-(-len(flags) >> _PART_BITS))]
        parts = [(k, np.packbits(f, bitorder="little").tobytes()) for k, f in parts if f.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([f for _, f in parts], pa.binary())], ["part", "flags"])

    return run


def _sketch_or(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    whole = np.bitwise_or.reduce([np.frombuffer(f, np.uint8) for f in table.column("flags").to_pylist()])
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "flags": pa.array([whole.tobytes()], pa.binary())})


def _sketch(held: DataFrame, n: int):
    """The broadcast sketch of n patterns and its bits; at most 2 ** SKETCH_BITS bits, of which the driver joins the parts."""
    bits = min(SKETCH_BITS, max(16, (8 * n).bit_length()))
    parts = held.mapInArrow(_sketch_parts(bits), "part long, flags binary").groupBy("part").applyInArrow(_sketch_or, "part long, flags binary")
    whole = bytearray(1 << (bits - 3))
    for r in parts.collect():
        at = r["part"] << (_PART_BITS - 3)
        whole[at : at + len(r["flags"])] = r["flags"]
    return held.sparkSession.sparkContext.broadcast(bytes(whole)), bits


class _MayHold:
    """Words and patterns by a sketch: holds all that were put in, and some more."""

    def __init__(self, flags: bytes, bits: int):
        self.flags, self.bits, self.known = flags, bits, {}

    def __contains__(self, word: str) -> bool:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= HELD:
                self.known.clear()
            at = _place(word, self.bits)
            got = self.known[word] = bool(self.flags[at >> 3] >> (at & 7) & 1)
        return got

    def isdisjoint(self, words: list[str]) -> bool:
        return not any(w in self for w in words)


_FILLERS = "rid long, inst string, s long, e long, ctx array<string>, pat string, n long"


def _plain_fillers(words: list[str], marks: list[int], firsts, held) -> Iterator[str]:
    """The held patterns whose slots words without a digit or @ fill, once for each slot."""
    last = len(words) - 1
    for i, w in enumerate(words):
        if w in firsts:
            if i + 2 <= last:
                if not marks[i + 2] & 1 and (p := f"A {w} {words[i + 1]}") in held:
                    yield p
                if not marks[i + 1] & 1 and (p := f"B {w} {words[i + 2]}") in held:
                    yield p
            if i and i < last and not marks[i - 1] & 1 and (p := f"C {w} {words[i + 1]}") in held:
                yield p
        if marks[i] & 2:
            if w[-1] in "=:":
                name = w[:-1] or (words[i - 1] if i else "")
                plain = i < last and not marks[i + 1] & 1
            else:
                name, plain = w.rsplit("=", 1)[0], not marks[i] & 1
            if plain:
                op = w[-1] if w[-1] in "=:" else "="
                yield from (p for p in (f"K {name}{op}", f"O {op}") if p in held)


def _second(lookup):
    """Fillers of the patterns' slots: those that hold a digit or an @ one by one, all others as counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        against: Counter[str] = Counter()
        names = ["rid", "inst", "s", "e", "ctx", "pat", "n"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64()]
        firsts, held = lookup()
        known = memo.table("marks", _Marks)

        def counts():
            n = len(against)
            cols = [[None] * n, [None] * n, [None] * n, [None] * n, [None] * n, list(against), list(against.values())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for b in batches:
            rows: list[tuple] = []
            if len(known) > MAX_WORDS:
                known.clear()
            for rid, text in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = text.lower().split() if text else []
                marks = list(map(known.__getitem__, words))
                some = any(marks)
                if not some and firsts.isdisjoint(words):
                    continue
                against.update(_plain_fillers(words, marks, firsts, held))
                slots = [i for i, m in enumerate(marks) if m & 1] if some else []
                if not slots:
                    continue
                places, base = [m.span() for m in _WORD.finditer(text)], base_spans(text)
                base += secrets(text, base)
                for i in slots:
                    s, e = places[i]
                    at = text.rfind("=", s, e - 1)
                    s = at + 1 if at >= 0 else s
                    while s < e and text[s] in _EDGE:
                        s += 1
                    while e > s and text[e - 1] in _EDGE:
                        e -= 1
                    if s == e or any(x < e and s < y for _, x, y in base):
                        continue
                    ctx = patterns_of(text, s, e)
                    if any(p in held for p in ctx):
                        rows.append((rid, text[s:e], s, e, ctx, None, 1))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            if len(against) >= HELD:
                yield counts()
                against.clear()
        if against:
            yield counts()

    return run


def score_graph(known: DataFrame, plain: DataFrame, open_: DataFrame, scratch: Scratch, few: bool = True) -> DataFrame:
    """(inst, k) of the instances accepted.

    ``known``: (pat, k, n) fillers that are seeds; ``plain``: (pat, n) fillers that no identifier can be;
    ``open_``: (pat, inst, n) the rest. ``few``: a row a pattern can be broadcast.
    """
    small = F.broadcast if few else lambda df: df
    known = known.select("pat", F.col("k").alias("kind"), F.col("n").cast("double").alias("mass"))
    scores = None
    for _ in range(ROUNDS):
        doubtful = open_.withColumn("rest", F.col("n") * F.lit(UNKNOWN))
        mass = known
        if scores is not None:
            best = scores.groupBy("inst").agg(F.max("score").alias("best"))
            doubtful = open_.join(best, "inst", "left").withColumn("rest", F.col("n") * F.lit(UNKNOWN) * (1 - F.coalesce("best", F.lit(0.0))))
            mass = known.unionByName(open_.join(scores.withColumnRenamed("k", "kind"), "inst").select("pat", "kind", (F.col("n") * F.col("score")).alias("mass")))
        mass = mass.groupBy("pat", "kind").agg(F.sum("mass").alias("mass"))
        weight = mass.select("pat", F.col("mass").alias("w")).unionByName(plain.select("pat", F.col("n").cast("double").alias("w"))).unionByName(doubtful.select("pat", F.col("rest").alias("w")))
        totals = weight.groupBy("pat").agg(F.sum("w").alias("total"))  # a row a pattern
        conf = mass.join(small(totals), "pat").select("pat", "kind", (F.col("mass") / (F.col("total") + 1)).alias("conf")).where(F.col("conf") >= CONFIDENT)
        doubt = F.exp(F.sum(F.log(1 - F.least(F.col("conf"), F.lit(0.999)))))
        scores = scratch.keep(open_.join(small(conf), "pat").groupBy("inst", F.col("kind").alias("k")).agg((1 - doubt).alias("score")), "scores")
    return scores.where(F.col("score") >= ACCEPT).select("inst", "k")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.withColumn("__vl_rid", F.xxhash64(F.col("doc_id").cast("long"), text))


def _may(k: str, inst: str) -> F.Column:
    """Whether an instance can be of a kind by the kind's own rules; what the base patterns refuse stays refused."""
    digits = F.regexp_replace(inst, "[^0-9]", "")
    twice = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    places = F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0)))
    luhn_sum = F.aggregate(places, F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(i)).when(twice(i) > 4, 2 * twice(i) - 9).otherwise(2 * twice(i)))
    card = F.length(digits).between(16, 19) & (luhn_sum % 10 == 0)
    address = ~F.col(inst).rlike(r"^[0-9]+(\.[0-9]+){3}$")
    return F.when(F.col(k) == 0, F.col(inst).rlike("^.+@.+$")).when(F.col(k) == 1, address).when(F.col(k) == 2, F.coalesce(card, F.lit(False))).otherwise(F.col(inst).rlike("[0-9]"))


def _discover(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rid, base) of every row, and (rid, found) of rows with new spans."""
    spark = docs.sparkSession
    ship(spark)
    slim = _keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__vl_rid").alias("rid"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id long, rid long, base {_SPANS}, more {_SPANS}, context array<struct<k:int,inst:string,pat:string>>"
    first = scratch.keep(slim.mapInArrow(_first, schema), "base")
    seeds = first.select(F.explode("context").alias("c")).groupBy("c.k", "c.inst", "c.pat").agg(F.count(F.lit(1)).alias("n"))
    seeds = scratch.keep(seeds, "seeds")
    known = seeds.groupBy("pat", "k").agg(F.sum("n").alias("n"))
    induced = seeds.select("k", "inst", "pat")
    fillers = read = taken = None
    for _ in range(PASSES):
        held = induced.groupBy("k", "pat").agg(F.count_distinct("inst").alias("seeds")).where(F.col("seeds") >= MIN_SEEDS).select("pat").distinct()
        fresh = scratch.keep(held.join(read, "pat", "left_anti") if read is not None else held, "patterns")
        n = fresh.count()
        if not n:
            break
        if n <= MAX_BROADCAST:
            patterns = frozenset(r["pat"] for r in fresh.collect())
            lookup = lambda p=patterns: (frozenset(x.split(" ")[1] for x in p if x[0] in "ABC"), p)
        else:
            flags, bits = _sketch(fresh, n)

            def lookup(flags=flags, bits=bits):
                both = _MayHold(flags.value, bits)
                return both, both

        got = scratch.keep(slim.select("rid", "text").mapInArrow(_second(lookup), _FILLERS), "fillers")
        fillers = got if fillers is None else fillers.unionByName(got)
        read = fresh if read is None else read.unionByName(fresh)
        few = read.count() <= MAX_BROADCAST
        ours = lambda df, read=read, few=few: df.join(F.broadcast(read) if few else read, "pat", "left_semi")
        spots = fillers.where("pat is null").dropDuplicates(["rid", "s", "e"])
        open_ = spots.select("inst", F.explode("ctx").alias("pat")).groupBy("pat", "inst").agg(F.count(F.lit(1)).alias("n"))
        open_ = scratch.keep(ours(open_), "graph")
        plain = ours(fillers.where("pat is not null").groupBy("pat").agg(F.sum("n").alias("n")))
        taken = score_graph(ours(known), plain, open_, scratch, few)
        more = spots.join(taken, "inst").where(_may("k", "inst")).select("k", "inst", F.explode("ctx").alias("pat"))
        induced = seeds.select("k", "inst", "pat").unionByName(more.distinct())
    mark = F.struct(F.col("k").cast("int").alias("k"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    spots = first.select("rid", F.explode("more").alias("x")).select("rid", "x.k", "x.s", "x.e")
    if taken is not None:
        new = fillers.where("pat is null").join(taken, "inst").where(_may("k", "inst"))
        spots = spots.unionByName(new.select("rid", "k", "s", "e"))
    found = spots.select("rid", mark.alias("x")).distinct().groupBy("rid").agg(F.array_sort(F.collect_list("x")).alias("x"))  # spans of one text
    # of overlapping new spans the first in order stays
    apart = F.aggregate("x", F.slice("x", 1, 0), lambda got, x: F.when(F.exists(got, lambda g: (g["s"] < x["e"]) & (x["s"] < g["e"])), got).otherwise(F.concat(got, F.array(x))))
    return first.select("doc_id", "rid", "base"), scratch.keep(found.select("rid", apart.alias("found")), "found")


def _text_of(spans) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans (all, as kind:start:end) and n_found of every row."""
    scratch = Scratch(docs.sparkSession, "pii")
    base, found = _discover(docs, scratch)
    out = base.join(found, "rid", "left").withColumn("found", F.coalesce("found", F.array().cast(_SPANS)))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    ordered = F.array_sort("base")
    return out.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])], F.sha2(_text_of(ordered).cast("binary"), 256).alias("base_sha256"),
        _text_of(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_found"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``n_chars``, if there, follows the text."""
    scratch = Scratch(docs.sparkSession, "redact")
    _, found = _discover(docs, scratch)
    keyed = _keyed(docs)
    few = found.count() <= 1 << 17
    found = found.toDF("__vl_rid", "__vl_found")
    keyed = keyed.join(F.broadcast(found) if few else found, "__vl_rid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, found in zip(b.column("text").to_pylist(), b.column("__vl_found").to_pylist(), strict=True):
                spans = sorted([(s, e, k) for k, s, e in base_spans(text)] if text else [])
                spans = sorted(spans + [(x["s"], x["e"], x["k"]) for x in found or []])
                if spans:
                    parts, at = [], 0
                    for s, e, k in spans:
                        if e <= at:
                            continue
                        parts += [text[at : max(s, at)], f"<{KINDS[k]}>"] if s >= at else []
                        at = e
                    text = "".join((*parts, text[at:]))
                texts.append(text)
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    out = keyed.mapInArrow(run, keyed.schema).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
