"""Operators of the corpus subpackage against brute force, on small tables with awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vectorloom.runtime import Scratch
from vectorloom.llm import components, image_copies, maxscore, mixing, ngram_join, packing, pii, quality, shards, token_store, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int"


def docs(spark, texts, source=lambda i: "ab"[(i or 0) % 2]):
    rows = [(i, t, "en", source(i), len(t or ""), 0.5, 3) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


AWKWARD = [(1, None), (2, ""), (3, "one"), (4, "a b c d e f g"), (5, "A b c d e f g"), (6, "word " * 3000), (None, "no id here at all"), (4, "a b c d e f g"), (7, "\t\n \x0b")]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards(spark):
    df = docs(spark, AWKWARD + [(i, f"text {i}") for i in range(10, 300)])
    got = shards.hypergeometric_shuffle(df, 7).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == df.count() and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted((r["doc_id"] or -1, r["text"] or "") for r in df.collect())
    assert shards.hypergeometric_shuffle(empty(spark), 7).count() == 0


def test_communication_matrix():
    total = np.zeros((3, 2))
    for seed in range(300):
        m = shards.communication_matrix(np.array([5, 0, 7]), np.array([4, 8]), seed)
        assert m.sum(axis=1).tolist() == [5, 0, 7] and m.sum(axis=0).tolist() == [4, 8]
        total += m
    assert np.allclose(total / 300, np.outer([5, 0, 7], [4, 8]) / 12, atol=0.2)


def brute_spans(t):
    def luhn(s):
        return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-1 0(4%é\n", max_size=60))
def test_base_spans(text):
    assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)] == brute_spans(text)


def test_contextual_pii(spark):
    seeds = [(100 + i, f"please write mail to x{i}@ex{i}.org soon thanks") for i in range(12)]
    texts = AWKWARD + seeds + [(300, "please write mail to root@localhost soon thanks"), (301, "plain root@localhost2 text"), (302, "call +1 (724) 555-7058 or 4532015112830366 at 1.2.3.4, é +1")]
    got = {r["doc_id"]: r for r in pii.find(docs(spark, texts)).collect()}
    assert got[300]["spans"] == "email:21:35" and got[301]["spans"] == "" and got[300]["n_found"] == 1 and got[300]["n_email"] == 0
    want = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_spans(texts[-1][1]))
    assert got[302]["spans"] == want and got[302]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[302]["n_card"] == 1
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, texts)).collect()}
    assert clean[300] == "please write mail to <email> soon thanks" and clean[302].startswith("call <phone> or <card> at <ip>,") and clean[1] is None and clean[2] == ""
    assert pii.find(empty(spark)).count() == 0


@pytest.mark.parametrize("broadcast", [1 << 16, 0])
def test_contextual_pii_beside_copies(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pii, "MAX_BROADCAST", broadcast)
    seeds = [(100 + i, f"please write mail to x{i}@ex{i}.org soon thanks") for i in range(12)]
    texts = seeds + [(1, "footer info@site.org " * 16000), (300, "please write mail to root@localhost soon thanks"), (301, "plain root@localhost2 text")]
    got = {r["doc_id"]: r for r in pii.find(docs(spark, texts)).collect()}
    assert got[1]["n_email"] == 16000 and got[300]["spans"] == "email:21:35" and got[301]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, texts)).collect()}
    assert clean[300] == "please write mail to <email> soon thanks"


def test_maxscore(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.3, (400, 16)).astype(np.float32)
    x[50] = x[51] = x[52]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [float("nan")] * 16), (903, [1.0] * 15 + [None]), (904, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in maxscore.top_k(df, df.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    v = np.floor(1024 * x.astype(np.float64))
    for q in range(0, 400, 100):
        s = v @ v[q]
        want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:10]
        assert got[q] == [(i, int(s[i])) for i in want]
    assert maxscore.top_k(df.limit(0), df.limit(0), 10).count() == 0
    few = [(q, i, s) for q, i, s in maxscore.score_shard(np.arange(3), v[:3], np.array([0]), v[:1], 10)]
    assert len(few) == 2


@pytest.mark.parametrize("chunk", [16, 64])
def test_maxscore_prunes_and_stays_exact(spark, monkeypatch, chunk):
    monkeypatch.setattr(maxscore, "FIRST", chunk // 2)
    monkeypatch.setattr(maxscore, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    x = np.floor(1024 * rng.normal(0, 1, (900, 24)) * np.geomspace(1, 0.01, 24)).astype(np.float64)  # few terms matter
    x[700:] = x[:200]
    for q in range(0, 900, 90):
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:10]
        assert maxscore.score_shard(np.arange(900), x, np.array([q]), x[q : q + 1], 10) == [(q, i, int(s[i])) for i in want]


def test_maxscore_rows_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 7)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 2)
    rows = [(i, [float(i % 5), 1.0], 1, "x") for i in range(20)] + [(3, [3.0, 1.0], 9, "y")] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int, block string").repartition(4)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in maxscore.top_k(df, df.where("vec_id in (0, 10, 4)"), 4, 1).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 4] == [(4, 1, 9, 17), (4, 2, 14, 17), (4, 3, 19, 17), (4, 4, 3, 13)] and len(got) == 12


def brute_links(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    links = {i: {j for j in sets if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} for i in sets}
    comp = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in comp:
                comp[j] = i
                todo += links[j]
    return {i: (len(sets[i]), comp[i], len(links[i])) for i in sets}


@pytest.mark.parametrize("block", [512, 3])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    rng = np.random.default_rng(2)
    base = [" ".join(f"w{k}" for k in rng.integers(0, 500, n)) for n in (40, 60, 90, 7, 300)]
    texts = [(1, None), (2, ""), (3, "one"), (4, "One"), (5, "a b c d e f g"), (6, "A b c d e f g")]
    for n, b in enumerate(base):
        for k in range(12):
            w = b.split()
            for p in rng.integers(0, len(w), k // 3):
                w[p] = f"x{k}"
            texts.append((100 * (n + 1) + k, " ".join(w[: len(w) - k % 4])))
    shared = " ".join(f"common{k}" for k in range(30))
    texts += [(1000 + k, shared + " " + " ".join(f"own{k}_{j}" for j in range(25))) for k in range(20)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.ngram_join(docs(spark, texts)).collect()}
    assert got == brute_links(texts)
    assert len({c for _, c, _ in got.values()}) < len(texts)


@given(st.lists(st.integers(0, 40), min_size=1, max_size=300), st.integers(1, 6))
def test_fragments_of_the_order(counts, fragments):
    counts = np.array(counts, np.uint32)
    bounds = ngram_join.fragment_bounds(counts, fragments)
    assert len(bounds) in (0, fragments - 1) and (np.diff(bounds.astype(np.float64)) >= 0).all()
    many = counts[counts > 1].astype(np.uint64)
    for k, b in enumerate(bounds.tolist()):  # whole counters before a cut weigh no more than its share, with the cut one no less
        share = (k + 1) / fragments * int(many.sum())
        assert many[many < b >> 32].sum() <= share + 1e-6 and many[many <= b >> 32].sum() >= share - 1e-6


def test_order_counts_every_shingle(spark):
    """However many shingles there are, each is counted apart, over chunks and buckets: no two rare ones pass for a common one."""
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate((rng.choice(pool, 40), pool[:5], rng.integers(0, 1 << 63, 30, dtype=np.uint64)))) for _ in range(300)]
    times = collections.Counter(h for s in sets for h in s.tolist())
    rows = [(k // 3, k, len(s), 1, s.tobytes()) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "chunk long, cid long, n long, cnt long, set binary").repartition(3, "chunk").sortWithinPartitions("chunk")
    got = ngram_join.in_order(df, sum(map(len, sets)), 80).collect()
    assert sorted(r["cid"] for r in got) == list(range(300))
    for r in got:
        s = sets[r["cid"]].tolist()
        order = sorted((ngram_join._coarse(np.array([times[h]])).item(), h) for h in s)
        shared = [x for x in order if x[0] > 1]
        assert np.frombuffer(r["set"], "<u8").tolist() == [h for _, h in shared] and np.frombuffer(r["counts"], "<u4").tolist() == [c for c, _ in shared]
        assert np.frombuffer(r["prefix"], "<u8").tolist() == [h for c, h in order[: len(s) - -(-80 * len(s) // 100) + 1] if c > 1]
        assert times[s[0]] < 256 or abs(ngram_join._coarse(np.array([times[s[0]]])).item() / times[s[0]] - 1) < 1 / 128


def test_ngram_join_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    texts = [(1, text), (1, text), (1, text + " x"), (2, text), (3, text + " y"), (3, text + " y"), (4, "other words only here now")] * 2
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_join(docs(spark, texts).repartition(5)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_ngram_join_drops_prefixes(spark, monkeypatch):
    """The widest written tables go before the join ends, and its rows can still be read."""
    gone, drop = [], Scratch.drop
    monkeypatch.setattr(Scratch, "drop", lambda self, df: (gone.append(df._scratch_path.rsplit("-", 1)[-1]), drop(self, df)))
    assert ngram_join.ngram_join(docs(spark, AWKWARD)).count() == len(AWKWARD)
    assert {"described", "sets"} <= set(gone)


def test_ngram_join_edges(spark):
    got = ngram_join.ngram_join(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert {r["doc_id"] for r in got if r["component_id"] == 4} == {4, 5}
    assert sorted(r["doc_id"] or -1 for r in ngram_join.keep_one(docs(spark, AWKWARD)).collect()) == [-1, 1, 2, 3, 4, 6, 7]
    assert ngram_join.ngram_join(empty(spark)).count() == 0


def labelled(spark):
    rng = np.random.default_rng(4)
    words = ["stone", "river", "house", "green", "water", "light", "small", "road"]
    texts, labels = [], []
    for i in range(500):
        w = list(rng.choice(words, 30))
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w[3] = str(rng.choice(["idiot", "moron", "scum"]))
        texts.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    return docs(spark, texts + [(None, None), (600, ""), (601, None)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_and_toxicity(spark):
    df, labels = labelled(spark)
    truth = {r["doc_id"]: r for r in labels.collect()}
    good = {r["doc_id"]: r for r in quality.score(df, labels).collect() if r["doc_id"] in truth}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(good) == 500 and np.mean([good[i]["predicted"] == truth[i]["quality"] for i in held]) > 0.95
    toxic = {r["doc_id"]: r for r in toxicity.score(df, labels).collect()}
    assert np.mean([toxic[i]["predicted"] == truth[i]["toxic"] for i in held]) > 0.97 and 0 <= toxic[600]["score"] < 0.5
    assert {r["score"] for r in quality.score(df, labels.limit(0)).collect()} == {0.5}
    assert quality.score(empty(spark), labels).count() == 0 and toxicity.score(empty(spark), labels).count() == 0


def ids_of(texts, end):
    tok = tokens.tokenizer(tokens.vocabulary())
    return [np.append(np.asarray(tok.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(end)).astype("<u4") for t in texts]


HARD = ["it's 'tis İ ΑΣ é ́x", "A<|endoftext|>b <|endoftext|>", "x" * 5000, "Hello, World!! ... 12345 été Été", "a\x0bb\x0cc\x85d"]


def test_tokens_are_the_library_s():
    for t, ids in zip(HARD, ids_of(HARD, 0), strict=True):
        assert tokens.encode_texts(tokens.vocabulary(), [t.encode()])[0] == ids[:-1].tobytes()


@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, dtype=np.int64))
    ef = token_store.EliasFano.encode(values)
    assert ef.select(np.arange(len(values))).tolist() == values.tolist() and all(int(ef.select(i)) == v for i, v in list(enumerate(values.tolist()))[::37])
    back, end = token_store.EliasFano.unpack(b"xx" + ef.pack() + b"y", 2, len(values))
    assert back.select(np.arange(len(values))).tolist() == values.tolist() and end == 2 + len(ef.pack())
    assert 8 * (ef.low.nbytes + ef.high.nbytes) <= len(values) * (3 + np.log2(1 + int(values[-1]) / len(values))) + 16 if steps else True


def test_token_store(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 50)
    texts = AWKWARD + [(20 + i, t) for i, t in enumerate(HARD)]
    got = token_store.store_and_read(docs(spark, texts), tokens.vocabulary(), 2).orderBy("start").collect()
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (d, _), ids in zip(got, order, ids_of([t for _, t in order], 2), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_store.store_and_read(empty(spark), tokens.vocabulary(), 2).count() == 0


def test_segment_documents():
    ids = ids_of(HARD, 2)
    named = [None, None, -(1 << 63), 8, (1 << 63) - 1]
    s = token_store.Segment(token_store.write_segment(named, [x.tobytes() for x in ids], 4))
    assert all((s.document(i) == x).all() for i, x in enumerate(ids)) and s.doc_ids(np.arange(5)).to_pylist() == named
    with pytest.raises(IndexError):
        s.ends.select(5)


def test_token_store_with_one_hot_id(spark):
    texts = [(None, f"no id {i % 40}") for i in range(300)] + [(7, "again and again")] * 300 + [(i, f"text {i}") for i in range(100)]
    df = docs(spark, texts).repartition(6)
    got = token_store.store_and_read(df, tokens.vocabulary(), 2, parts=9).orderBy("start").collect()
    at, sizes = 0, collections.Counter()
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        sizes[r["doc_id"], r["ids_crc32"]] += 1
    want = collections.Counter((d, zlib.crc32(x.tobytes())) for (d, _), x in zip(texts, ids_of([t for _, t in texts], 2), strict=True))
    assert sizes == want and [r["doc_id"] or -1 for r in got] == sorted(d or -1 for d, _ in texts)


def test_mixing(spark):
    rng = np.random.default_rng(6)
    texts = [(i, "w " * int(rng.integers(1, 60))) for i in range(3000)] + AWKWARD
    df = docs(spark, texts, lambda i: None if i is None or i % 10 == 0 else "abc"[i % 3])
    one, two = mixing.mix(df).collect(), mixing.mix(df.repartition(5)).collect()
    key = lambda rows: sorted((r["doc_id"] or -1, r["size"], r["copies"]) for r in rows)
    assert key(one) == key(two) and len(one) == len(texts)
    taken, target = collections.Counter(), {}
    for r in one:
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in one)) < 1e-6
    assert all(abs(taken[s] - t) <= 0.02 * t + 1 for s, t in target.items())
    rows = mixing.mix_rows(df).collect()
    assert len(rows) == sum(r["copies"] for r in one) and set(rows[0].asDict()) == set(df.columns)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix_rows(empty(spark)).count() == 0


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [3, 1, 2], 1.5, 2) == [20.0, 25 / 3, 50 / 3]
    assert mixing.water_fill([0, 4], [3, 1], 1.5, 2) == [0.0, 6.0] and mixing.water_fill([], [], 1.5, 2) == []


def test_flight_keeps_totals():
    rng = np.random.default_rng(7)
    size = rng.integers(1, 100, 200)
    mean = np.zeros(200)
    for _ in range(200):
        out = mixing.flight(np.full(200, 0.3), size, rng)
        assert abs(out.sum() - 60) < 1e-6 and abs((out * size).sum() - 0.3 * size.sum()) < 1e-6 and ((out > 0) & (out < 1)).sum() < 3
        mean += out / 200
    assert abs(mean - 0.3).max() < 0.17


def best_fit_decreasing(lengths, capacity):
    import bisect

    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        n += gap == capacity
        if gap > x:
            bisect.insort(gaps, gap - x)
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 1)), max_size=60), st.lists(st.integers(0, 60), max_size=5))
def test_sweeps_of_ranges_equal_one_sweep(items, cuts):
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][1], i))

    def sweep(some):
        stack, documents, pairs = [], [], []
        for i in some:
            if items[i][1] == 0:
                stack.append(i)
            elif stack:
                pairs.append((i, stack.pop()))
            else:
                documents.append(i)
        return pairs, documents, stack

    at = [0, *sorted(min(c, len(items)) for c in cuts), len(items)]
    ranges = [sweep(order[a:b]) for a, b in zip(at, at[1:], strict=False)]
    pairs = [x for p, _, _ in ranges for x in p]
    left = {(k, w): len(r[w]) for k, r in enumerate(ranges) for w in (1, 2) if r[w]}
    for part, first, n, slot_part, last in packing.settle(left):
        pairs += [(ranges[part][1][first + k], ranges[slot_part][2][last - k]) for k in range(n)]
    assert sorted(pairs) == sorted(sweep(order)[0]) and all(items[d][0] <= items[s][0] for d, s in pairs)


@pytest.mark.parametrize("shape", ["mixed", "tiny", "one length", "none", "long tail"])
def test_best_fit_is_near_the_best(spark, monkeypatch, shape):
    monkeypatch.setattr(packing, "LANDING", 40)
    rng = np.random.default_rng(12)
    lengths = {"mixed": rng.integers(1, 257, 1500), "tiny": rng.integers(1, 5, 1500), "one length": np.full(400, 90), "none": np.empty(0, int), "long tail": np.minimum(256, (20 * rng.lognormal(0, 1.5, 2000)).astype(int) + 1)}[shape]
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "rid long, length long").repartition(5)
    got = packing.best_fit(df, 256, Scratch(spark, "t")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["seq"]].append((r["offset"], int(lengths[r["rid"]])))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    best = best_fit_decreasing(lengths.tolist(), 256)
    assert sorted(r["rid"] for r in got) == list(range(len(lengths))) and len(by) <= best * 1.03 + 2


def test_packing(spark):
    texts = AWKWARD + [(20 + i, t) for i, t in enumerate(HARD)]
    got = packing.pack(docs(spark, texts), tokens.vocabulary(), 1, 64, with_ids=True).collect()
    ids = collections.defaultdict(list)
    for (d, _), x in zip(texts, ids_of([t for _, t in texts], 1), strict=True):
        ids[d].append(x.tobytes())
    by, again = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        again[r["doc_id"]].append((r["start"], bytes(r["ids"])))
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4 and r["start"] == 64 * r["piece"]
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    for d, x in ids.items():
        if len(x) == 1:
            assert b"".join(p for _, p in sorted(again[d])) == x[0]
    assert packing.pack(empty(spark), tokens.vocabulary(), 1).count() == 0


def test_image_copies(spark):
    rng = np.random.default_rng(8)
    pic = lambda: rng.integers(0, 255, (24, 24)).repeat(4, axis=0).repeat(4, axis=1).astype(np.uint8)
    base = [pic() for _ in range(12)]
    edits = [lambda a: a, lambda a: a[10:90, 20:], lambda a: (a * 0.7 + 30).astype(np.uint8), lambda a: np.rot90(a), lambda a: np.clip(a + rng.normal(0, 5, a.shape), 0, 255).astype(np.uint8)]
    rows = [(10 * i + k, *f(b).shape[::-1], bytes(np.ascontiguousarray(f(b)))) for i, b in enumerate(base) for k, f in enumerate(edits)]
    rows += [(500, 96, 96, None), (501, 5, 5, b"x" * 25), (502, 5, 5, b"x" * 25), (503, 96, 96, b"short"), (None, 96, 96, rows[0][3])]
    df = spark.createDataFrame([(a, b, c, bytearray(d) if d is not None else None) for a, b, c, d in rows], "id long, width int, height int, pixels binary").repartition(3)
    got = {r["id"]: (r["component_id"], r["n_links"]) for r in image_copies.image_copies(df).collect()}
    right = [got[10 * i + k][0] == 10 * i for i in range(12) for k in range(len(edits))]
    assert len(got) == len(rows) and np.mean(right) > 0.95
    assert got[500] == (500, 0) and got[502] == (501, 1) and got[503] == (503, 0) and got[None] == (None, 0)
    assert image_copies.image_copies(df.limit(0)).count() == 0


def brute_copies(pictures, all_pairs=False):
    both = [image_copies.describe(p[None])[0] for p in pictures]
    entries = [image_copies.entries_of(i, d) for i, (_, d) in enumerate(both)]
    both = [(c, np.unpackbits(d, axis=1).astype(np.float32) * 2 - 1) for c, d in both]
    hit = np.zeros((len(both), len(both)), bool)
    for i in range(len(both)):
        for j in range(i):
            meet = all(len(np.unique(c)) >= 2 for c in image_copies._met_corners(entries[j], entries[i]))
            hit[i, j] = hit[j, i] = (all_pairs or meet) and image_copies.are_copies(both[j], both[i])
    return hit


@pytest.mark.parametrize("thin", [1 << 18, 20])
def test_thinned_edges_connect_the_same(spark, monkeypatch, thin):
    monkeypatch.setattr(components, "THIN", thin)
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, 500) for i in range(500, 560)] + [(i, 501) for i in range(500, 560)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    scratch = Scratch(spark, "t")
    want = {tuple(r) for r in components.connected_components(edges, scratch).collect()}
    few = components.thinned(edges)
    assert {tuple(r) for r in components.connected_components(few, scratch).collect()} == {(v, c) for v, c in want if sum(w[1] == c for w in want) > 1} and few.count() < 320


def test_entries_of_any_corner_number():
    e = image_copies.entries_of(-5, np.random.default_rng(1).integers(0, 256, (30, 32)).astype(np.uint8))
    far = e.copy()
    far["corner"] += 1 << 16
    assert (image_copies._unpacked([image_copies._packed(e), image_copies._packed(far)]) == np.concatenate((e, far))).all()
    assert not len(image_copies._unpacked([])) and len(image_copies._packed(e)) < len(image_copies._packed(far))


def picture_frame(spark, rows):
    return spark.createDataFrame([(i, *p.shape[::-1], bytearray(np.ascontiguousarray(p).tobytes())) for i, p in rows], "id long, width int, height int, pixels binary")


@pytest.mark.parametrize(("wide", "block", "parts"), [(128, 96, 8), (2, 96, 3), (2, 7, 8), (10, 5, 2)])
def test_image_copies_with_shared_tiles(spark, monkeypatch, wide, block, parts):
    monkeypatch.setattr(image_copies, "WIDE", wide)
    monkeypatch.setattr(image_copies, "BLOCK", block)
    rng = np.random.default_rng(9)
    bank = rng.integers(0, 255, (40, 8, 8)).repeat(4, axis=1).repeat(4, axis=2).astype(np.uint8)
    pictures = [np.block([[bank[rng.integers(8 * (3 * y + x) % 33, 8 * (3 * y + x) % 33 + 7)] for x in range(3)] for y in range(3)]) for _ in range(60)]
    got = {r["id"]: r["n_links"] for r in image_copies.image_copies(picture_frame(spark, enumerate(pictures)).repartition(parts)).collect()}
    want = brute_copies(pictures).sum(axis=1)
    assert want.sum() > 60 and [got[i] for i in range(60)] == want.tolist()


def test_recall_of_edited_copies(spark):
    """Against comparing all pairs: more than a thousand links of pictures that share tiles and are cropped, noisy and so on."""
    rng = np.random.default_rng(13)
    base = [rng.integers(0, 255, (24, 24)).repeat(4, axis=0).repeat(4, axis=1).astype(np.uint8) for _ in range(24)]
    for p in base:  # every one has a tile of a few
        p[12:44, 12:44] = base[int(rng.integers(3))][12:44, 12:44]
    edits = [lambda a: a, lambda a: a[10:90, 20:], lambda a: a[0:80, 0:84], lambda a: (a * 0.7 + 30).astype(np.uint8), lambda a: np.rot90(a), lambda a: np.clip(a + rng.normal(0, 5, a.shape), 0, 255).astype(np.uint8), lambda a: np.clip(a + rng.normal(0, 9, a.shape), 0, 255).astype(np.uint8), lambda a: np.flip(a)]
    pictures = [np.ascontiguousarray(f(b)) for b in base for f in edits]
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in image_copies.image_copies(picture_frame(spark, enumerate(pictures)).repartition(6)).collect()}
    ours, whole = brute_copies(pictures), brute_copies(pictures, all_pairs=True)
    assert [got[i][0] for i in range(len(pictures))] == ours.sum(axis=1).tolist()
    assert whole.sum() // 2 >= 600 and ours.sum() >= 0.97 * whole.sum()
    assert np.mean([got[8 * i + k][1] == got[8 * i][1] for i in range(24) for k in range(8)]) > 0.97


def test_image_copies_whose_corners_occur_elsewhere(spark):
    rng = np.random.default_rng(11)
    patches = rng.integers(80, 120, (4, 24, 24)).astype(np.uint8)
    patches[:, 10:15, 10:15] = 255
    rows = []
    for i, some in [*((k, [k]) for k in range(4)), (10, range(4)), (11, range(4))]:
        p = rng.integers(80, 120, (24, 24)).repeat(4, axis=0).repeat(4, axis=1).astype(np.uint8)
        for k in some:
            y, x = 12 + 48 * (k // 2), 12 + 48 * (k % 2)
            p[y : y + 24, x : x + 24] = patches[k]
        rows.append((i, 96, 96, bytearray(p.tobytes())))
    df = spark.createDataFrame(rows, "id long, width int, height int, pixels binary").repartition(3)
    got = {r["id"]: (r["component_id"], r["n_links"]) for r in image_copies.image_copies(df).collect()}
    assert got == {**{k: (k, 0) for k in range(4)}, 10: (10, 1), 11: (10, 1)}


def test_small_crops_of_large_images(spark, monkeypatch):
    rng = np.random.default_rng(10)
    large = [rng.integers(0, 255, (96, 96)).repeat(4, axis=0).repeat(4, axis=1).astype(np.uint8) for _ in range(6)]
    crops = [p[y : y + 110, x : x + 120] for p, (y, x) in zip(large, rng.integers(0, 260, (6, 2)).tolist(), strict=True)]
    rows = [(i, *p.shape[::-1], bytearray(p.tobytes())) for i, p in enumerate(large + crops)]
    df = spark.createDataFrame(rows, "id long, width int, height int, pixels binary").repartition(3)
    got = {r["id"]: r["component_id"] for r in image_copies.image_copies(df).collect()}
    assert [got[i] for i in range(12)] == [*range(6), *range(6)]
    want = brute_copies(large + crops)
    monkeypatch.setattr(image_copies, "PRODUCT", 5000)
    assert (brute_copies(large + crops) == want).all() and want[:6, 6:].diagonal().all()
    twice = spark.createDataFrame([(i % 3, *r[1:], "x") for i, r in enumerate(rows)], "id long, width int, height int, pixels binary, cid string")
    assert sorted({(r["id"], r["component_id"]) for r in image_copies.image_copies(twice).collect()}) == [(0, 0), (1, 1), (2, 2)]


def test_pipeline_with_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    good, labels = labelled(spark)
    rows = [(i, t, "en", s, len(t or ""), "z") for i, t, s in ((None, None, None), (None, "river stone house green water", "b"), (7001, "", "b"), (7002, None, "c"), (7003, "river " * 20000, None), (7004, "é" * 9000, "a"))]
    odd = spark.createDataFrame(rows + rows[1:3], "doc_id long, text string, lang string, source string, n_chars long, rid string")
    df = good.drop("score", "shard").withColumn("rid", quality.F.lit("z")).unionByName(odd)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r["length"] <= 4096 for r in got) and {r["doc_id"] for r in got} <= {r["doc_id"] for r in df.collect()}
    again = sorted((r["doc_id"] or -1, r["piece"], r["ids_crc32"]) for r in got)
    assert again == sorted((r["doc_id"] or -1, r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    df, labels = labelled(spark)
    df = df.drop("score", "shard")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    step = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == df.columns
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 100 and got.select("sequence_id").distinct().count() >= 1
