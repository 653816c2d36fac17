"""The shuffle's law: the matrix against all permutations, large urns, slots, clashing columns."""

import collections
import itertools

import numpy as np

from vectorloom.llm import shards


def test_matrix_has_the_law_of_all_permutations():
    cells, sizes = [2, 1, 3], [3, 3]
    rows = [c for c, n in enumerate(cells) for _ in range(n)]
    truth = collections.Counter()
    for p in itertools.permutations(range(6)):  # place p[i] of row i; the first three places are shard 0
        m = np.zeros((3, 2), int)
        for r, at in zip(rows, p, strict=True):
            m[r, int(at >= 3)] += 1
        truth[m.tobytes()] += 1
    for limit in (10**9, 0):  # numpy's sampler, and inversion
        shards.LARGE = limit
        got = collections.Counter(shards.communication_matrix(np.array(cells), np.array(sizes), s).astype(int).tobytes() for s in range(4000))
        shards.LARGE = 10**9
        assert set(got) == set(truth)
        assert sum((got[m] - 4000 * n / 720) ** 2 / (4000 * n / 720) for m, n in truth.items()) < 3 * len(truth) + 12


def test_inversion_in_large_urns():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**11, 7 * 10**11, 10**6
    x = np.array([shards.invert(rng, good, bad, n) for _ in range(3000)])
    assert abs(x.mean() - 3e5) < 40 and abs(x.std() / np.sqrt(n * 0.21) - 1) < 0.06
    a, b = np.array([shards.invert(rng, 300, 500, 100) for _ in range(20000)]), rng.hypergeometric(300, 500, 100, 20000)
    assert np.abs(np.bincount(a, minlength=101) - np.bincount(b, minlength=101)).max() < 5 * np.sqrt(2 * 20000 * 0.1)
    cells, sizes = np.array([4 * 10**9, 1, 6 * 10**9]), np.array([5 * 10**9, 5 * 10**9 + 1])
    m = shards.communication_matrix(cells, sizes, 3)
    assert m.sum(axis=1).tolist() == cells.tolist() and m.sum(axis=0).tolist() == sizes.tolist()
    assert [shards.invert(rng, 5, 2, 7), shards.invert(rng, 0, 9, 4), shards.invert(rng, 9, 0, 4)] == [5, 0, 4]


def test_permutations():
    for n in (1, 2, 3, 17, 256, 257, 5000):
        for key in (0, 9 << 32):
            assert sorted(shards.permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))
    last = collections.Counter(tuple(shards.permuted(np.arange(3), np.full(3, 3), np.full(3, k)).tolist()) for k in range(6000))
    assert len(last) == 6 and max(last.values()) < 1200 and min(last.values()) > 800


def test_hot_ids_and_clashing_columns(spark):
    rows = [(5, "same", i % 3, "x", 1) for i in range(300)] + [(None, None, 9, "y", 2)] * 50 + [(i, f"t{i}", 1, None, None) for i in range(251)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, row_at string, dealt_to int").repartition(6)
    got = shards.hypergeometric_shuffle(df, 4).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert sorted(map(len, by.values())) == [150, 150, 150, 151] and all(sorted(s) == list(range(len(s))) for s in by.values())
    key = lambda r: (r["doc_id"] or -1, r["text"] or "", r["row_at"] or "", r["dealt_to"] or 0)
    assert sorted(map(key, got)) == sorted(map(key, df.collect()))
    of_five = collections.Counter(r["shard"] for r in got if r["text"] == "same")
    assert min(of_five.values()) > 45  # 75 expected of each shard
