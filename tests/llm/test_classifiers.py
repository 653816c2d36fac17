"""Quality and toxicity against plain versions: word vectors, pooling, network, linear models, chain, edge cases."""

import numpy as np

from vectorloom.llm import quality, toxicity

TEXTS = ["a b c a", "B b!! 12 c", "", None, "one", "x " * 20000, "Zürich ÄÖ " + "y" * 5000]


def test_word_vectors_and_pooling(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    at, sign = quality._sparse_index(5, quality.VOCABULARY)
    of_word = np.zeros((quality.VOCABULARY, quality.DIMENSIONS))
    for i in range(quality.VOCABULARY):
        for k in range(quality.NONZERO):
            of_word[i, at[i, k]] += sign[i, k]
    of_shape = quality.index_vectors(7, quality.SHAPES)
    total = np.zeros((quality.VOCABULARY + quality.SHAPES, quality.DIMENSIONS))
    for t in TEXTS:
        w, s = quality.entries_of(t.encode() if t else None)
        for i in range(len(w)):
            for j in (i - 1, i + 1):
                if 0 <= j < len(w):
                    total[w[i]] += of_word[w[j]]
                    total[s[i]] += of_shape[s[j] - quality.VOCABULARY]
    mean = total.sum(axis=0) / np.abs(total).sum()
    want = total / np.maximum(1e-9, np.linalg.norm(total, axis=1, keepdims=True)) - mean
    own = quality.index_vectors(6, len(want))
    want = want + 0.5 * own / np.linalg.norm(own, axis=1, keepdims=True).clip(1e-9)
    got = quality.word_vectors(df)
    assert np.abs(got - want).max() < 1e-4
    for t in TEXTS:
        w, s = quality.entries_of(t.encode() if t else None)
        p = quality.pool(t.encode() if t else None, got)
        if not len(w):
            assert not p.any()
            continue
        plain = np.concatenate([f(got[ids].astype(np.float64), axis=0) for ids in (w, s) for f in (np.mean, np.std)])
        assert np.abs(p[:-3] - plain).max() < 2e-3 and abs(p[-3] - np.log1p(len(w)) / 10) < 1e-6


def test_network(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 6))
    y = ((x[:, 0] + 0.5 * x[:, 1] > 0.2) ^ (rng.random(2000) < 0.1)).astype(float)
    net = quality.train(x, y)
    p = net.probability(x)
    assert ((p > 0.5) == y).mean() > 0.85
    h = np.tanh((x - net.mean) * net.scale @ net.w1 + net.b1)
    assert np.allclose(p, 1 / (1 + np.exp(-(h @ net.w2 + net.b2) / net.temperature)))
    for low, high in ((0.05, 0.2), (0.8, 0.95)):  # calibrated
        some = (p > low) & (p < high)
        assert some.sum() < 30 or abs(y[some].mean() - p[some].mean()) < 0.12


def test_linear_model_is_at_the_optimum():
    rng = np.random.default_rng(2)
    x = (rng.random((400, 5)) < 0.3).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 0, 1] - 0.5)))).astype(float)
    w = toxicity.fit_linear(x, y)
    p = toxicity.apply_linear(w, x)
    assert np.abs(x.T @ (p - y) + 0.1 * w[:-1]).max() < 1e-4 and abs((p - y).sum()) < 1e-3


def test_chain_is_trained_out_of_fold():
    rng = np.random.default_rng(3)
    x = (rng.random((300, 8)) < 0.4).astype(float)
    first = (x[:, 0] + rng.random(300) > 0.9).astype(float)
    second = np.where(rng.random(300) < 0.1, np.nan, (first + x[:, 1] > 1).astype(float))
    got = toxicity.train_chain(x, np.stack((first, second, np.full(300, np.nan), np.ones(300)), axis=1), [])
    fold = np.random.Generator(np.random.PCG64(9)).permutation(300) % toxicity.FOLDS
    p = np.array([toxicity.apply_linear(toxicity.fit_linear(x[fold != f], first[fold != f]), x[i : i + 1])[0] for i, f in enumerate(fold)])
    full = np.hstack((x, p[:, None]))
    known = ~np.isnan(second)
    assert np.allclose(got.weights[0], toxicity.fit_linear(x, first)) and np.allclose(got.weights[1], toxicity.fit_linear(full[known], second[known]))
    assert got.weights[2:] == [0.0, 1.0]
    p0 = toxicity.apply_linear(got.weights[0], x)
    p1 = toxicity.apply_linear(got.weights[1], np.hstack((x, p0[:, None])))
    assert np.allclose(got.probabilities(x), np.stack((p0, p1, np.zeros(300), np.ones(300)), axis=1))


def test_awkward_labels_and_rows(spark):
    rows = [(i, f"plain text number {i} of the river" + (" you idiot scum" if i % 5 == 0 else "")) for i in range(300)]
    rows += [(1, rows[1][1])] * 3 + [(None, None), (None, "null id"), (400, ""), (401, "w " * 20000), (402, "q" * 30000)]
    df = spark.createDataFrame([(d, t, 0.5, 3) for d, t in rows], "doc_id long, text string, score double, p_toxic int").repartition(4)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(300)] + [(7, 0, 1), (7, 1, 0), (9, None, 0), (None, 1, 1), (9999, 1, 1), (11, 5, 7)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(df, frame).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "p_quality", "p_toxic", "score", "predicted"}
    by = {}
    for r in got:
        by.setdefault(r["text"], set()).add((r["score"], r["predicted"]))
    assert all(len(v) == 1 for v in by.values()) and sum(r["predicted"] == int("idiot" in (r["text"] or "")) for r in got) >= len(got) - 3
    one = toxicity.score(df, frame.where("toxic = 0")).agg({"score": "max"}).first()[0]
    assert one == 0.0 and toxicity.score(df, frame.limit(0)).agg({"score": "max"}).first()[0] == 0.0
    assert {r["score"] for r in quality.score(df, frame.where("quality = 1")).collect()} == {1.0}
    assert quality.score(df, frame).count() == len(rows)
