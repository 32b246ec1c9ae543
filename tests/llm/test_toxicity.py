import random

import numpy as np

from helixframe.llm import toxicity


def corpus(n, seed):
    r = random.Random(seed)
    plain, bad = [f"word{i}" for i in range(200)], ["slurone", "slurtwo"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 60))]
        toxic = r.random() < 0.3
        if toxic:
            words[r.randrange(len(words))] = r.choice(bad) + r.choice(["", "s", "ing"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic or r.random() < 0.5), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1500, 1)
    held, truth = corpus(400, 2)
    schema = "doc_id long, quality int, toxic int"
    chain = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (5, None, 0), (99999, 1, 1)], schema))
    p = chain.predict([t for _, t in held])[:, 1]
    assert ((p >= 0.3) == np.array([bool(x[2]) for x in truth])).mean() > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "slurone " * 30000), (3, "slurtwo word1")] * 2, "doc_id long, text string").selectExpr("*", "'a' as toxicity", "1 as _id")
    got = toxicity.score(odd, chain)
    assert got.columns == odd.columns
    rows = got.collect()
    assert len(rows) == 8 and all(0 <= x <= 1 for r in rows for x in r.toxicity)
    assert toxicity.score(odd.limit(0), chain).count() == 0
    none = toxicity.train(odd.select("doc_id", "text"), spark.createDataFrame([], schema))
    assert none.predict(["x", None]).tolist() == [[0.5, 0.5]] * 2


def test_later_models_use_earlier_probabilities():
    r = np.random.default_rng(0)
    x = (r.random((600, 5)) < 0.5).astype(float)
    first = (x[:, 0] + x[:, 1] + r.normal(0, 0.2, 600) > 1).astype(float)
    chain = toxicity.fit_chain(x, np.stack([first, first], axis=1), np.arange(600) % 5, {str(i): i for i in range(5)}, ("a", "b"))
    assert len(chain.weights[0]) == 6 and len(chain.weights[1]) == 7 and chain.weights[1][5] > 0.1


def plain_logistic(rows, ys, ridge):
    """Weights, the last one the bias, by coordinate-wise Newton steps over lists until nothing moves."""
    w = [0.0] * (len(rows[0]) + 1)
    rows = [[*map(float, r), 1.0] for r in rows]
    for _ in range(4000):
        moved = 0.0
        for k in range(len(w)):
            g = h = 0.0
            for r, y in zip(rows, ys):
                p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, r))))
                g += (p - y) * r[k]
                h += p * (1 - p) * r[k] * r[k]
            pen = 1e-6 if k == len(w) - 1 else ridge * len(rows)
            step = (g + pen * w[k]) / (h + pen + 1e-9)
            w[k] -= step
            moved = max(moved, abs(step))
        if moved < 1e-7:
            break
    return w


def test_chain_against_plain_loop():
    r = np.random.default_rng(5)
    x = (r.random((48, 4)) < 0.5).astype(int)
    y = np.stack([(x[:, 0] + r.random(48) > 0.9), (x[:, 1] + x[:, 0] + r.random(48) > 1.2)], axis=1).astype(float)
    folds, chosen = np.arange(48) % 3, {0: [0, 1, 3], 1: [0, 1, 2], 2: [1, 2, 3]}
    chain = toxicity.fit_chain(x, y, folds, {"a": 0, "b": 1, "c": 2}, ("p", "q"), chosen)
    earlier = [[] for _ in range(48)]
    for j in range(2):
        want = plain_logistic([[*x[i, [0, 1, 2]], *earlier[i]] for i in range(48)], y[:, j], toxicity.RIDGE)
        assert np.allclose(chain.weights[j], want, atol=1e-3)
        outside = [0.0] * 48
        for f in range(3):
            rest = [i for i in range(48) if i % 3 != f]
            w = plain_logistic([[*x[i, chosen[f]], *earlier[i]] for i in rest], [y[i, j] for i in rest], toxicity.RIDGE)
            for i in range(f, 48, 3):
                outside[i] = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(w, [*x[i, chosen[f]], *earlier[i]])) + w[-1])))
        right = {t: np.mean([np.mean([p >= t for p, v in zip(outside, y[:, j]) if v]), np.mean([p < t for p, v in zip(outside, y[:, j]) if not v])]) for t in [*outside, 2.0]}
        got = chain.thresholds[j]
        told = np.mean([np.mean([p >= got for p, v in zip(outside, y[:, j]) if v]), np.mean([p < got for p, v in zip(outside, y[:, j]) if not v])])
        assert told >= max(right.values()) - 1e-9
        for i in range(48):
            p = min(max(outside[i], 1e-4), 1 - 1e-4)
            earlier[i].append(np.log(p / (1 - p)))


def test_threshold():
    assert toxicity.best_threshold(np.array([0.1, 0.2]), np.array([0.0, 0.0])) == 0.5
    assert toxicity.best_threshold(np.array([0.3, 0.3]), np.array([0.0, 1.0])) == 0.5
    assert 0.2 < toxicity.best_threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1.0])) < 0.8


def test_query(spark):
    from helixframe.llm.q_toxicity import op5_toxicity

    got = op5_toxicity(spark, "/root/testdata/sf0.01")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("p_quality", "double"), ("p_toxic", "double"), ("toxic", "boolean")]
    found = {r.doc_id: r for r in got.collect()}
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r.doc_id in found]
    assert len(found) == 1000 and np.mean([found[r.doc_id].toxic == bool(r.toxic) for r in labels]) > 0.97
