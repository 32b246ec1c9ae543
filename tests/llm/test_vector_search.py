import numpy as np

from helixframe.llm import vector_search


def brute(rows, k):
    x = [(i, np.array(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = {}
    for q, a in x:
        if q % 5 == 0:
            pad = lambda b: np.pad(b, (0, 8 - len(b)))
            found = sorted((-int(pad(a) @ pad(b)), i) for i, b in x if i != q)[:k]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return {q: v for q, v in out.items() if v}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "SHARD_ROWS", 150)
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vector_search, "LEAF_ROWS", 8)
    r = np.random.default_rng(0)
    rows = [(i, [float(c) for c in r.integers(-5, 6, 8)]) for i in range(700)]
    rows += [(700 + i, [1.0] * 8) for i in range(100)] + [(1001, [2.0] * 8)] * 7 + [(1002, [9.0, 9.0])]
    rows += [(None, [1.0] * 8), (1003, None), (1004, []), (1005, [1.0, None]), (1005, [float("nan")] * 8), (1005, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id as rank", "1 as score")
    got = {}
    for row in vector_search.top_k(df, df.where("vec_id % 5 = 0"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, int(row.score)))
    assert got == brute(rows, 10)
    assert vector_search.top_k(df.limit(0), df, k=10).count() == 0
    assert vector_search.top_k(df, df.limit(0), k=10).count() == 0


def test_descent_prunes():
    """Of clusters far apart a query opens few leaves, and the answer is the brute one."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(64, 8)) + 40 * c for c in r.normal(size=(32, 8))])
    tree = vector_search.ball_tree(x, 64)
    x, ids = x[tree["order"]], tree["order"]
    opened, best = [], vector_search._best

    def counted(*args):
        opened.append(len(args[0]))
        return best(*args)

    vector_search._best = counted
    try:
        q = x[:20] * 1.5
        top = (np.full((20, 5), -np.inf), np.full((20, 5), np.iinfo(np.int64).max))
        score, found = vector_search.search(tree, x, ids, q, np.full(20, -1), np.full(20, -np.inf), top, 5)
    finally:
        vector_search._best = best
    want = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :5]
    assert np.allclose(score, np.take_along_axis(q @ x.T, want, 1))
    assert sum(opened) < 20 * tree["leaf"].sum() / 4


def test_an_id_with_several_vectors(spark):
    rows = [(5, [2.0, 0.0])] + [(5, [1.0, 0.0])] * 3 + [(6, [1.0, 0.0]), (7, [1.5, 0.0]), (10, [1.0, 0.0])] + [(8, [0.5, 0.0])] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (3, 6, 12, 60):
        got = vector_search.top_k(df, df.where("vec_id = 10"), k=k).orderBy("rank").collect()
        want = sorted([(-v[0], i) for i, v in rows if i != 10])[:k]
        assert [(-x.score, x.vec_id) for x in got] == want
