import random

import numpy as np
import pytest

from helixframe.llm import near_dup as N
from helixframe.llm.components import components


def brute(rows, percent=85):
    sets = [N.shingle_set(t) for _, t in rows]
    lead = list(range(len(rows)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                lead[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 5000)}"
    rows = []
    for _ in range(30):
        base = [word() for _ in range(r.choice([3, 5, 8, 60, 300]))]
        for _ in range(r.randint(1, 12)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy).replace("w1", "W1") if r.random() < 0.3 else " \n".join(copy))
    # a chain: neighbours are linked, ends are not
    long = [f"c{i}" for i in range(400)]
    rows += [" ".join(long[k : k + 250]) for k in range(0, 100, 15)]
    rows += [None, "", "  \t", "A b", "a  B", "é É"]
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [512, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = corpus(block)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as n", "3 as bands")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(df).collect())
    assert got == sorted(brute(rows))


def test_nulls_and_repeats(spark):
    t = " ".join(map(str, range(50)))
    rows = [(5, t), (5, t), (3, t), (None, t), (None, "alone here"), (9, None), (9, "")]
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([(5, 46, 3, False), (5, 46, 3, False), (3, 46, 3, True), (-1, 46, 3, False), (-1, 1, -1, True), (9, 0, 9, True), (9, 0, 9, True)])
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_agreement():
    r = np.random.default_rng(1)
    for n in (1, 3, 20, 400, 5000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(0.9 * n))], r.integers(0, 2**63, n // 10).astype(np.uint64)]))
        s = N.sketches([a, b, np.zeros(0, np.uint64)])
        jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - jaccard) < 5 * (0.25 / N.SIZE) ** 0.5
        assert (N.sketches([a])[0] == s[0]).all()


def test_components(spark):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)] + [(7, 7), (1, 0)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    lead = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if u != v and lead[u] != lead[v]:
                lead[u] = lead[v] = min(lead[u], lead[v])
                changed = True
    assert got == lead
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
