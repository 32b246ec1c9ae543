"""LogDet, shared branches, linkage, k-means, mixed sets, essentials mixtures and unwanted variation against plain numpy and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import dist
from helixframe.operators import counts, distances, essentials, genotype, mixedsets, models


def test_logdet(spark):
    r = random.Random(3)
    base = "".join(r.choice("ACGT") for _ in range(400))
    other = "".join(r.choice("ACGT") if r.random() < 0.2 else c for c in base)
    rows = [(base, other + "AC"), (base, base.lower()), ("AAAA", "AAAA"), ("", "ACGT"), (None, "A"), ("ACGT-N" * 30, "ACGT" * 50)]
    got = spark.createDataFrame(rows, "x string, y string").select(distances.divergence("x", "y").alias("c")).select("c", distances.logdet(F.col("c")).alias("d")).collect()
    for (x, y), g in zip(rows, got):
        m = np.zeros((4, 4))
        for p, q in zip((x or "").upper(), (y or "").upper()):
            if p in "ACGT" and q in "ACGT":
                m["ACGT".index(p), "ACGT".index(q)] += 1
        assert g.c == m.astype(int).ravel().tolist()
        f = m / max(m.sum(), 1)
        det = np.linalg.det(f)
        fine = m.sum() and min(f.sum(axis=0).min(), f.sum(axis=1).min()) > 0 and det > 1e-18
        want = -0.25 * (math.log(det) - 0.5 * (np.log(f.sum(axis=0)).sum() + np.log(f.sum(axis=1)).sum())) if fine else 0.0
        assert g.d == pytest.approx(want, abs=1e-9)


def test_shared_branches_of_a_known_tree(spark):
    # ((a, b), c) with an outgroup o; leaves 10 from the root of a, b, c, which is 5 from o's side
    shared = {("a", "b"): 6.0, ("a", "c"): 0.0, ("b", "c"): 0.0}
    rows = [(x, y, 20 - 2 * s) for (x, y), s in shared.items()] + [("o", x, 25.0) for x in "abc"] + [("o", "a", 25.0)]
    got = {(x.a, x.b): x.covariance for x in distances.shared_branches(spark.createDataFrame(rows, "p string, q string, d double"), "p", "q", "d", "o").collect()}
    assert got == {**{k: pytest.approx(v) for k, v in shared.items()}, **{(b, a): pytest.approx(v) for (a, b), v in shared.items()}, **{(x, x): pytest.approx(10.0) for x in "abc"}}


@pytest.mark.parametrize("seed", [1, 2])
def test_average_linkage_is_one_merge_at_a_time(spark, seed):
    r = np.random.default_rng(seed)
    n = 24
    points = r.normal(size=(n, 2))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    rows = [(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n)]
    got = distances.average_linkage(spark.createDataFrame(rows, "p int, q int, d double"), "p", "q", "d")
    groups, want = {i: [i] for i in range(n)}, []
    while len(groups) > 1:
        mean = lambda x, y: d[np.ix_(groups[x], groups[y])].mean()  # noqa: E731, B023
        h, x, y = min((mean(x, y), x, y) for x, y in itertools.combinations(sorted(groups), 2))
        groups[x] += groups.pop(y)
        want.append((x, y, h, len(groups[x])))
    seen = sorted((x.left, x.right, x.height, x.size) for x in got.collect())
    assert [x[:2] + x[3:] for x in seen] == [x[:2] + x[3:] for x in sorted(want)]
    assert np.allclose([x[2] for x in seen], [x[2] for x in sorted(want)])
    height = sorted(x[2] for x in want)[15]
    labels = {x.p: x.cluster for x in distances.cut(got, spark.createDataFrame([(i,) for i in range(n)], "p int"), "p", height).collect()}
    assert len(set(labels.values())) == n - 16 and all(v <= k for k, v in labels.items())
    assert distances.average_linkage(spark.createDataFrame([], "p int, q int, d double"), "p", "q", "d").count() == 0


def test_kmeans_finds_the_blobs(spark):
    r = np.random.default_rng(5)
    centre = [(0, 0), (10, 0), (0, 10)]
    rows = [(i, *map(float, r.normal(centre[i % 3], 0.5))) for i in range(150)] + [(999, None, 1.0)]
    labelled, table = distances.kmeans_by_bic(spark.createDataFrame(rows, "k int, x double, y double"), "k", ["x", "y"], 1, 5)
    assert [x.k for x in table.where("chosen").collect()] == [3]
    got = {x.k: x.cluster for x in labelled.collect()}
    assert len(got) == 150 and len({(k % 3, c) for k, c in got.items()}) == 3


@pytest.mark.parametrize("seed", range(3))
def test_mixed_sets_against_all_pairs_of_sides(spark, seed):
    r = random.Random(seed)
    edges, patterns, truth = [], [], {}
    for t in range(25):
        kids, leaves, names = {}, [], itertools.count()
        stack = ["root"]
        kids["root"] = []
        for _ in range(r.randint(2, 6)):
            p = r.choice(stack)
            n = f"n{next(names)}"
            kids.setdefault(p, []).append(n)
            kids[n] = []
            stack.append(n)
        for p in list(stack):  # leaves where nothing is, and some more
            for _ in range(r.randint(0, 2) + (0 if kids[p] else r.choice([1, 2]))):
                leaf = f"l{next(names)}"
                kids[p].append(leaf)
                leaves.append(leaf)
        pattern = {x: r.choice(["A", "A", "A", "B", None]) for x in leaves}
        below = lambda n: {n} if n not in kids else set().union(*map(below, kids[n]))  # noqa: E731, B023
        every, found = frozenset(leaves), set()
        for p, cs in kids.items():
            for c in cs:
                edges.append((t, c, p))
                side = frozenset(below(c))
                if side != every:
                    found.add(frozenset((side, every - side)))
        patterns += [(t, x, p) for x, p in pattern.items()]
        mixed = lambda s: len({pattern[x] for x in s} - {None}) > 1  # noqa: E731, B023
        truth[t] = any(mixed(a) and mixed(b) and not a & b for p, q in itertools.combinations(found, 2) for a in p for b in q)
    got = mixedsets.mixed_set_proofs(spark.createDataFrame(edges, "t int, c string, p string"), spark.createDataFrame(patterns, "t int, leaf string, pattern string"), "t", "c", "p", "leaf", "pattern")
    assert {x.tree for x in got.collect()} == {t for t, v in truth.items() if v} and 0 < sum(truth.values()) < 25


def test_essentials(spark):
    genes = spark.range(4000).select(F.col("id").alias("gene"), (F.col("id") % 7 + 2.0).alias("expected"))
    made = essentials.simulate(genes, "gene", "expected", 0.35, 0.1, 0.8, seed=3)
    rows = made.collect()
    assert 0.32 < np.mean([x.insufficient for x in rows]) < 0.38
    free = [x.simulated / x.expected for x in rows if not x.insufficient]
    assert abs(np.mean(free) - 1.1) < 0.03 and abs(np.mean([x.simulated / x.expected for x in rows if x.insufficient]) - 0.22) < 0.02
    hist = essentials.histogram(made, "simulated", "expected")
    fit = essentials.parameters(essentials.em(hist))
    one = fit.first()
    assert abs(one.phi - 0.35) < 0.05 and abs(one.false_rate - 0.1) < 0.06 and abs(one.penetrance - 0.8) < 0.06
    best = essentials.log_likelihood(hist, fit).first().loglik
    o, e = np.array([x.simulated for x in rows], float), np.array([x.expected for x in rows])
    lf = np.array([math.lgamma(v + 1) for v in o])
    ll = lambda p, a, b: np.logaddexp(math.log(p) + o * np.log(e * a) - e * a, math.log(1 - p) + o * np.log(e * b) - e * b).sum() - lf.sum()
    assert best == pytest.approx(ll(one.phi, one.low, one.high))
    assert all(ll(one.phi + dp, one.low + dl, one.high + dh) <= best + 1e-6 for dp, dl, dh in ((0.01, 0, 0), (-0.01, 0, 0), (0, 0.01, 0), (0, -0.01, 0), (0, 0, 0.01), (0, 0, -0.01)))
    curve = essentials.cdf_fit(hist).first()
    assert abs(curve.phi - 0.35) < 0.06 and abs(curve.high - 1.1) < 0.08 and curve.error < 1e-3
    post = essentials.posteriors(made, fit, "simulated", "expected").select("insufficient", "p_insufficient").collect()
    assert np.mean([x.insufficient == (x.p_insufficient > 0.5) for x in post]) > 0.85
    seen = essentials.truncated_genes(hist, fit, [1.0]).first()
    assert abs(seen.insufficient + seen.sufficient - (o > 0).sum()) < 60
    bands = {x.parameter: x for x in essentials.estimate(made.limit(800), "gene", "simulated", "expected", 4).collect()}
    assert set(bands) == {"phi", "false_rate", "penetrance"} and all(x.low <= x.high for x in bands.values())
    assert essentials.em(essentials.histogram(made.limit(0), "simulated", "expected")).count() == 0


def test_poisson_draw_is_the_inverse_distribution(spark):
    rows = [(u / 97, m) for u in range(97) for m in (0.0, 0.3, 4.0, 60.0)]
    for x in spark.createDataFrame(rows, "u double, m double").withColumn("d", essentials.poisson_draw(F.col("u"), F.col("m"))).collect():
        below = lambda k: 1 - float(dist.poisson_sf(k + 1, x.m)) if x.m else 1.0  # noqa: E731, B023
        assert below(x.d) >= x.u - 1e-12 and (x.d == 0 or below(x.d - 1) < x.u + 1e-12)


def test_unwanted_variation(spark):
    r = np.random.default_rng(2)
    batch = np.array([-1, -1, -1, 1, 1, 1]) * 0.5
    mean = r.uniform(3, 5, 40)
    n = r.poisson(np.exp(mean[:, None] + batch[None]))
    rows = [(g, f"s{s}", int(n[g, s])) for g in range(40) for s in range(6)]
    df = spark.createDataFrame(rows, "g int, s string, n int")
    controls = spark.createDataFrame([(g,) for g in range(15)], "g int")
    axes = {x.s: x.score for x in counts.batch_axes(df, "g", "s", "n", controls, 1).collect()}
    z = np.log1p(n[:15]) - np.log1p(n[:15]).mean(axis=1, keepdims=True)
    u, sv, vt = np.linalg.svd(z, full_matrices=False)
    want = vt[0] * sv[0] * np.sign(vt[0][np.abs(vt[0]).argmax()])
    assert np.allclose([axes[f"s{s}"] for s in range(6)], want, atol=1e-6)
    left = {}
    for x in counts.without_unwanted(df, "g", "s", "n", controls, 1).collect():
        left.setdefault(x.g, {})[x.s] = x.residual
    assert len(left) == 40
    for g in range(40):
        b, _, _ = models.irls(np.column_stack([np.ones(6), want]), n[g].astype(float), np.ones(6), "poisson")
        res = n[g] - np.exp(b[0] + b[1] * want)
        assert np.allclose([left[g][f"s{s}"] for s in range(6)], res - min(0, res.min()), atol=1e-3)


def test_generalised_models_by_groups(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 2))
    g = r.integers(0, 3, 600)
    y = (r.random(600) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1])))).astype(float)
    rows = [(None if g[i] == 2 else int(g[i]), float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(600)] + [(7, 1.0, 1.0, 1.0), (7, 1.0, 1.0, 0.0), (0, None, 1.0, 1.0)]
    got = {(t.g, t.term): t for t in models.glm(spark.createDataFrame(rows, "g int, a double, b double, y double"), ["g"], "y", ["a", "b"]).collect()}
    for k in range(3):
        on = g == k
        b, se, ll = models.irls(np.column_stack([np.ones(on.sum()), x[on]]), y[on], np.ones(on.sum()), "logistic")
        for i, t in enumerate(("intercept", "a", "b")):
            row = got[None if k == 2 else k, t]
            assert np.isclose(row.beta, b[i], atol=1e-6) and np.isclose(row.se, se[i], atol=1e-6) and row.n == on.sum() and np.isclose(row.loglik, ll)
            assert np.isclose(row.p, 2 * float(dist.norm_sf(abs(row.z))))
    assert got[7, "a"].beta is None and got[7, "a"].n == 2


def test_resampled_gram(spark):
    gram = spark.createDataFrame([(0, 0, 5, 1.0), (1, 0, 4, 0.2), (1, 1, 5, 1.1), (2, 0, 3, -0.1)], "i int, j int, n int, value double")
    replica = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 2, 0), (2, 0, 2), (2, 1, 0)], "rep int, k int, who int")
    got = {(x.rep, x.i, x.j): x.value for x in genotype.resampled_gram(gram, replica, "k", "who").collect()}
    assert got == {(1, 0, 0): 1.1, (1, 1, 0): 1.1, (1, 1, 1): 1.1, (1, 2, 0): 0.2, (1, 2, 1): 0.2, (1, 2, 2): 1.0, (2, 1, 0): -0.1, (2, 1, 1): 1.0}
