"""Covariate scans, parallel pruning, components and permutations against plain numpy and sequential rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import covariates, genotype, models, pruning, stats


def _people(n=60, markers=9, seed=3):
    r = np.random.default_rng(seed)
    x = r.integers(0, 3, (markers, n)).astype(float)
    x[8] = 1.0
    z = np.stack([r.normal(size=n), r.integers(0, 2, n).astype(float)], axis=1)
    y = np.stack([r.normal(size=n) + x[0] + z[:, 0], r.normal(size=n) - z[:, 1]], axis=1)
    known = r.random((markers, n)) > 0.2
    return x, z, y, known


def test_covariate_scan_is_least_squares_on_imputed_dosages(spark):
    x, z, y, known = _people()
    m, n = x.shape
    df = spark.createDataFrame([(a, i, float(x[a, i]) if (a + i) % 5 else None) for a in range(m) for i in range(n) if known[a, i]], "m int, i int, d double")
    people = spark.createDataFrame([(i, float(y[i, 0]), float(y[i, 1]) if i % 6 else None, float(z[i, 0]), float(z[i, 1]) if i != 7 else None) for i in range(n)], "i int, y0 double, y1 double, c0 double, c1 double")
    got = {(r.phenotype, r.m): r for r in covariates.covariate_scan(df, people, "m", "i", "d", ["y0", "y1"], ["c0", "c1"]).collect()}
    assert len(got) == 2 * m
    for k, p in enumerate(("y0", "y1")):
        use = [i for i in range(n) if i != 7 and (k == 0 or i % 6)]
        for a in range(m):
            calls = [i for i in use if known[a, i] and (a + i) % 5]
            mean = np.mean(x[a, calls])
            column = np.array([x[a, i] if i in set(calls) else mean for i in use])
            design = np.column_stack([np.ones(len(use)), z[use], column])
            row = got[p, a]
            assert row.n == len(use) and row.calls == len(calls)
            if a == 8:
                assert row.beta is None and row.se is None
                continue
            b, *_ = np.linalg.lstsq(design, y[use, k], rcond=None)
            rss = ((y[use, k] - design @ b) ** 2).sum()
            se = np.sqrt(np.linalg.inv(design.T @ design)[-1, -1] * rss / (len(use) - 2))
            assert np.isclose(row.beta, b[-1]) and np.isclose(row.se, se) and np.isclose(row.t, b[-1] / se)
            assert np.isclose(row.r2, 1 - rss / ((y[use, k] - y[use, k].mean()) ** 2).sum()) and 0 <= row.p <= 1
    with pytest.raises(ValueError, match="collinear"):
        covariates.covariate_scan(df, people.withColumn("c2", F.col("c0") * 2), "m", "i", "d", ["y0"], ["c0", "c2"])


def sequential(sites, r2, threshold, distance, keep=()):
    """The rule, marker by marker."""
    kept = []
    for c, p, m in sorted(sites):
        if m in keep or all(not (c == kc and p - kp <= distance and r2.get((km, m), 0) > threshold) for kc, kp, km in kept):
            kept.append((c, p, m))
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_pruning_equals_the_sequential_rule(spark, seed):
    r = np.random.default_rng(seed)
    n, sites, rows = 30, [], []
    chain = None
    for m in range(160):
        fresh = r.integers(0, 3, n).astype(float)
        swap = r.random(n) < (0.15 if m % 40 else 1.0)  # long runs of markers that hang on each other
        chain = fresh if chain is None else np.where(swap, fresh, chain)
        place = (m // 90, int(m % 90 * 10 + r.integers(0, 3)), m)
        sites.append(place)
        rows += [(*place, i, None if r.random() < 0.05 else float(chain[i])) for i in range(n)]
    rows.append((0, 5000, 999, 0, 1.0))
    sites.append((0, 5000, 999))
    df = spark.createDataFrame(rows, "chr int, pos int, m int, i int, d double")
    r2 = {(x.a, x.b): x.r2 or 0 for x in genotype.pairwise_r2(df, "m", "i", "d").collect()}
    r2 |= {(b, a): v for (a, b), v in r2.items()}
    got = pruning.prune_correlated(df, "chr", "pos", "m", "i", "d", 0.2, 80).collect()
    want = sequential(sites, r2, 0.2, 80)
    assert sorted(tuple(x) for x in got) == want and 20 < len(want) < 120
    keep = spark.createDataFrame([(3,), (7,), (50,)], "m int")
    got = pruning.prune_correlated(df, "chr", "pos", "m", "i", "d", 0.2, 80, keep=keep).collect()
    assert sorted(tuple(x) for x in got) == sequential(sites, r2, 0.2, 80, {3, 7, 50})
    other = df.where("m = 20").select((F.col("m") * 0 - 1).alias("m"), "i", "d")
    got = pruning.prune_correlated(df, "chr", "pos", "m", "i", "d", 0.2, 80, against=other).collect()
    gone = {m for *_, m in sites if m == 20 or r2.get((20, m), 0) > 0.2}
    assert sorted(tuple(x) for x in got) == sequential([s for s in sites if s[2] not in gone], r2, 0.2, 80)


def test_rounds_reach_over_ranges(spark):
    """One chain through all ranges: every second marker stays."""
    edges = spark.createDataFrame([(i, i + 1, 0, i + 1) for i in range(400)], "a int, b int, c int, p int")
    got = {x.marker: x.kept for x in pruning.settle_in_order(edges, ["c", "p"]).collect()}
    assert got == {i: i % 2 == 0 for i in range(401)}


def test_components_against_eigenvectors(spark):
    r = np.random.default_rng(5)
    n = 70
    base = r.normal(size=(n, 3)) * [6, 4, 3]
    a = base @ base.T + np.cov(r.normal(size=(n, 200)))
    rows = [(i, j, float(a[i, j])) for i in range(n) for j in range(i + 1)]
    scores, values = models.gram_components(spark.createDataFrame(rows, "i int, j int, value double"), 3)
    want, vectors = np.linalg.eigh(a)
    assert np.allclose(values, want[::-1][:3])
    got = np.zeros((n, 3))
    for x in scores.collect():
        got[x.i, x.component] = x.score
    for c in range(3):
        v = vectors[:, -1 - c] * np.sqrt(want[-1 - c])
        v = v * np.sign(v[np.abs(v).argmax()])
        assert np.allclose(got[:, c], v, atol=1e-6)


def test_permutation_p(spark):
    r = np.random.default_rng(9)
    rows = [(g, i, float(r.normal() + 10), bool(r.random() < 0.2) if g else i % 50 < 8) for g in (0, 1, None) for i in range(50)]
    rows += [(7, i, 1.0, True) for i in range(4)]
    df = spark.createDataFrame(rows, "g int, i long, w double, m boolean").withColumn("w", F.when(F.col("g") == 0, 100 - F.col("i")).otherwise(F.col("w")))
    got = {x.g: x for x in stats.gsea_permutations(df, ["g"], "i", "w", F.col("m"), 25, seed=4).collect()}
    plain = {x.g: x.es for x in stats.gsea(df, ["g"], "i", "w", F.col("m")).collect()}
    assert set(got) == {0, 1, None}
    data = [tuple(x) for x in df.collect()]
    big = 2147483647

    def score(group, members):
        hits, total, miss = sum(abs(w) for _, i, w, _ in group if i in members), 0.0, 0
        line = []
        for _, i, w, _ in sorted(group, key=lambda x: (-x[2], x[1])):
            total += abs(w) / hits if i in members else 0
            miss += i not in members
            line.append(total - miss / (len(group) - len(members)))
        return max(line) if max(line) >= -min(line) - 1e-9 else min(line)

    for g, x in got.items():
        group = [t for t in data if t[0] == g]
        k = sum(t[3] for t in group)
        drawn = []
        for rep in range(1, 26):
            h = {t[1]: (t[1] % big * 48271 + rep * 69621 + 4) % big for t in group}
            u = sorted(group, key=lambda t: ((h[t[1]] ** 2 % big * 16807 + h[t[1]]) % big, t[1]))
            drawn.append(score(group, {t[1] for t in u[:k]}))
        tail = [s for s in drawn if (s > 0) == (x.es > 0)]
        assert np.isclose(x.es, plain[g]) and x.permuted == len(tail)
        assert x.beyond == sum(s > x.es + 1e-9 if x.es > 0 else s < x.es - 1e-9 for s in tail)
    assert got[0].es > 0.9 and got[0].p == 0
