"""Published or hand-checked values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import dist, sequence
from helixframe.operators import alignment, counts, genotype, intervals, joins, models, pruning, sets, stats, tree


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], names)
    return df.select(column(*[F.col(n) for n in names]).alias("x")).first().x


def is_subsequence(small, large):
    rest = iter(large)
    return all(c in rest for c in small)


def test_tails():
    assert dist.chi2_sf(0.8309481891464107, 1) == pytest.approx(0.36199849347509305, abs=1e-12)
    for args, want in (((40, 10, 10, 3), 0.4850554844813657), ((40, 8, 10, 8), 5.85139904025353e-7), ((40, 8, 20, 1), 0.9983619983619983), ((40, 8, 20, 4), 0.6526176526176533)):
        assert dist.hypergeom_sf(*args)[0] == pytest.approx(want, rel=1e-9)
    p = np.array([1e-12, 0.001, 0.3, 0.5, 0.9, 0.999999])
    assert dist.norm_cdf(dist.norm_ppf(p)) == pytest.approx(p, rel=1e-9)
    assert dist.t_sf(2.228138852, 10) == pytest.approx(0.025, abs=1e-9)
    assert dist.f_sf(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.poisson_sf(3, 2.0) == pytest.approx(1 - math.exp(-2) * (1 + 2 + 2), abs=1e-12)
    assert dist.beta_i(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)
    assert dist.hwe_exact(57, 78, 50) == pytest.approx(0.0389, abs=5e-3)


def test_blom(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (4.0,), (5.0,)], "v double")
    got = stats.blom_argument(df, "v").withColumn("z", dist.normal_quantile(F.col("blom_p"))).where("blom_p is not null").orderBy("v").collect()
    assert [r.z for r in got] == pytest.approx([-1.0491313979639705, -0.29930691046566704, 0.29930691046566704, 1.0491313979639705], abs=1e-9)


def test_contingency_and_ranks(spark):
    x1, x2 = {0: True, 1: True, 2: True, 3: False}, {0: False, 1: False, 2: False, 3: True, 4: True, 5: True}
    df = spark.createDataFrame([(x1.get(k), x2.get(k)) for k in range(6)], "x boolean, y boolean")
    assert tuple(stats.two_by_two(df, F.col("x"), F.col("y")).first())[:4] == (0, 1, 3, 0)
    for left, right, rank_sum in (([1, 2, 3], [3, 5, 6], 6.5), ([2, 2, 2], [1, 2], 10.5)):
        d = spark.createDataFrame([(float(v), True) for v in left] + [(float(v), False) for v in right], "v double, l boolean")
        assert stats.mann_whitney(d, "v", F.col("l")).first().rank_sum == rank_sum
    for left, right, u in (([4, 5, 6], [1, 2, 3], 9), ([1, 3, 5], [2, 4, 6], 3), ([1, 1], [1, 1], 2)):
        d = spark.createDataFrame([(float(v), True) for v in left] + [(float(v), False) for v in right], "v double, l boolean")
        assert stats.mann_whitney(d, "v", F.col("l")).first().u == u
    d = spark.createDataFrame([(5, 138, 1469)], "a long, b long, c long")
    assert stats.hwe_chisq(d, "a", "b", "c").first().hwe_chisq == pytest.approx(0.8309481891464107, abs=1e-9)


def test_ols_two_groups(spark):
    control = [4.17, 5.58, 5.18, 6.11, 4.50, 4.61, 5.17, 4.53, 5.33, 5.14]
    treated = [4.81, 4.17, 4.41, 3.59, 5.87, 3.83, 6.03, 4.89, 4.32, 4.69]
    df = spark.createDataFrame([(y, 0.0) for y in control] + [(y, 1.0) for y in treated], "y double, x double")
    r = models.ols_simple(df, [], "y", "x").first()
    assert (r.slope, r.slope_se, r.intercept, r.intercept_se, r.r2) == pytest.approx((-0.3710, 0.3114, 5.032, 0.2202, 0.07308), abs=1e-4)
    m = {x.term: x for x in models.ols(df, [], "y", ["x"]).collect()}
    assert m["x"].beta == pytest.approx(r.slope) and m["x"].se == pytest.approx(r.slope_se) and m["x"].loglik == pytest.approx(-20.08824, abs=1e-4)
    twice = models.ols(df.withColumn("z", F.col("x") * 2), [], "y", ["x", "z"], drop_collinear=True)
    assert {x.term: x.beta for x in twice.collect()}["z"] is None


def test_iterative_models():
    r = np.random.default_rng(0)
    x = np.column_stack([np.ones(4000), r.normal(size=4000)])
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.5 + 1.2 * x[:, 1])))).astype(float)
    b, se, ll = models.irls(x, y, np.ones(4000), "logistic")
    assert b == pytest.approx([0.5, 1.2], abs=0.15)
    p = r.poisson(np.exp(0.3 + 0.4 * x[:, 1])).astype(float)
    assert models.irls(x, p, np.ones(4000), "poisson")[0] == pytest.approx([0.3, 0.4], abs=0.06)
    z = r.normal(size=(200, 5))
    t = z @ np.array([2, 0, 0, -1, 0.0]) + r.normal(0, 0.1, 200)
    assert models.proximal_gradient(z, t, "l2", 0.1) == pytest.approx(np.linalg.solve(z.T @ z / 200 + 0.1 * np.eye(5), z.T @ t / 200), abs=1e-6)
    lasso = models.proximal_gradient(z, t, "l1", 0.3)
    assert np.count_nonzero(lasso) == 2
    assert models.proximal_gradient(z, t, "scad", 0.3)[[0, 3]] == pytest.approx([2, -1], abs=0.1)
    c = np.concatenate([r.poisson(3, 600), r.poisson(20, 400)])
    values, weights = np.unique(c, return_counts=True)
    mean, share, _ = models.poisson_mixture(values.astype(float), weights.astype(float), 2)
    assert mean == pytest.approx([3, 20], abs=1) and share == pytest.approx([0.6, 0.4], abs=0.05)
    k = r.normal(size=(150, 400))
    k = k @ k.T / 400
    g = np.linalg.cholesky(k + 1e-9 * np.eye(150)) @ r.normal(size=150) * 2
    vg, ve, _ = models.reml(g + r.normal(size=150), np.ones((150, 1)), k)
    assert 1.5 < vg < 8 and ve > 0
    assert models.likelihood_ratio(-10, -8, 0.99995)[0] == 4
    label, centres, _ = models.kmeans(np.concatenate([r.normal(0, 1, (50, 2)), r.normal(9, 1, (50, 2))]), 2)
    assert len(set(label[:50])) == len(set(label[50:])) == 1


def test_grm(spark):
    d = [(m, i, v) for m, row in enumerate(([2, 1, 0], [0, 1, 2], [1, 1, 2])) for i, v in enumerate(row)]
    got = {(r.i, r.j): r.value for r in genotype.gram(spark.createDataFrame(d, "m int, i int, v int"), "m", "i", "v").collect()}
    x = np.array([[2, 1, 0], [0, 1, 2], [1, 1, 2]], float)
    p = x.mean(axis=1) / 2
    z = (x - 2 * p[:, None]) / np.sqrt(2 * p * (1 - p))[:, None]
    assert got == pytest.approx({(i, j): float((z.T @ z / 3)[i, j]) for i in range(3) for j in range(i + 1)})


def test_pruning():
    r = np.random.default_rng(1)
    a = r.integers(0, 3, 50).astype(float)
    rows = [a, a.copy(), r.integers(0, 3, 50).astype(float), a.copy()]
    assert pruning.prune_window(np.array([1, 2, 3, 4]), rows, 0.9, 1000) == [0, 2]
    assert pruning.prune_window(np.array([1, 2000, 3000, 9000]), rows, 0.9, 10) == [0, 1, 2, 3]
    assert pruning.greedy_by_rank(["a", "b", "c"], {("a", "b"): 0.9}, 0.9) == ["a", "c"]


def test_merges(spark):
    m = lambda d: spark.createDataFrame(list(d.items()), "k long, v long")
    got = {r.k: r.v for r in joins.merge_full_outer([m({1: 1, 2: 5}), m({1: 3})], "k", "v").collect()}
    assert got == {1: 4, 2: 5}


def test_sequences(spark):
    assert one(spark, sequence.reverse_complement, s="ACGTTn"[:5]) == "AACGT"
    assert one(spark, sequence.translate, s="ATGGCCTAAXYZ---GG") == "MA*X-"
    for ref, alt, want in (("CTCC", "CCC", (1001, "CT", "C")), ("CTCC", "C", (1001, "CTCC", "C")), ("CTCC", "CCCC", (1002, "T", "C")), ("CTCC", "<X>", (1001, "CTCC", "<X>"))):
        assert tuple(one(spark, sequence.minimal_representation, p=1001, r=ref, a=alt)) == want
    common = one(spark, lambda a, b: alignment.lcs_subsequence(a, b), a="AACCTTGG", b="ACACTGTGA")
    assert len(common) == len("AACTTG") and all(is_subsequence(common, s) for s in ("AACCTTGG", "ACACTGTGA"))
    got = one(spark, lambda a, b: alignment.align(a, b, "global", None, 2, 1, 1, -1), a="ACGTT", b="ACTT")
    assert got.score == 2.0 and got.a.replace("-", "") == "ACGTT" and got.b.replace("-", "") == "ACTT"
    assert one(spark, lambda a, b: alignment.align(a, b, "local"), a="GGGACGTCCC", b="TTACGTAA").score == 4.0
    assert one(spark, lambda a, b: alignment.align(a, b, "fitting"), a="GGGACGTCCC", b="ACGT").score == 4.0
    assert one(spark, lambda a, b: alignment.align(a, b, "overlap"), a="GGGACGT", b="ACGTCC").score == 4.0
    assert one(spark, sequence.chromosome_number, c="chrX") == 23 and one(spark, sequence.cigar_length, c="5M2I10N3D1S") == 18


def test_read_counting(spark):
    f = spark.createDataFrame([("g1", "1", 10, 20, "+"), ("g2", "1", 30, 40, "+"), ("g3", "1", 40, 50, "+"), ("g4", "1", 45, 55, "-")], "gene string, chr string, start long, end long, strand string")
    r = spark.createDataFrame([("a", "1", 5, 15, "+", 60, 1)], "name string, chr string, start long, end long, strand string, mapq int, nh int")
    assert {x.gene: x.n for x in counts.count_reads(r, f, 16).collect() if x.n} == {"g1": 1}
    assert {x.gene: x.n for x in counts.count_reads(r, f, 16, min_quality=100).collect() if x.n} == {"__too_low_aQual": 1}
    assert counts.count_reads(r.limit(0), f, 16).count() == 0
    low = spark.createDataFrame([("b", "1", 44, 48, "+", 60, 1), ("c", "1", 44, 48, "+", 60, 2), ("d", "2", 0, 5, "+", 60, 1)], r.schema)
    assert {x.gene: x.n for x in counts.count_reads(low, f, 16).collect() if x.n} == {"__ambiguous": 1, "__alignment_not_unique": 1, "__no_feature": 1}
    assert {x.gene: x.n for x in counts.count_reads(low, f, 16, stranded="yes").collect() if x.n}["g3"] == 1


def test_tree():
    t = tree.parse_newick("((a:1,b:2)90:1,(c:1,(d:1,e:1)100:2)80:1);")
    assert sorted(t.leaves()) == list("abcde") and tree.leaf_distance(t, "a", "d") == 6.0
    assert tree.bipartitions(t) == {frozenset("cde"), frozenset("de")}
    assert tree.bipartitions(t, 0.95) == {frozenset("de")}
    assert sorted(tree.lca(t, "d", "c").leaves()) == ["c", "d", "e"]
    assert tree.parse_newick(t.newick() + ";").newick() == t.newick()


def test_intervals_against_points(spark):
    r = random.Random(3)
    make = lambda n: [(c, s, s + r.randint(0, 9)) for c in "xy" for s in (r.randint(0, 80) for _ in range(n))]
    a, b = make(12), make(12)
    cover = lambda rows: {(c, p) for c, s, e in rows for p in range(s, e)}
    df = lambda rows: spark.createDataFrame(rows, "chr string, start long, end long")
    points = lambda d: cover([tuple(x) for x in d.select("chr", "start", "end").collect()])
    assert points(intervals.subtract(df(a), df(b), "chr")) == cover(a) - cover(b)
    assert points(intervals.intersect(df(a), df(b), "chr")) == cover(a) & cover(b)
    assert points(intervals.union(df(a), df(b), "chr")) == cover(a) | cover(b)
    pairs = intervals.overlap_join(df(a), df(b), "chr", 7).count()
    assert pairs == sum(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2] for x in a for y in b)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (5, 5)], "u long, v long")
    assert {r.node: r.root for r in sets.components(e, "u", "v").collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
