"""Global and burden tests, tails of weighted chi-squares and penalised paths against matrices in numpy."""

import numpy as np
import pytest

from helixframe.functions import dist, numeric
from helixframe.operators import models, penalised, regionsets


def test_tails():
    for df in (1, 2, 7):
        for q in (0.2, 3.0, 25.0):
            want = float(dist.chi2_sf(q, df))
            assert numeric.imhof_tail(2 * q, [2.0] * df) == pytest.approx(want, abs=1e-9)
            assert numeric.saddlepoint_tail(q, [1.0] * df) == pytest.approx(want, rel=0.12)
    # an F ratio as a difference of chi-squares
    for n, r2 in ((30, 0.2), (80, 0.4)):
        weights = [1 - r2] + [-r2] * (n - 2)
        assert numeric.weighted_chi_square_tail(0.0, weights) == pytest.approx(float(dist.f_sf((n - 2) * r2 / (1 - r2), 1, n - 2)), rel=0.2)
        assert numeric.imhof_tail(0.0, weights) == pytest.approx(float(dist.f_sf((n - 2) * r2 / (1 - r2), 1, n - 2)), abs=1e-9)
    far = numeric.weighted_chi_square_tail(120.0, [1.0, 0.5, 0.1])
    assert 0 < far < 1e-20
    assert numeric.imhof_tail(-1.0, []) == 1.0 and numeric.imhof_tail(1.0, [0.0]) == 0.0


def _data(seed=4, n=50, markers=7):
    r = np.random.default_rng(seed)
    x = r.integers(0, 3, (markers, n)).astype(float)
    z = np.column_stack([r.normal(size=n), r.integers(0, 2, n)])
    y = r.normal(size=n) + 0.8 * x[1] + z[:, 0]
    known = r.random((markers, n)) > 0.15
    return x, z, y, known


@pytest.mark.parametrize("weight", ["flat", "rare"])
def test_global_and_burden_tests(spark, weight):
    x, z, y, known = _data()
    m, n = x.shape
    df = spark.createDataFrame([(1, 10 * a, a, i, float(x[a, i])) for a in range(m) for i in range(n) if known[a, i]], "chr int, pos int, m int, i int, d double")
    people = spark.createDataFrame([(i, float(y[i]) if i != 5 else None, float(z[i, 0]), float(z[i, 1])) for i in range(n)], "i int, y double, c0 double, c1 double")
    regions = spark.createDataFrame([(1, 0, 25, "a"), (1, 20, 45, "a"), (1, 50, 55, "one"), (1, 15, 65, "b"), (2, 0, 99, "none")], "chr int, start long, end long, region string")
    members = regionsets.set_members(df, regions, "chr", "pos", "region", "m", "d", weight)
    got = {(r.set, r.test): r for r in regionsets.region_set_pvalues(df, people, members, "m", "i", "d", ["y"], ["c0", "c1"]).collect()}
    whole = {r.set: r for r in regionsets.global_test(df, people, members, "m", "i", "d", ["y"], ["c0", "c1"]).collect()}
    use = [i for i in range(n) if i != 5]
    design = np.column_stack([np.ones(len(use)), z[use]])
    left = np.eye(len(use)) - design @ np.linalg.inv(design.T @ design) @ design.T
    yy = y[use]
    for name, inside in {"a": [0, 1, 2, 3, 4], "one": [5], "b": [2, 3, 4, 5, 6]}.items():
        columns, burden = [], np.zeros(len(use))
        for a in inside:
            f = x[a, known[a]].mean() / 2
            p = min(f, 1 - f)
            w = {"flat": 1.0, "rare": (25 * (1 - p) ** 24) ** 2}[weight]
            mean = x[a, [i for i in use if known[a, i]]].mean()
            columns.append(np.sqrt(w) * np.array([x[a, i] - mean if known[a, i] else 0.0 for i in use]))
            burden += w * np.array([x[a, i] - x[a, known[a]].mean() if known[a, i] else 0.0 for i in use])
        c = np.array(columns).T
        s = ((c.T @ left @ yy) ** 2).sum() / (yy @ left @ yy)
        values = np.linalg.eigvalsh(left @ c @ c.T @ left - s * left)
        row = got[name, "global"]
        assert row.n == len(use) and whole[name].n_markers == len(inside) and np.isclose(row.statistic, s)
        assert np.isclose(whole[name].scaled, s / np.trace(c @ c.T @ left))
        assert row.p == pytest.approx(numeric.weighted_chi_square_tail(0.0, values[np.abs(values) > 1e-9 * np.abs(values).max()]), abs=1e-7)
        b, *_ = np.linalg.lstsq(np.column_stack([design, burden]), yy, rcond=None)
        assert np.isclose(got[name, "burden"].statistic, b[-1])
        if name == "one":  # one marker: the test of its slope with n - 4 degrees of freedom
            r2 = s / np.trace(c.T @ left @ c)
            assert row.p == pytest.approx(float(dist.f_sf((len(use) - 4) * r2 / (1 - r2), 1, len(use) - 4)), abs=1e-8)
    assert ("none", "global") not in got


def test_set_without_variation_has_no_p():
    assert all(np.isnan(regionsets.global_p(np.zeros((2, 2)), np.zeros(2), 3.0, 10, 1)))


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 5)) * [1, 2, 0.5, 1, 3] + [0, 5, 1, 0, -2]
    y = 3 + 2 * x[:, 0] - 0.7 * x[:, 1] + 0.3 * x[:, 4] + r.normal(size=300)
    rows = [(i, *map(float, x[i]), 1.0, float(y[i])) for i in range(300)] + [(400, None, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0), (None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, d double, e double, same double, y double"), x, y


@pytest.mark.parametrize("penalty", penalised.PENALTIES)
def test_path_and_errors_from_rows(table, penalty):
    df, x, y = table
    lams = [0.8, 0.3, 0.1, 0.02]
    got = {}
    for r in penalised.cross_validated_path(df, "k", "y", ["a", "b", "c", "d", "e", "same"], penalty, lams, k=4).collect():
        got.setdefault(r["lambda"], {})[r.term] = r
    folds = np.floor((np.arange(300) * 1103515245 + 12345) % 2147483648 / 2147483648 * 4).astype(int)

    def fitted(on):
        """Along the path by proximal gradient on the rows themselves."""
        sd, mean = x[on].std(axis=0), x[on].mean(axis=0)
        s = (x[on] - mean) / sd
        out = []
        for lam in lams:
            b = models.proximal_gradient(s, y[on] - y[on].mean(), penalty, lam)
            out.append((b / sd, y[on].mean() - (b / sd) @ mean))
        return out

    every = fitted(np.ones(300, bool))
    error = np.zeros(4)
    for f in range(4):
        error += [((y[folds == f] - x[folds == f] @ b - c) ** 2).sum() for b, c in fitted(folds != f)]
    for i, lam in enumerate(lams):
        terms = got[lam]
        assert np.allclose([terms[t].beta for t in "abcde"], every[i][0], atol=2e-4) and terms["same"].beta == 0
        assert np.isclose(terms["intercept"].beta, every[i][1], atol=2e-3)
        assert np.isclose(terms["a"].cv_error, error[i] / 300, rtol=1e-3)
    assert [lam for lam in lams if got[lam]["a"].chosen] == [lams[int(error.argmin())]]


def test_unpenalised_and_nested(table):
    df, x, y = table
    rows = {r.term: r.beta for r in penalised.cross_validated_path(df, "k", "y", ["a", "b", "c", "d", "e"], "l1", [1e6], unpenalised=["a"]).collect()}
    assert rows["b"] == rows["e"] == 0 and np.isclose(rows["a"], np.cov(x[:, 0], y)[0, 1] / np.var(x[:, 0], ddof=1))
    nested = penalised.nested_cross_validation(df, "k", "y", ["a", "b", "c", "d", "e"], "l1").collect()
    assert len(nested) == 5 and sum(r.n for r in nested) == 300 and all(0.5 < r.mse < 2 and r.r2 > 0.6 for r in nested)
    with pytest.raises(ValueError, match="two folds"):
        penalised.cross_validated_path(df.limit(0), "k", "y", ["a"])
    with pytest.raises(ValueError, match="penalty"):
        penalised.cross_validated_path(df, "k", "y", ["a"], "l7")


def test_products_of_entries_by_either_way():
    r = np.random.default_rng(6)
    for n, m, share in ((5, 40, 0.1), (6, 30, 0.9), (1, 1, 1.0), (40, 50, 0.02)):
        x = np.where(r.random((n, m)) < share, r.normal(size=(n, m)), 0.0)
        marker, individual = np.nonzero(x)
        order = r.permutation(len(marker))
        for most in (3, 1 << 20):
            kernel = np.zeros((n, n))
            regionsets.add_products(kernel, marker[order], individual[order], x[marker, individual][order], most)
            assert np.allclose(kernel, x @ x.T)
