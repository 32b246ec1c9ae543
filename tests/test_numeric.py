import math

import numpy as np
import pytest

from helixframe.functions import numeric as N


def test_quadrature():
    for rule in (N.trapezoid, N.simpson, N.boole, N.gauss_legendre, N.adaptive_simpson):
        assert rule(math.sin, 0.0, math.pi) == pytest.approx(2, abs=1e-5)


def test_search():
    assert N.bisect(lambda x: x * x - 2, 0, 2) == pytest.approx(math.sqrt(2))
    assert N.newton(lambda x: x * x - 2, lambda x: 2 * x, 1.0) == pytest.approx(math.sqrt(2))
    assert N.golden_section(lambda x: (x - 1.5) ** 2, 0, 9) == pytest.approx(1.5, abs=1e-6)
    assert N.minimise(lambda v: (v[0] - 1) ** 2 + 10 * (v[1] + 2) ** 2, np.zeros(2)) == pytest.approx([1, -2], abs=1e-3)
    with pytest.raises(ValueError):
        N.bisect(lambda x: 1.0, 0, 1)


def test_transforms():
    assert N.logistic(N.logit(0.3)) == pytest.approx(0.3)
    assert N.logsumexp([1000, 1000]) == pytest.approx(1000 + math.log(2))
    shape, scale = N.gamma_parameters(np.random.default_rng(0).gamma(3, 2, 20000))
    assert (shape, scale) == pytest.approx((3, 2), rel=0.05)
    assert N.liu_tail(3.841458821, [1.0]) == pytest.approx(0.05, abs=1e-6)
    draws = np.random.default_rng(1).chisquare(1, (200000, 3)) @ np.array([3, 1, 0.5])
    assert N.liu_tail(12, [3, 1, 0.5]) == pytest.approx((draws > 12).mean(), abs=0.005)
