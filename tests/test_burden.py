"""Burdens where alleles are of equal share: the order of rows, and with it the rounding of sums of doubles, has no say."""

import itertools
import math

import pytest

from helixframe.operators import frames

#: Their sum is 5, as their number; doubles give a little more in some orders, a little less in others.
EVEN = (0.07, 1.67, 1.39, 0.03, 1.84)


def test_equal_shares_in_any_order(spark):
    above = next(p for p in itertools.permutations(EVEN) if sum_of(p) > len(p))
    below = next(p for p in itertools.permutations(EVEN) if sum_of(p) <= len(p))
    for order in (above, below):
        df = spark.createDataFrame([(EVEN.index(v), "m", v) for v in order], "ind int, marker string, dosage double").coalesce(1)
        got = {x.ind: x.burden for x in frames.burden(df, "ind", "marker", "dosage").collect()}
        assert got == dict(enumerate(EVEN))


def sum_of(values):
    total = 0.0
    for v in values:
        total += v
    return total


def test_minor_alleles_and_dosages_that_are_no_decimals(spark):
    rows = [(1, "a", 1.5), (2, "a", 1.0), (1, "b", 0.5), (2, "b", 0.25), (1, "c", None), (2, "c", None), (1, "d", 2.0), (2, "d", None), (3, "e", math.nan), (4, "e", 0.5), (5, "f", math.inf), (6, "f", 0.5)]
    df = spark.createDataFrame(rows, "ind int, marker string, dosage double")
    got = {x.ind: x.burden for x in frames.burden(df, "ind", "marker", "dosage").collect()}
    assert math.isnan(got.pop(3)) and got == {1: pytest.approx(0.5 + 0.5 + 0.0), 2: pytest.approx(1.0 + 0.25), 4: 1.5, 5: -math.inf, 6: 1.5}
