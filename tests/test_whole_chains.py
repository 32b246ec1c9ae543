"""Iterations end when nothing is left to do, or say that they did not."""

import pytest

from helixframe.operators import sets, tree


def test_ancestors_beyond_max_depth(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "c long, p long")
    got = {tuple(x) for x in tree.ancestors(edges, "c", "p", 4).collect()}
    assert got == {(i, j, j - i) for i in range(21) for j in range(i + 1, 21)}
    with pytest.raises(ValueError, match="cycle"):
        tree.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "c long, p long"), "c", "p", 4)


def test_unfinished_components_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError, match="still change"):
        sets.components(edges, "u", "v", max_rounds=1)
