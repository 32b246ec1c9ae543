"""Trees from text, nested models and one-by-one drops against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import dist
from helixframe.operators import models, pruning, tree


def test_newick_edges_and_splits(spark):
    texts = [("t1", "((a:1,b:2)0.9:3,(c,(d,e)0.5:1)0.8,f);"), ("t2", "(x,y)top;"), ("t3", None), ("t4", ""), ("t1", "(p,q);")]
    df = spark.createDataFrame(texts, "k string, s string")
    got = {(x.child, x.parent, x.length, x.support, x.leaf) for x in tree.newick_edges(df.where("s LIKE '%c,%'"), "k", "s").collect()}
    assert {x[0] for x in got if x[4]} == set("abcdef") and ("a", [x[1] for x in got if x[0] == "a"][0], 1.0, None, True) in got
    assert {x[3] for x in got if not x[4]} == {0.9, 0.8, 0.5} and len(got) == 9
    assert {x.child for x in tree.newick_edges(df.where("k = 't2'"), "k", "s").collect()} == {"x", "y"}
    sides = {(x.k, tuple(x.side)): x.support for x in tree.newick_splits(df, "k", "s").collect()}
    assert sides == {("t1", ("c", "d", "e", "f")): 0.9, ("t1", ("c", "d", "e")): 0.8, ("t1", ("d", "e")): 0.5}
    assert {tuple(x.side) for x in tree.newick_splits(df, "k", "s", 0.7).collect()} == {("c", "d", "e", "f"), ("c", "d", "e")}


def test_nested_models(spark):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(80, 2)), r.normal(size=80)
    df = spark.createDataFrame([(i % 2 if i % 2 else None, float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(80)], "g int, a double, b double, y double")
    got = {t.g: t for t in models.nested_models(models.ols(df, ["g"], "y", []), models.ols(df, ["g"], "y", ["a", "b"]), ["g"], 1, 3).collect()}
    for g in (None, 1):
        on = np.arange(80) % 2 == (1 if g else 0)
        rss = lambda d: ((y[on] - d @ np.linalg.lstsq(d, y[on], rcond=None)[0]) ** 2).sum()  # noqa: E731, B023
        stat = 40 * np.log(rss(np.ones((40, 1))) / rss(np.column_stack([np.ones(40), x[on]])))
        assert np.isclose(got[g].statistic, stat) and np.isclose(got[g].p, float(dist.chi2_sf(stat, 2)))
        assert np.isclose(got[g].bic_small - got[g].bic_large, stat - 2 * np.log(40))


@pytest.mark.parametrize("seed", range(3))
def test_drops_one_by_one(spark, seed):
    r = np.random.default_rng(seed)
    n = 14
    v = {(i, j): float(r.normal()) for i in range(n) for j in range(i)}
    alive = set(range(n))
    while True:
        bad = {i: sum(v[max(i, j), min(i, j)] < -0.8 for j in alive if j != i) for i in alive}
        if not max(bad.values()):
            break
        alive.remove(max(bad, key=lambda i: (bad[i], i)))
    df = spark.createDataFrame([(i, j, x) for (i, j), x in v.items()] + [(i, i, 1.0) for i in range(n)], "i int, j int, v double")
    assert {x.name for x in pruning.drop_related(df, "i", "j", "v", -0.8).collect()} == alive
    assert pruning.drop_related(df.where(F.lit(False)), "i", "j", "v", 0.0).count() == 0
