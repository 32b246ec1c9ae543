"""Ranks, running aggregates and percentiles where values crowd, against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from helixframe.operators import intervals, joins, multitest, ranges, stats


def test_bh_near_zero(spark):
    """All but one p-value in one spot of the axis."""
    r = np.random.default_rng(2)
    p = [float(x) for x in 10.0 ** -r.uniform(8, 300, 3000)] + [0.9, 0.9, 0.0]
    got = {x.i: x.p_adj for x in multitest.bh_adjust(spark.createDataFrame(list(enumerate(p)), "i long, p double"), "p").collect()}
    order, low = np.argsort(p, kind="stable"), 1.0
    for k in range(len(p) - 1, -1, -1):
        ties = [j for j in range(len(p)) if p[order[j]] == p[order[k]]] if p[order[k]] in (0.9,) else [k]
        low = min(low, p[order[k]] * len(p) / (max(ties) + 1))
        assert np.isclose(got[int(order[k])], low, rtol=1e-12)


def test_percentiles_and_ranks_with_an_outlier(spark):
    r = np.random.default_rng(3)
    x = [*map(float, r.normal(size=2001)), 1e300, -1e300, 0.5, 0.5, 0.5]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(x)] + [(None, 3.0)], "g int, v double")
    for row in ranges.percentiles(df, ["g"], "v", {"a": 0.025, "b": 0.5, "c": 1.0}).collect():
        own = [3.0] if row.g is None else x[row.g :: 2]
        assert np.allclose([row.a, row.b, row.c], np.percentile(own, [2.5, 50, 100]))
    used = {t for (t,) in ranges.dealt(df, ["v"]).select(ranges.RANGE).distinct().collect()}
    assert len(used) > 8
    ranked = {q.v: q.midrank for q in stats._count_ranked(df.where("g = 0"), "v", ["g"]).collect()}
    own = sorted(x[0::2])
    assert all(np.isclose(ranked[v], np.mean([i + 1 for i, w in enumerate(own) if w == v])) for v in own[::50])


def test_intervals_of_one_group(spark):
    r = np.random.default_rng(4)
    rows = [(1, int(s), int(s + w)) for s, w in zip(r.integers(0, 90_000, 3000), r.integers(1, 30, 3000))] + [(1, 5, 40_000), (2, 0, 3)]
    df = spark.createDataFrame(rows, "chr int, start long, end long")
    hit = np.zeros(100_000, int)
    for c, s, e in rows:
        if c == 1:
            hit[s:e] += 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (hit > 0).astype(int), [0]])))
    got = sorted((x.start, x.end) for x in intervals.collapse(df, "chr").where("chr = 1").collect())
    assert got == [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
    for x in intervals.coverage(df, "chr").where("chr = 1").collect():
        assert (hit[x.start : x.end] == x.depth).all()


def test_last_and_next_over_borders(spark):
    left = spark.createDataFrame([(1, t) for t in range(0, 4000, 7)], "k int, t long")
    right = spark.createDataFrame([(1, 3, "a"), (1, 2100, "b"), (2, 1, "c")], "k int, t long, v string")
    got = {x.t: x.v for x in joins.as_of(left, right, ["k"], "t", "v", "v").collect()}
    assert got == {t: None if t < 3 else "a" if t < 2100 else "b" for t in range(0, 4000, 7)}
    near = joins.insertion_interval(left.select(F.col("t").alias("x")), right, "x", "t")
    assert {x.x: (x.lo, x.hi) for x in near.collect()} == {float(t): (max((v for v in (1, 3, 2100) if v <= t), default=None), min((v for v in (1, 3, 2100) if v > t), default=None)) for t in range(0, 4000, 7)}
