"""Scans, filters and gapped sequences against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from helixframe.operators import alignment, scans


def _rows(n=40, markers=6):
    r = np.random.default_rng(7)
    x = r.integers(0, 3, (markers, n)).astype(float)
    y, c = r.normal(size=n) + x[0], r.normal(size=n)
    rows = [(m, i, m * 10, None if (m + i) % 9 == 0 else float(x[m, i]), None if i == 3 else float(y[i]), float(c[i])) for m in range(markers) for i in range(n)]
    return rows, x, y, c


def test_scan_with_covariate_and_product(spark):
    rows, x, y, c = _rows()
    df = spark.createDataFrame(rows, "m int, i int, pos int, d double, y double, c double")
    got = {(r.m, r.term): r for r in scans.marker_scan(df, "m", "d", ["y"], ["ADD"], "c").collect()}
    for m in range(6):
        use = [i for i in range(40) if (m + i) % 9 and i != 3]
        a = np.stack([np.ones(len(use)), x[m, use], c[use], x[m, use] * c[use]], axis=1)
        want = dict(zip(("intercept", "dosage", "c", "interaction"), np.linalg.lstsq(a, y[use], rcond=None)[0]))
        for term, b in want.items():
            assert np.isclose(got[m, term].beta, b) and got[m, term].n == len(use)


def test_region_sets(spark):
    rows, x, y, _ = _rows()
    df = spark.createDataFrame(rows, "m int, i int, pos int, d double, y double, c double").withColumn("chr", F.lit(1))
    regions = spark.createDataFrame([(1, 0, 25, "a"), (1, 20, 30, "a"), (1, 40, 60, "b"), (2, 0, 99, "c")], "chr int, start long, end long, region string")
    for weight in ("flat", "variance", "rare"):
        got = {r.set: r for r in scans.region_set_tests(df, regions, "chr", "pos", "region", "m", "i", "d", ["y"], weight, 15).collect()}
        assert set(got) == {"a", "b"} and got["a"].n_markers == 3 and got["b"].n_markers == 2
        mean, var = np.mean(np.delete(y, 3)), np.var(np.delete(y, 3))
        q = 0.0
        for m in (4, 5):
            known = [i for i in range(40) if (m + i) % 9]
            f = np.mean(x[m, known]) / 2
            p = min(f, 1 - f)
            w = {"flat": 1.0, "variance": 1 / (p * (1 - p)), "rare": (25 * (1 - p) ** 24) ** 2}[weight]
            q += w * sum(x[m, i] * (y[i] - mean) for i in known if i != 3) ** 2 / var
        assert np.isclose(got["b"].q, q)


def test_order_of_recode_filters(spark):
    df = spark.createDataFrame([(m, i, None if m == 2 and i < 5 else 2.0 if i < m + 1 else 0.0) for m in range(5) for i in range(10)], "m int, i int, d double")
    seen = []

    def prune(rows):
        seen.append({r.m for r in rows.select("m").distinct().collect()})
        return rows.select("m").distinct().where("m <> 3")

    one = lambda *ms: spark.createDataFrame([(m,) for m in ms], "m int")
    got = scans.recode_pipeline(df, "m", "i", "d", 0.15, prune, one(1, 2, 3, 4), 0.5, 0.2, one(2), spark.createDataFrame([(0,), (9,)], "i int"))
    assert seen == [{1, 3, 4}]  # marker 0 is too rare, and so is 2 without its missing ones
    assert sorted({(r.m, r.i) for r in got.collect()}) == [(m, i) for m in (1, 4) for i in (0, 9)]


def test_frames_of_back_alignment(spark):
    rows = [("MK-F", "ATGAAATTT"), ("MK-F", "CATGAAATTT"), ("MKF", "ATGAAA"), ("", "ATG"), ("-", "")]
    df = spark.createDataFrame(rows, "p string, s string")
    got = [r.c for r in df.select(alignment.back_aligned(F.col("p"), F.col("s")).alias("c")).collect()]
    assert got == ["ATGAAA---TTT", "ATGAAA---TTT", "ATGAAANNN", "", "---"]


def test_index_map(spark):
    df = spark.createDataFrame([(1, "A--C"), (2, ""), (3, "--")], "k int, s string")
    assert sorted(map(tuple, alignment.index_map(df, "k", "s").collect())) == [(1, 0, 0), (1, 3, 1)]
