from pyspark.sql import functions as F

from helixframe.operators import multitest

# A published example of p-values whose threshold at 0.2 is known.
P = [0.01, 0.032, 0.07, 0.07, 0.2, 0.38, 0.48, 0.49, 0.6, 0.68, 0.74, 0.97]


def test_threshold_golden(spark):
    df = spark.createDataFrame([(p,) for p in P] + [(None,), (float("nan"),)], "p double")
    assert multitest.bh_threshold(df, "p", 0.2).first()[0] == 0.032
    assert multitest.bh_threshold(df.limit(0), "p", 0.2).first()[0] == 0.0


def test_adjust_against_definition(spark):
    df = spark.createDataFrame([(p,) for p in P], "p double")
    got = sorted((r.p, round(r.p_adj, 12)) for r in multitest.bh_adjust(df, "p").collect())
    m = len(P)
    rank = {p: max(i + 1 for i, x in enumerate(sorted(P)) if x == p) for p in P}
    want = sorted((p, round(min(1.0, *(m * x / rank[x] for x in P if x >= p)), 12)) for p in P)
    assert got == want
    assert multitest.bh_adjust(df.select(F.lit(None).cast("double").alias("p")), "p").where("p_adj is not null").count() == 0
