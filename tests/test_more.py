import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence
from helixframe.operators import models, sets
from helixframe.sources import formats, sinks


def test_sequence_helpers(spark):
    df = spark.createDataFrame([("AACCGT", "ACGGTT", 100, "5M10N3M2I4N1M")], "s string, r string, p long, c string")
    got = df.select(sequence.orient_to(F.col("s"), F.col("r")).alias("o"), sequence.remove_primer(F.col("s"), "AAC", 1).alias("cut"), sequence.splice_gaps(F.col("p"), F.col("c")).alias("gaps"), sequence.expand(F.lit("r")).alias("x")).first()
    assert got.o == "ACGGTT" and got.cut == "CGT" and [tuple(g) for g in got.gaps] == [(105, 115), (118, 122)] and got.x == ["A", "G"]


def test_multinomial(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0)], "k string, w double")
    got = {r.k: r.n for r in sets.multinomial(w, "k", "w", 4000).collect()}
    assert sum(got.values()) == 4000 and set(got) == {"a", "b"} and got["a"] / 4000 == pytest.approx(0.25, abs=0.03)


def test_global_test(spark):
    r = np.random.default_rng(0)
    x, y = r.integers(0, 3, (30, 4)), r.normal(size=30)
    df = spark.createDataFrame([(j, int(x[i, j]), float(y[i])) for i in range(30) for j in range(4)], "m int, x int, y double")
    want = sum((x[:, j] @ (y - y.mean())) ** 2 for j in range(4)) / y.var()
    assert models.global_test_statistic(df, [], "y", "m", "x").first().q == pytest.approx(want)
    assert models.permutation_p(2.0, np.array([1, 2, 3])) == 0.75


def test_writers(spark, tmp_path):
    g = spark.createDataFrame([(1, 1, 5.0, 0.9), (2, 1, 5.0, -0.7)], "i int, j int, n double, value double")
    sinks.grm_text(g, f"{tmp_path}/g")
    assert formats.grm_text(spark, f"{tmp_path}/g").count() == 3
    v = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t5\t.\tA\tG\t50.0\tPASS\tAC=2;DB\n"
    (tmp_path / "a.vcf").write_text(v)
    assert sinks.vcf_lines(formats.vcf(spark, f"{tmp_path}/a.vcf")).first().value == v.split("\n")[1]
    a = spark.createDataFrame([("rs", "1", 5, "A", 0.1, 0.2, None)], "snp string, chr string, bp long, a1 string, beta double, se double, p double")
    sinks.association(a, f"{tmp_path}/as")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/as").collect())[-1] == "rs 1 5 A 0.1 0.2 NA"
