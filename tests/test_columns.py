"""Numbers as text: the exact value of a double is rounded, ties to the even digit, as C and SQL print it."""

from helixframe.functions import columns


def test_ties_and_values_beside_them(spark):
    rows = [(1, 0.125, 9000000.5), (2, 0.375, 9000001.5), (3, 2.675, 1e100), (4, None, 0.0), (5, -0.125, float("-inf")), (6, 1e23, float("nan"))]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    got = {r.id: (r.x, r.y) for r in df.select("id", columns.fixed(df.x).alias("x"), columns.scientific(df.y, 6).alias("y")).collect()}
    assert got == {1: ("0.12", "9.000000e+06"), 2: ("0.38", "9.000002e+06"), 3: ("2.67", "1.000000e+100"), 4: (None, "0.000000e+00"), 5: ("-0.12", "-inf"), 6: ("99999999999999991611392.00", "nan")}
