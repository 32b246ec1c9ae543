"""Splits of large trees: deep ones, and wide ones without a set of all leaves for every leaf."""

from helixframe.operators import tree


def test_deep_tree(spark):
    n = 1500  # deeper than the interpreter nests calls
    text = "(" * (n - 1) + "t0" + "".join(f",t{i}){'' if i == n - 1 else 90 if i % 700 == 0 else 10}" for i in range(1, n)) + ";"
    df = spark.createDataFrame([("a", text)], "k string, text string")
    got = tree.newick_splits(df, "k", "text", 0.5).collect()
    assert sorted((len(r.side), r.support) for r in got) == [(n - 1401, 1.0), (n - 701, 1.0)]


def test_wide_tree_visits_a_leaf_once(spark, monkeypatch):
    asked = []
    real = tree.Node.leaves
    monkeypatch.setattr(tree.Node, "leaves", lambda n: asked.append(n) or real(n))
    root = tree.parse_newick("(" + ",".join(f"({','.join(f't{i}_{j}' for j in range(300))})0.9" for i in range(4)) + ");")
    assert len(tree.bipartitions(root, 0.5)) == 4 and len(asked) == 5
