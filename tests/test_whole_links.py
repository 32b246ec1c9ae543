"""Linked suppliers over all parts, against plain Python; parts and suppliers outside the former remainders."""

import random

from helixframe.plans import catalogue


def test_all_parts_link(spark, tmp_path):
    r = random.Random(8)
    items = [(40 * k + r.randint(1, 39), r.randint(1, 90)) for k in range(60) for _ in range(2)]
    spark.createDataFrame(items, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    root = {s: s for _, s in items}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for p, s in items:
        by.setdefault(p, set()).add(s)
    for group in by.values():
        for s in group:
            a, b = sorted((top(s), top(min(group))))
            root[b] = a
    linked = {s for g in by.values() if len(g) > 1 for s in g}
    got = catalogue.queries()["connected_components"](spark, str(tmp_path)).collect()
    assert {x.node: x.root for x in got} == {s: top(s) for s in linked}
