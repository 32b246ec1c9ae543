"""Genotype queries over all line items, against plain Python on parts on both sides of number 1000."""

import math
import random

from helixframe.plans import catalogue


def test_parts_from_1000_on_count(spark, tmp_path):
    r = random.Random(3)
    items = [(r.randint(1, 5000), r.randint(1, 200), r.randint(1, 100000)) for _ in range(20000)]
    spark.createDataFrame(items, "l_partkey long, l_suppkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()
    top = {}
    for part, supp, order in items:
        top[part, supp] = max(order, top.get((part, supp), 0))
    dose = {k: x * 7919 % 201 / 100 if x % 17 else None for k, x in top.items()}
    known = {}
    for (m, _), v in dose.items():
        known.setdefault(m, []).extend([v] if v is not None else [])
    got = {x.marker: x for x in run("maf_summary")}
    assert set(got) == set(known) and len(got) > 4000
    for m, x in got.items():
        assert x.n == len(known[m]) and (not x.n or math.isclose(x.freq, sum(known[m]) / (2 * x.n), abs_tol=1e-6))
    gram = run("gram_matrix")
    assert max(x.i for x in gram) == 200 and all(x.i >= x.j for x in gram)
    for name in ("marker_scan", "burden", "pairwise_r2"):
        assert run(name)
