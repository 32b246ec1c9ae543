import random

from helixframe.llm import line_dedup as L


def brute(rows):
    seen, out = {}, {}
    order = sorted({(d is None, d, t) for d, t in rows if t}, key=lambda x: (x[0], x[1] if x[1] is not None else 0))
    for _, d, t in order:
        lines = t.split("\n")
        kept, removed = [], 0
        for a, b in L.chunk_spans(lines):
            body = tuple(lines[a:b])
            if b - a >= L.MIN_LINES and "\n" in t and body in seen:
                removed += b - a
            else:
                kept += lines[a:b]
                seen[body] = 1
        out[(d, t)] = ("\n".join(kept), removed)
    return [out.get((d, t), (t, 0)) for d, t in rows]


def test_against_brute_force(spark):
    r = random.Random(4)
    pool = [f"line {i}" for i in range(40)] + ["", " ", "é", "x" * 5000]
    passage = [r.choice(pool) for _ in range(12)]
    rows = []
    for i in range(250):
        lines = [r.choice(pool) + (str(r.random()) if r.random() < 0.5 else "") for _ in range(r.randint(0, 20))]
        if r.random() < 0.5:
            at = r.randint(0, len(lines))
            lines[at:at] = passage
        rows.append((i, "\n".join(lines)))
    rows += [(300, None), (301, ""), (302, "one line"), (303, "one line"), (304, "\n" * 50), (305, "\n" * 50), (10, rows[10][1]), (None, rows[3][1])]
    rows += [(400 + i, "\n".join(passage)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'k' as key", "9 as removed_lines")
    got = L.dedup_lines(df)
    assert got.columns == df.columns
    found = sorted(((x.doc_id is None, x.doc_id or 0, x.text or "", x.removed_lines) for x in got.collect()))
    want = sorted((d is None, d or 0, t or "", n) for (d, _), (t, n) in zip(rows, brute(rows)))
    assert found == want
    assert sum(n for *_, n in found) > 500
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_boundaries_resist_shifts():
    r = random.Random(0)
    lines = [str(r.random()) for _ in range(200)]
    a = {tuple(lines[x:y]) for x, y in L.chunk_spans(lines)}
    more = lines[:50] + ["inserted"] + lines[50:]
    b = {tuple(more[x:y]) for x, y in L.chunk_spans(more)}
    assert len(a - b) <= 2
