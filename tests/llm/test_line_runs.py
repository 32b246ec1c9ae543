import hashlib
import random

from helixframe.llm import line_dedup as L
from helixframe.llm.q_line_dedup import op1_line_dedup


def brute(rows):
    """Every run of two lines or more against every run before it; chunks play no part."""
    order = sorted({(d is None, d or 0, t, d) for d, t in rows if t and "\n" in t}, key=lambda x: x[:3])
    seen, out = set(), {}
    for _, _, t, d in order:
        lines = t.split("\n")
        spans = [(a, b) for a in range(len(lines)) for b in range(a + 2, len(lines) + 1)]
        ends = {}  # first end of each run within the document
        for a, b in sorted(spans, key=lambda x: x[1]):
            ends.setdefault(tuple(lines[a:b]), b)
        gone = {k for a, b in spans if (run := tuple(lines[a:b])) in seen or ends[run] <= a for k in range(a, b)}
        seen.update(ends)
        out[d, t] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return [out.get((d, t), (t, 0)) for d, t in rows]


def corpus():
    r = random.Random(11)
    pool = [f"line {i}" for i in range(30)] + ["", " ", "é"]
    passages = [[f"passage {k} {i}" for i in range(n)] for k, n in enumerate([2, 2, 3, 4, 7, 12])]
    rows = []
    for i in range(150):
        lines = [r.choice(pool) + (str(r.random()) if r.random() < 0.7 else "") for _ in range(r.randint(0, 12))]
        at = r.randint(0, len(lines))
        lines[at:at] = r.choice(passages)
        rows.append((i, "\n".join(lines)))
    rows += [(300, None), (301, ""), (302, "one line"), (303, "one line"), (304, "\n" * 20), (305, "\n" * 20), (10, rows[10][1]), (None, rows[3][1])]
    return rows + [(400, "x\nx\nx"), (401, "y\nz\ny\nz\ny")]


def test_runs_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'k' as key", "9 as removed_lines")
    got = L.dedup_runs(df)
    assert got.columns == df.columns
    found = sorted((x.doc_id is None, x.doc_id or 0, x.text or "", x.removed_lines) for x in got.collect())
    assert found == sorted((d is None, d or 0, t or "", n) for (d, _), (t, n) in zip(rows, brute(rows)))
    by = {d: (t, n) for _, d, t, n in found if d}
    assert by[400] == ("x\nx\nx", 0) and by[401] == ("y\nz", 3)
    assert L.dedup_runs(df.limit(0)).count() == 0


def test_query_removes_whole_passages(spark, tmp_path):
    """Passages of two lines and more between lines of their own go to the last line, which chunks leave standing."""
    rows = [(i, f"a{i}\n" + "\n".join(f"p{i // 2} {k}" for k in range(2 + i // 2 % 5)) + f"\nb{i}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op1_line_dedup(spark, str(tmp_path)).collect()}
    for i, t in rows:
        left = f"a{i}\nb{i}" if i % 2 else t
        assert got[i].kept_sha256 == hashlib.sha256(left.encode()).hexdigest()
        assert got[i].removed_lines == (2 + i // 2 % 5 if i % 2 else 0)
