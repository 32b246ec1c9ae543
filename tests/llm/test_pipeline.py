import random

import corpus_pipeline as P
from helixframe.llm import decontaminate, line_dedup
from helixframe.llm.near_dup import shingle_set


def test_stages_and_run(spark, tmp_path):
    r = random.Random(7)
    word = lambda: f"w{r.randint(0, 3000)}"
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    item = " ".join(word() for _ in range(25)) + ". " + word() + " " + word()
    clean = [(i, text(r.randint(2, 12))) for i in range(120)]
    toxic = [(200 + i, text(4) + " slurone slurtwo") for i in range(60)]
    leaked = [(300, text(3) + "\n" + item + "\n" + text(3))]
    base = text(8)
    copies = [(400 + i, base.replace(base.split()[5 * i], "edited", 1)) for i in range(3)]
    rows = [(d, t, "en", "src", len(t)) for d, t in clean + toxic + leaked + copies] + [(500, None, None, None, None), (501, "", "en", "src", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(200 <= d < 300)) for d, *_ in rows if d < 300 and d % 5], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == list(P.COLUMNS)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {x.doc_id: x for x in docs.collect()} if name != "packing" else docs.collect()
    assert set(seen["toxicity"]) == {d for d, *_ in rows} - {d for d, _ in toxic}
    # line dedup: what stays are chunks met first
    bodies = set()
    for d in sorted(seen["toxicity"]):
        t = seen["toxicity"][d].text or ""
        lines, kept = t.split("\n"), []
        for a, b in line_dedup.chunk_spans(lines):
            if b - a >= line_dedup.MIN_LINES and tuple(lines[a:b]) in bodies:
                continue
            bodies.add(tuple(lines[a:b]))
            kept += lines[a:b]
        left = "\n".join(kept)
        if left != t and not left.strip():
            assert d not in seen["line_dedup"]
        else:
            assert (seen["line_dedup"][d].text or "") == left
    # one of each near group, all others
    texts = {d: shingle_set(x.text) for d, x in seen["line_dedup"].items()}
    kept = set(seen["near_dedup"])
    for d, s in texts.items():
        linked = [e for e, t in texts.items() if s and t and 100 * len(s & t) >= 80 * len(s | t)]
        assert d in kept or min(linked) < d
        assert len(kept & set(linked)) <= 1
    assert set(seen["decontamination"]) == kept - {300} and 300 in kept
    assert {x.doc_id for x in seen["packing"]} == set(seen["decontamination"])
    assert P.run(spark, str(tmp_path)).count() == len(seen["packing"])
    assert decontaminate.LEAST == 0.8
