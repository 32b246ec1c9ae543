import random

import pytest

from helixframe.llm import decontaminate as D


def brute(text, items):
    """Every passage against every item."""
    index = D.Index(items)
    t = D.terms(text)
    out = set()
    for start in range(0, max(1, len(t)), index.half):
        ids = [index.vocabulary.get(w, -1) for w in t[start : start + 2 * index.half]]
        here = D.shingles(ids)
        for n, i in enumerate(index.items):
            whole = index.shingles[n]
            k = len(next(iter(whole)))
            share = len(whole & here) / len(whole) if k == D.SHINGLE else float(any(tuple(ids[j : j + k]) in whole for j in range(len(ids) - k + 1)))
            if share >= D.LEAST and all(len(s & set(ids)) / len(s) >= D.LEAST_WORDS for s in index.sides[n]):
                out.add(i)
    return sorted(out)


def cases(seed):
    r = random.Random(seed)
    common, rare = ["the", "of", "and", "to", "a"], [f"w{i}" for i in range(300)]
    word = lambda: r.choice(common) if r.random() < 0.5 else r.choice(rare)
    items = [(i, " ".join(word() for _ in range(r.randint(1, 40))) + ". Answer " + word() + " " + word()) for i in range(60)] + [(100, ""), (101, "the"), (102, "w1 w2")]
    texts = [None, "", "the", "w1 w2 and"]
    for _ in range(150):
        words = [word() for _ in range(r.randint(0, 300))]
        for _ in range(r.randint(0, 2)):
            leak = r.choice(items)[1].split()
            for _ in range(r.randint(0, 3)):
                if leak:
                    leak[r.randrange(len(leak))] = word()
            at = r.randint(0, len(words))
            words[at:at] = leak
        texts.append(" ".join(words))
    return items, texts


def test_wand_and_filter_lose_nothing():
    for seed in range(4):
        items, texts = cases(seed)
        index = D.Index(items)
        got = [[x["item_id"] for x in row] for row in index.leaks(texts)]
        assert got == [brute(t, items) for t in texts]
        assert any(got)


def test_wand_scores():
    items, texts = cases(9)
    index = D.Index(items)
    for t in texts:
        query = sorted({index.vocabulary[w] for w in D.terms(t) if w in index.vocabulary})
        score = {}
        for term in query:
            for n, w in zip(index.docs[term], index.impacts[term]):
                score[int(n)] = score.get(int(n), 0) + w
        assert sorted(index.above(query)) == sorted(n for n, s in score.items() if s >= 1 - 1e-6)


def test_operator(spark, monkeypatch):
    items, texts = cases(5)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[10])], "doc_id long, text string").selectExpr("*", "doc_id as item_id", "'x' as i")
    table = spark.createDataFrame([*items, (None, "a b c"), (7, None)], "item_id long, text string")
    want = {i: brute(t, items) for i, t in enumerate(texts)} | {None: brute(texts[10], items)}
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in D.find_leaks(docs, table).collect()}
    assert got == want
    monkeypatch.setattr(D, "ITEMS_AN_INDEX", 25)
    several = D.find_leaks(docs, table)
    assert several.columns == [*docs.columns, "leaks"] and several.count() == len(texts) + 1
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in several.collect()} == want
    named = D.find_leaks(docs, table.selectExpr("concat('id', item_id) as item_id", "text"))
    assert named.where("size(leaks) > 0").count() == 0  # ids that are no whole numbers match nothing
    assert D.find_leaks(docs, table.limit(0)).where("size(leaks) > 0").count() == 0
    assert D.find_leaks(docs.limit(0), table).count() == 0


def test_query(spark):
    from helixframe.llm.q_decontaminate import op2_decontaminate

    got = op2_decontaminate(spark, "/root/testdata/sf0.001")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("item_ids", "array<bigint>"), ("overlaps", "array<double>"), ("contaminated", "boolean")]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    found = {r.doc_id: r.item_ids for r in got.collect()}
    want = {r.doc_id: brute(r.text, items) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert found == want and any(want.values())


def test_scratch_removes_what_operators_write(spark, monkeypatch):
    import pathlib

    from helixframe.llm import common

    items, texts = cases(5)
    monkeypatch.setattr(D, "ITEMS_AN_INDEX", 25)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = pathlib.Path(common.shared_dir(spark).removeprefix("file://")) / "helixframe"
    before = set(folder.glob("*"))
    with common.scratch(spark):
        assert D.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).count() == len(texts)
        assert set(folder.glob("*")) > before
    assert set(folder.glob("*")) == before


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from helixframe.llm import common

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", getConf=lambda: conf))
    with pytest.raises(ValueError):
        common.shared_dir(cluster)
