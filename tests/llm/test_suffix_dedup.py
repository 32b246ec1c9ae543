import random

import pytest

from helixframe.llm import suffix_dedup as S
from helixframe.llm.suffix_array import suffix_array


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for i, t in enumerate(raw):
        for a in range(len(t) - length + 1):
            seen.setdefault(t[a : a + length], []).append((i, a))
    spans = [[] for _ in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                spans[i].append((a, a + length))
    out = []
    for t, s in zip(raw, spans):
        runs, kept, at = S.merged(s), b"", 0
        for lo, hi in runs:
            kept, at = kept + t[at:lo], hi
        out.append((len(t), runs, kept + t[at:]))
    return out


def test_suffix_array():
    r = random.Random(1)
    for _ in range(1500):
        n, k = r.randint(0, 40), r.choice([1, 2, 3, 10])
        s = [r.randrange(k) for _ in range(n)]
        if r.random() < 0.3 and n:
            s = (s[: max(1, n // 4)] * 5)[:n]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def corpus(seed):
    r = random.Random(seed)
    noise = lambda n: "".join(r.choice("abcdefé ") for _ in range(n))
    passages = [noise(n) for n in (30, 39, 40, 41, 60, 90, 200)]
    texts = [noise(r.randint(0, 30)) + r.choice(passages) + noise(r.randint(0, 60)) + r.choice(["", r.choice(passages)[5:]]) + noise(r.randint(0, 9)) for _ in range(150)]
    base = noise(300)
    for _ in range(20):
        at = r.randint(0, 290)
        texts.append(base[:at] + "#" + base[at + 1 :])
    return texts + [None, "", "a" * 39, "a" * 40, "a" * 41, "ab" * 100, "\x00" * 60, "x" + "\x00" * 41, base, base, "z" * 3000, noise(1) * 45]


@pytest.mark.parametrize("seed,shard,fan", [(1, 3000, 4), (2, 10, 2), (3, 1, 4)])
def test_against_brute_force(spark, monkeypatch, seed, shard, fan):
    monkeypatch.setattr(S, "SHARD", shard)
    monkeypatch.setattr(S, "FAN", fan)
    monkeypatch.setattr(S, "SYMBOL", 7)
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as t1", "2 as g", "'s' as spans")
    got = {x.doc_id: (x.n_bytes, [tuple(s) for s in x.spans], bytes(x.kept)) for x in S.remove_repeats(df, 40).collect()}
    want = dict(enumerate(brute(texts, 40)))
    assert got == want
    assert sum(bool(w[1]) for w in want.values()) > 50


def test_shards_against_brute_force():
    r = random.Random(6)
    length, window = 40, 20
    left, right, group = [], [], []
    for g in range(400):
        base = bytes(r.randrange(60) for _ in range(window - 1 + length))
        for _ in range(r.randint(2, 4)):
            row = bytearray(base)
            for _ in range(r.randint(0, 2)):
                row[r.randrange(len(row))] = r.randrange(60)
            a, b = r.choice([0, 0, 5]), len(row) - r.choice([0, 0, 7])
            left.append(bytes(row[a : window - 1]))
            right.append(bytes(row[window - 1 : b]))
            group.append(g)
    want = set()
    for i in range(len(group)):
        for j in range(len(group)):
            if i != j and group[i] == group[j]:
                for d in range(min(window, len(left[i]) + 1, len(left[j]) + 1)):
                    n = length - d
                    if len(right[i]) >= n and len(right[j]) >= n and left[i][len(left[i]) - d :] == left[j][len(left[j]) - d :] and right[i][:n] == right[j][:n]:
                        want.add((i, d))
    got = {(i, d) for i, a, b in S.shared_strings(left, right, group, length, window) for d in range(a, b + 1)}
    assert got == want and len(want) > 500


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([(1, "q" * 400), (1, "q" * 400), (None, None)], "doc_id long, text string")
    assert sorted((x.doc_id or 0, len(x.kept)) for x in S.remove_repeats(same).collect()) == [(0, 0), (1, 0), (1, 0)]


def test_query_on_planted_passages(spark, tmp_path):
    """Passages of just over 50 words, shorter and longer than 400 bytes, in two documents each: the registered query against brute force."""
    from helixframe.llm.q_suffix_dedup import op6_suffix_dedup

    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz\u00e9") for _ in range(n))
    prose = lambda words, n: " ".join(word(r.randint(max(1, n - 2), n + 2)) for _ in range(words))
    passages = [prose(words, n) for words in (51, 52, 55, 60) for n in (4, 6, 7, 9)]
    texts = [f"{prose(20, 5)} {p} {prose(r.randint(0, 30), 5)}" for p in passages for _ in range(2)] + [None, "", prose(300, 5)]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op6_suffix_dedup(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string"), ("has_repeats", "boolean")]
    found = {x.doc_id: tuple(x)[1:] for x in got.collect()}
    want = {i: (n, n - len(kept), len(runs), S.hashlib.sha256(kept).hexdigest(), bool(runs)) for i, (n, runs, kept) in enumerate(brute(texts, 400))}
    assert found == want
    lost = [any(len(p.encode()) >= 399 for p in (passages[i // 2],)) for i in range(2 * len(passages))]
    assert {w[-1] for i, w in want.items() if i < len(lost) and lost[i]} == {True} and not all(w[-1] for w in want.values())
