import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from helixframe.llm import lm_scoring as S
from helixframe.llm.q_lm_scoring import HELD_OUT
from helixframe.llm.recurrent_net import Adam, Net, Shape

SMALL = Shape(7, 3, 2, 4)
WORD, LOW = re.compile("[^\x20\x09-\x0d]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def next_probabilities(net, before):
    """The distribution over symbols after each of ``before`` (a document's symbols so far), unit by unit."""
    s, p, h = net.shape, net.p, net.shape.hidden
    state = np.zeros(h)
    for symbol in [0, *before]:
        state = state * (symbol != 0)
        fed, back = p["table"][:, symbol] + p["bias"], state @ p["recur"]
        z = 1 / (1 + np.exp(-(fed[:h] + back[:h])))
        r = 1 / (1 + np.exp(-(fed[h : 2 * h] + back[h : 2 * h])))
        new = np.tanh(fed[2 * h :] + r * back[2 * h :])
        state = z * new + (1 - z) * state
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    classes, out = soft(state @ p["to_class"] + p["class_bias"]), []
    for c in range(s.word_classes):
        out += list(classes[c] * soft(state @ p["to_word"][c] + p["word_bias"][c]))
    return np.array(out[: s.words] + list(classes[s.word_classes :]))


@pytest.fixture
def net():
    r = np.random.default_rng(2)
    flat = SMALL.start(np.arange(9)).astype(float)
    return Net(SMALL, flat + r.normal(0, 0.2, flat.shape))


def test_document_probability_runs_over_windows(net):
    r = np.random.default_rng(4)
    docs = [np.array([*r.integers(1, 9, n), 0]) for n in (0, 1, 5, 40, 16, 15, 70)]
    for doc, got in zip(docs, net.log_probabilities(docs)):
        want = sum(math.log(next_probabilities(net, doc[:i])[s]) for i, s in enumerate(doc))
        assert got == pytest.approx(want, rel=1e-9)
    assert next_probabilities(net, [3, 8, 2]).sum() == pytest.approx(1)


def test_gradient(net):
    r = np.random.default_rng(3)
    docs = [np.array([*r.integers(1, 9, n), 0]) for n in (3, 9, 5)]  # within one window nothing is cut

    class Seen:
        def step(self, flat, grad):
            self.grad = grad.copy()

    seen = Seen()
    n = net.train(docs, seen)
    for i in range(0, SMALL.size, 3):
        at = net.flat.copy()
        at[i] += 1e-5
        up = Net(SMALL, at.copy()).log_probabilities(docs).sum()
        at[i] -= 2e-5
        down = Net(SMALL, at).log_probabilities(docs).sum()
        assert seen.grad[i] * n == pytest.approx((down - up) / 2e-5, abs=1e-6)


def test_learns_an_order_that_counts_cannot_tell():
    docs = [np.array([1 + (k + i) % 4 for i in range(30)] + [0]) for k in range(4) for _ in range(40)]
    counts = np.bincount(np.concatenate(docs), minlength=9)
    net = Net(SMALL, SMALL.start(counts))
    before, adam = net.log_probabilities(docs).sum(), Adam(SMALL.size, 0.02)
    for _ in range(25):
        net.train(docs, adam)
    assert net.log_probabilities(docs).sum() > before / 3


def test_table(spark, monkeypatch):
    monkeypatch.setattr(S, "LOOKUP_WORDS", 20)
    r = random.Random(6)
    vocabulary = [f"{r.choice('AbcÉ')}{k}" for k in range(60)]
    rows = [(i, r.choice([" ", "\n", "\x0b "]).join(r.choices(vocabulary, range(60, 0, -1), k=r.randint(0, 80)))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "B1 unseen word"), (3, rows[3][1]), (3, "other text of the id"), (502, "lone " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, score double")
    got = S.score(docs, HELD_OUT, shape=Shape(8, 4, 3, 4)).collect()
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [WORD.findall((t or "").translate(LOW)) + ["\n"] for _, t in rows]
    c = collections.Counter(w for (i, _), ws in zip(rows, tokens) if not crc(i) for w in ws)
    n, v = sum(c.values()), len(c)
    key = lambda x: (str(x[0]), x[2], round(x[5], 5))
    want = sorted([(i, crc(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (i, _), ws in zip(rows, tokens)], key=key)
    seen = sorted([tuple(x)[:6] for x in got], key=key)
    assert [x[:5] for x in seen] == [x[:5] for x in want]
    assert all(a[5] == pytest.approx(b[5]) for a, b in zip(seen, want))
    assert all(math.isfinite(x.score) and x.score < 0 for x in got)
    empty = S.score(docs.limit(0), HELD_OUT)
    assert empty.count() == 0 and empty.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    none = S.score(docs.limit(3), "true").collect()
    assert all(x.train_tokens == 0 and x.n_known == 0 for x in none)


def test_words_of_every_kind_share_one_distribution(spark, monkeypatch):
    """Given a text, the probabilities of all next words that there are, and of the unseen ones a tail class, sum to 1."""
    monkeypatch.setattr(S, "LOOKUP_WORDS", 6)
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(14)]
    rows = [(k, " ".join(r.choices(vocabulary, range(14, 0, -1), k=20))) for k in range(40)]
    shape = Shape(5, 2, 2, 3)
    unseen = {S.tail_class(w.encode(), 2): w for w in ("zzq", "zzr", "zzs", "zzt", "zzu")}
    probes = [(1000, "w1 w2")] + [(1001 + k, f"w1 w2 {w}") for k, w in enumerate([*vocabulary, *unseen.values()])]
    docs = spark.createDataFrame(rows + probes, "doc_id long, text string")
    got = {x.doc_id: x for x in S.score(docs, "doc_id >= 1000", shape=shape).collect()}
    corpus = S.gather(docs.where("doc_id < 1000").selectExpr("cast(text as binary) text"), shape)
    coded = S.symbols(docs.where("doc_id < 1000 or doc_id = 1000").selectExpr("doc_id row", "false held_out", "cast(text as binary) text"), corpus)
    net = Net(shape, S.train(coded.where("row < 1000"), corpus))
    end = lambda text: math.log10(next_probabilities(net, text)[0])
    ids = {x.row: np.frombuffer(x.ids, "<u2") for x in S.symbols(docs.selectExpr("doc_id row", "false held_out", "cast(text as binary) text"), corpus).collect()}
    stem = got[1000].score - end(ids[1000][:-1])
    total = 10 ** end(ids[1000][:-1]) + sum(10 ** (got[i].score - end(ids[i][:-1]) - stem) for i in got if i > 1000)
    assert total == pytest.approx(1, rel=0.02)  # training in rounds need not repeat to the last digit
