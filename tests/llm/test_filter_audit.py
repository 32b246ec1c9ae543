import random
import re
from fractions import Fraction
from itertools import permutations

from helixframe.llm import filter_audit as A

SPACE = re.compile("[^\x20\x09-\x0d]+")


def fails(rows):
    """The set of failed filters of each row, straight from the rules."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = SPACE.findall(t)
        got = set()
        if len(w) < 100:
            got.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            got.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            got.add("C")
        if re.search(r"[#$%&*|]", t):
            got.add("D")
        if i is not None and any(j is not None and j < i and (s or "") == t for j, s, _ in rows):
            got.add("E")
        out.append(got)
    return out


def slow(rows, good, toxic):
    """Run every order of the filters over every document."""
    failed, out = fails(rows), {}
    for part in {p or "" for *_, p in rows}:
        mine = [(i, f) for (i, _, p), f in zip(rows, failed) if (p or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                here = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                share[x] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), sum(x in f for _, f in mine) - len(here), sum(f == {x} for _, f in mine), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here), x]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = share[out[key][-1]]
    return out


def test_against_running_every_order(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeABC") for _ in range(r.randint(1, 3)))
    text = lambda: r.choice(["\n", " ", "\t\x0b"]).join(word() for _ in range(r.randint(60, 160))) + r.choice(["", "", " #", "|", "é" * 30])
    pool = [text() for _ in range(40)] + [" ".join(f"w{i}" for i in range(150)), "", None]
    rows = [(i, r.choice(pool), r.choice(["en", "fr", "", None])) for i in range(160)]
    rows += [(7, rows[7][1], "en"), (7, rows[7][1], "en"), (None, pool[0], "en"), (None, pool[0], "fr"), (900, "x" * 300_000, "de"), (901, "a b " * 50_000, "de")]
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(0, 160, 2)] + [(4, 1, None), (4, None, 1), (7777, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*x, 0, "z") for x in rows], "doc_id long, text string, lang string, n long, mask string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in A.audit(docs, table).collect()}
    good, toxic = {i for i, q, _ in labels if q and i is not None}, {i for i, _, t in labels if t and i is not None}
    assert got == slow(rows, good, toxic)
    assert len(got) == 600 * len({p or "" for *_, p in rows})
    assert A.audit(docs.limit(0), table).count() == 0


def test_polynomial():
    r = random.Random(1)
    counts = [r.randint(0, 9) for _ in range(32)]
    f = A.Removal(counts)
    assert all(f.corner(s) == sum(c for m, c in enumerate(counts) if m & s) for s in range(32))
    # each document shares its removal equally among the filters it fails
    assert all(f.shapley(i) == sum((Fraction(c, m.bit_count()) for m, c in enumerate(counts) if m >> i & 1), Fraction(0)) for i in range(5))
    assert sum(f.shapley(i) for i in range(5)) == f.corner(31)
