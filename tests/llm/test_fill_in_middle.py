import hashlib
import random
import re

from hypothesis import given, settings, strategies as st

from helixframe.llm import fill_in_middle as M

WORDS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def checked(rope):
    """Heights, counts and balance of every node."""
    if rope.left is None:
        assert rope.height == 0 and rope.chars == len(rope.text)
        return
    assert abs(rope.left.height - rope.right.height) <= 1 and rope.height == 1 + max(rope.left.height, rope.right.height)
    assert rope.units == rope.left.units + rope.right.units and rope.chars == rope.left.chars + rope.right.chars
    checked(rope.left), checked(rope.right)


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet="ab \n\té€😀<PSM>", max_size=400), st.integers(0, 300), st.integers(0, 300))
def test_rope_splits_and_joins(text, a, b):
    M_LEAF, M.LEAF_UNITS = M.LEAF_UNITS, 3
    try:
        rope, units = M.build(text), WORDS.findall(text)
        assert rope.units == len(units) and M.text_of(rope) == text
        x, y = M.split(rope, a)
        assert M.text_of(x) == "".join(units[:a]) and M.text_of(y) == "".join(units[a:])
        p, q = M.split_chars(rope, b)
        assert M.text_of(p) == text[:b] and M.text_of(q) == text[b:]
        for r in (rope, x, y, p, q, M.concat(y, x), M.concat(M.concat(q, rope), p)):
            checked(r)
        assert M.text_of(M.concat(y, x)) == "".join(units[a:] + units[:a])
    finally:
        M.LEAF_UNITS = M_LEAF


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet="ab \n<P>SM", max_size=60), st.integers(0, 40), st.integers(0, 40), st.sampled_from([M.PSM, M.SPM]))
def test_round_trip(text, a, b, form):
    if any(s in text for s in M.SENTINELS):
        return
    out, _, _ = M.arrange(text, min(a, b), max(a, b), form)
    assert M.restore(out, form) == text


def slow(doc_id, text):
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    u = WORDS.findall(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_whole_table(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(["ab", "é ", "\n\n", "😀", " the", "<", "P>"]) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(301, None), (302, ""), (None, "null id here"), (5, "repeated id"), (5, "repeated id"), (303, "x " * 200_000), (304, "y" * 1_000_000), (305, "has <P> inside"), (306, " \t\n ")]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, form string")
    got = M.transform(docs, out="f")
    assert got.columns == ["doc_id", "text", "form", "f"]
    seen = got.select("doc_id", "text", "f.*", M.restored(got.f.output, got.f.form).alias("back")).collect()
    key = lambda x: (x[0] is None, x[0], x[1])
    want = sorted([(i, t or "", *slow(i, t), t or "") for i, t in rows], key=key)
    assert sorted([(x.doc_id, x.text or "", x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.back) for x in seen], key=key) == want
    assert {x.form for x in seen} == {"plain", "psm", "spm"}
    assert M.transform(docs.limit(0)).count() == 0
