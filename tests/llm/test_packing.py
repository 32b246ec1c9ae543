import random
import zlib

import numpy as np
import pytest

from helixframe.llm import packing
from helixframe.llm.q_packing import tokenizer_path

TEXTS = [None, "", " ", "a", "it's  they'll\n\n x_y __ 12a3 ²½ ª", "<|endoftext|> x", "日本語 text", "tab\t\tx \r\n y", "É à ß÷×", "\u00a0nbsp \u2003 em", "e\u0301 combining", "x" * 5000, "😀 \x1c sep", "a\x00b"]


def whole(text):
    return packing._tokenizer(tokenizer_path())[0].encode(text or "", add_special_tokens=False).ids + [2]


def test_token_bytes_match_the_tokenizer():
    r = random.Random(2)
    more = ["".join(r.choice(" \n\t_'sdlmtveREa1290.,;:-éßÀÿ(") for _ in range(r.randint(1, 80))) for _ in range(3000)]
    for t in [*TEXTS, *more]:
        assert np.frombuffer(packing.token_bytes(t or "", tokenizer_path()), "<u4").tolist() == whole(t)[:-1], t


@pytest.mark.parametrize("seed", range(30))
def test_plan_holds_every_length_once(seed):
    r = random.Random(seed)
    cap = r.choice([8, 50, 1024])
    hist = {r.randint(1, cap): r.randint(1, 300) for _ in range(r.randint(1, 60))}
    classes = packing.plan(hist, cap)
    assert all(0 < sum(a * b for a, b in held) <= cap for _, held in classes)
    got = {}
    for n, held in classes:
        for length, each in held:
            got[length] = got.get(length, 0) + n * each
    assert got == hist
    # as many sequences as plain best-fit decreasing
    rooms = []
    for length in sorted((x for x, n in hist.items() for _ in range(n)), reverse=True):
        fit = [x for x in rooms if x >= length]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else cap) - length)
    assert sum(n for n, _ in classes) == len(rooms)


def test_pack(spark):
    r = random.Random(3)
    texts = TEXTS + ["w " * r.randint(0, 900) for _ in range(200)] + ["same text"] * 150
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as part", "3 as rank")
    got = packing.pack(df, tokenizer_path(), capacity=256).collect()
    docs, sequences = {}, {}
    for p in sorted(got, key=lambda p: p.piece):
        ids = whole(texts[p.doc_id or 0])[p.start : p.start + p.length]
        assert len(ids) == p.length and p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert docs.get(p.doc_id, 0) == p.start and (p.length == 256 or p.piece == 0)
        docs[p.doc_id] = p.start + p.length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert docs == {i: len(whole(t)) for i, t in rows}
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.02 * sum(docs.values()) / 256 + 1
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0
