"""Words split and coded by Arrow, windows over the longest documents, and tasks of a round."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helixframe.llm import lm_scoring as S
from helixframe.llm.recurrent_net import LANES, WINDOW, Lanes, Shape


def test_words_are_those_of_bytes():
    r = random.Random(5)
    texts = [b"", None, b" ", b"\x1c\x1d\x85a\xa0B\x00", " Ünï CODE É ".encode(), bytes(range(256)), *(bytes(r.choices(b"aB \t\n\x0b\x0c\r\xc3\x89", k=r.randint(0, 30))) for _ in range(300))]
    words, sizes = S.words_of(pa.array(texts, pa.binary()).slice(1))
    want = [(t or b"").lower().split() for t in texts[1:]]
    assert sizes.tolist() == [len(x) for x in want] and words.to_pylist() == [w for x in want for w in x]
    assert S.words_of(pa.array([], pa.binary()))[1].tolist() == []


def test_long_documents_take_few_windows():
    docs = [np.array([*[1] * n, 0]) for n in [50 * WINDOW - 1, *[WINDOW - 1] * (LANES - 1)]]
    windows = list(Lanes(docs).windows())
    places = np.concatenate([at[live] for at, live in windows])
    assert len(windows) < 10 and sorted(places.tolist()) == list(range(sum(map(len, docs))))


def test_counts_follow_each_document(spark, monkeypatch):
    monkeypatch.setattr(S, "LOOKUP_WORDS", 3)
    docs = spark.createDataFrame([(0, "b a B zz qq zz"), (1, None), (2, " c\tqq "), (3, "")], "row long, text string").select("row", F.col("text").cast("binary").alias("text"))
    corpus = S.gather(spark.createDataFrame([("a b b b c c",)], "text string").select(F.col("text").cast("binary").alias("text")), Shape(3, 2, 2, 2))
    got = {x.row: x for x in S.symbols(docs.repartition(1), corpus).collect()}
    assert {k: (x.n_tokens, x.n_known) for k, x in got.items()} == {0: (7, 4), 1: (1, 1), 2: (3, 2), 3: (1, 1)}
    assert {k: {(bytes(y.word), y.k) for y in x.rare} for k, x in got.items()} == {0: {(b"zz", 2), (b"qq", 1)}, 1: set(), 2: {(b"qq", 1)}, 3: set()}
    assert np.frombuffer(got[0].ids, "<u2")[[0, 2, 6]].tolist() == [1, 1, 0] and len(got[2].ids) == 6
