"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each later logistic model sees,
besides the words of the text and their beginnings, the probabilities of the earlier categories. In
training those probabilities are out-of-fold: the words, too, are chosen without the fold
that a model predicts, so none learns from
predictions its own labels have shaped. A category's threshold is set where the out-of-fold
probabilities part its classes best. A bounded sample of labelled rows is
used for fitting; scoring reads every text whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from . import common

_TERM = re.compile(r"\w+")
#: Bounds of the fit: labelled rows (the first in hash order of their id) and words that become features.
MAX_ROWS, MAX_WORDS = 8000, 512
FOLDS, RIDGE = 5, 1e-4
PREFIXES = (4, 5, 6)


def _terms(text: str | None) -> set[str]:
    """The lower-cased words of a text and, marked by ``*``, their beginnings of PREFIXES characters, which catch inflected forms."""
    words = set(_TERM.findall((text or "").lower()))
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) >= n}


@arrow_udf(T.ArrayType(T.StringType()))
def _term_sets(texts: pa.Array) -> pa.Array:
    return pa.array([sorted(_terms(t.as_py())) for t in texts], pa.list_(pa.string()))


@dataclass
class Chain:
    """words: feature numbers; weights: per category one weight a word, one an earlier category's log-odds, and the bias; thresholds: per category the least probability that counts as positive."""

    categories: tuple[str, ...]
    words: dict[str, int]
    weights: list[np.ndarray]
    thresholds: list[float]

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, a row a text and a column a category; a null text counts as empty."""
        n = len(self.words)
        logit = np.zeros((len(texts), len(self.categories)))
        for i, text in enumerate(texts):
            at = [self.words[t] for t in _terms(text) if t in self.words]
            for j, w in enumerate(self.weights):
                logit[i, j] = w[at].sum() + w[-1]
        for j, w in enumerate(self.weights):
            for earlier in range(j):
                logit[:, j] += w[n + earlier] * _logit_clipped(_sigmoid(logit[:, earlier]))
        return _sigmoid(logit)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _logit_clipped(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Ridge logistic weights (the last is the bias) by Newton's method with step halving."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    pen = np.full(a.shape[1], ridge * max(1, len(x)))
    pen[-1] = 1e-6
    loss = lambda v: np.logaddexp(0, -(2 * y - 1) * (a @ v)).sum() + 0.5 * (pen * v * v).sum()
    now = loss(w)
    for _ in range(steps):
        p = _sigmoid(a @ w)
        g = a.T @ (p - y) + pen * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pen + 1e-9)
        step = np.linalg.solve(h, g)
        scale = 1.0
        while scale > 1e-4 and (then := loss(w - scale * step)) > now:
            scale /= 2
        if scale <= 1e-4:
            break
        w, done = w - scale * step, now - then < 1e-6 * now
        now = then
        if done:
            break
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where the mean of both classes' shares told right is greatest; of several such places the widest gap in log-odds, at its middle. One class alone: 0.5."""
    if not 0 < y.sum() < len(y):
        return 0.5
    at = np.argsort(p, kind="stable")
    z, told = _logit_clipped(p[at]), y[at]
    right = np.cumsum(1 - told)[:-1] / (1 - told).sum() + 1 - np.cumsum(told)[:-1] / told.sum()
    right[np.diff(p[at]) <= 0] = -1
    if (most := right.max()) < 0:
        return 0.5
    best = np.flatnonzero(right > most - 1e-12)
    i = best[np.diff(z)[best].argmax()]
    return float(_sigmoid((z[i] + z[i + 1]) / 2))


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray, words: dict[str, int], categories: tuple[str, ...], chosen: dict[int, list[int]] | None = None) -> Chain:
    """Fit the models in order. x: 0/1 word features; y: a 0/1 column a category; folds: a fold number a row.

    words: the features of the models. chosen: per fold the columns of x for the models that predict it (all of ``words`` unless given).
    """
    own = list(words.values())
    earlier, weights, thresholds = np.zeros((len(y), 0)), [], []
    for j in range(len(categories)):
        features = lambda columns: np.concatenate([x[:, columns].astype(float), earlier], axis=1)  # noqa: E731, B023
        weights.append(fit_logistic(features(own), y[:, j]))
        outside = np.zeros(len(y))
        for f in np.unique(folds):
            rest, held = folds != f, folds == f
            columns = own if chosen is None else chosen[int(f)]
            a = features(columns)
            w = fit_logistic(a[rest], y[rest, j]) if rest.any() else fit_logistic(a, y[:, j])
            outside[held] = _sigmoid(a[held] @ w[:-1] + w[-1])
        thresholds.append(best_threshold(outside, y[:, j]))
        earlier = np.concatenate([earlier, _logit_clipped(outside)[:, None]], axis=1)
    return Chain(categories, {w: i for i, w in enumerate(words)}, weights, thresholds)


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit a chain on at most MAX_ROWS labelled documents, the first in hash order of their id.

    Labels with a null id or category are left out, repeated ones of an id
    count by their greatest values, labels without a document not at all; of documents
    that share an id the least text counts. The MAX_WORDS words whose presence differs most between
    the classes of any category become features; for the models that predict a fold they are
chosen without it. Without labelled documents every probability is 0.5.
    """
    common.tune(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*[F.max(c).cast("int").alias(f"_y{i}") for i, c in enumerate(categories)])
    ys = [f"_y{i}" for i in range(len(categories))]
    known = known.dropna(subset=ys).withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(MAX_ROWS)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")  # MAX_ROWS ids at most
    rows = rows.groupBy("_id", "_h", *ys).agg(F.min("_text").alias("_text"))
    rows = common.materialize(rows.select("_id", "_h", *ys, _term_sets("_text").alias("_terms")), "labelled")

    # sums over all rows and without each fold in turn
    rows = rows.withColumn("_fold", F.pmod("_h", F.lit(FOLDS)).cast("int"))
    sides = [-1, *range(FOLDS)]
    sums = [F.sum(F.when(F.col("_fold") != e, v).otherwise(F.lit(0))).cast("double").alias(f"{name}{e}") for e in sides for name, v in [("n", F.lit(1)), *[(y, F.col(y)) for y in ys]]]
    totals = rows.agg(*sums).first().asDict()
    if not totals["n-1"]:
        return Chain(tuple(categories), {}, [np.zeros(j + 1) for j in range(len(categories))], [0.5] * len(categories))
    seen = rows.select(F.explode("_terms").alias("word"), "_fold", *ys).groupBy("word").agg(*sums).where("`n-1` >= 3")
    worth = []
    for e in sides:
        n, here = totals[f"n{e}"] or 0, F.col(f"n{e}")
        for y in ys:  # chi-square of presence by class
            pos = totals[f"{y}{e}"] or 0
            if 0 < pos < n:
                want = here * (pos / n)
                chi = (F.col(f"{y}{e}") - want) * (F.col(f"{y}{e}") - want) / (want * (1 - pos / n) * (1 - here / n) + 1e-9)
                worth.append(F.struct(F.lit(e).alias("e"), F.lit(y).alias("y"), F.when(here >= 3, chi).alias("s")))
    ranked = Window.partitionBy("e", "y").orderBy(F.desc("s"), "word")
    best = seen.select("word", F.explode(F.array(*worth)).alias("w")).select("word", "w.*").where("s IS NOT NULL").withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= MAX_WORDS // len(ys)) if worth else None
    picked: dict[int, set[str]] = {e: set() for e in sides}
    for r in best.select("e", "word").collect() if worth else []:  # MAX_WORDS for each fold
        picked[r["e"]].add(r["word"])
    words = {w: i for i, w in enumerate(sorted(set().union(*picked.values())))}

    @arrow_udf(T.BinaryType())
    def bits(terms: pa.Array) -> pa.Array:
        out = []
        for t in terms:
            row = np.zeros(len(words), bool)
            row[[words[w] for w in t.as_py() if w in words]] = True
            out.append(np.packbits(row).tobytes())
        return pa.array(out, pa.binary())

    got = rows.select("_id", "_h", *ys, bits("_terms").alias("_bits")).orderBy("_h", "_id").collect()  # MAX_ROWS rows of a bit a word
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r["_bits"]) for r in got), np.uint8).reshape(len(got), -1), axis=1)[:, : len(words)]
    y = np.array([[r[c] for c in ys] for r in got], float)
    own = {w: words[w] for w in sorted(picked[-1])}
    return fit_chain(x, y, np.array([r["_h"] % FOLDS for r in got]), own, tuple(categories), {f: sorted(words[w] for w in picked[f]) for f in range(FOLDS)})


def score(docs: DataFrame, chain: Chain, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out``, an array of the categories' probabilities in chain order, to every row; a null text counts as empty."""
    common.tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # MAX_WORDS weights a category

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def predicted(texts: pa.Array) -> pa.Array:
        out = pa.array(list(sent.value.predict([t.as_py() for t in texts])), pa.list_(pa.float64()))
        common.release()
        return out

    return docs.withColumn(out, predicted(F.col(text_col)))
