"""Benchmark decontamination: BM25 over an index of test items, block-max WAND.

Test items are indexed by term, postings in blocks with the greatest impact of
each block. A text is cut into overlapping passages twice as long as the
longest item, half a passage apart, so any verbatim item lies whole in one; each passage
queries the index and retrieves every item above the threshold. Impacts are
scaled by an item's own threshold: the least BM25 score that a passage can have
which holds enough of the item's word shingles to pass verification, so the
threshold loses nothing. Retrieved items are verified by overlap.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from . import common

_TERM = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
#: Words in a shingle; least share of an item's shingles, and of the words of its question and of its answer, found in the passage.
SHINGLE, LEAST, LEAST_WORDS = 5, 0.8, 0.6
K1, B, BLOCK = 1.2, 0.75, 16
#: Test items of one index; more are searched index by index.
ITEMS_AN_INDEX = 20_000

LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("overlap", T.DoubleType()), T.StructField("question", T.DoubleType()), T.StructField("answer", T.DoubleType())]))


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence or line is the answer, what precedes it the question; a single sentence is both."""
    parts = [p for p in _SENTENCE.split(text) if terms(p)]
    if len(parts) < 2:
        return terms(text), terms(text)
    return [t for p in parts[:-1] for t in terms(p)], terms(parts[-1])


def shingles(ids: list[int]) -> set[tuple[int, ...]]:
    return {tuple(ids[i : i + SHINGLE]) for i in range(max(1, len(ids) - SHINGLE + 1))} if ids else set()


class Index:
    """Inverted index of items: (item id, question terms, answer terms, all terms)."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        kept = [(i, t) for i, t in sorted(items) if terms(t)]
        self.items = [i for i, _ in kept]
        worded = [terms(t) for _, t in kept]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for ws in worded for w in ws}))}
        coded = [[self.vocabulary[w] for w in ws] for ws in worded]
        self.shingles = [shingles(c) for c in coded]
        self.sides = [tuple({self.vocabulary[w] for w in side} for side in question_answer(t)) for _, t in kept]
        longest = max(map(len, coded), default=1)
        self.half = max(SHINGLE, longest)
        df = Counter(t for c in coded for t in set(c))
        mean = sum(map(len, coded)) / max(1, len(coded))
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for n, c in enumerate(coded):
            weight = {t: math.log(1 + (len(coded) - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(c) / mean)) for t, tf in Counter(c).items()}
            least = self._least(weight, self.shingles[n])
            for t, w in weight.items():
                postings[t].append((n, w / max(least, 1e-9)))
        size = len(self.vocabulary)
        self.docs = [np.array([n for n, _ in postings[t]], np.int64) for t in range(size)]
        self.impacts = [np.array([w for _, w in postings[t]]) for t in range(size)]
        self.block_max = [np.maximum.reduceat(w, np.arange(0, len(w), BLOCK)).tolist() for w in self.impacts]
        self.block_end = [d[np.minimum(np.arange(BLOCK, len(d) + BLOCK, BLOCK), len(d)) - 1].tolist() for d in self.docs]
        self.most = np.array([w.max() for w in self.impacts] or [0.0])
        # the same bounds by ranges of items, to rule passages out many at a time
        self.span = max(1, -(-len(kept) // 64))
        self.grid = np.zeros((max(1, size), -(-max(1, len(kept)) // self.span)), np.float32)
        for t in range(size):
            np.maximum.at(self.grid[t], self.docs[t] // self.span, self.impacts[t].astype(np.float32))

    @staticmethod
    def _least(weight: dict[int, float], found: set[tuple[int, ...]]) -> float:
        """The least score of a passage with LEAST of the shingles: missing terms take shingles with them, each of at most SHINGLE terms."""
        kills = Counter(t for s in found for t in set(s))
        room = SHINGLE * math.floor((1 - LEAST) * len(found) + 1e-9)
        lost = 0.0
        for t in sorted(weight, key=lambda t: -weight[t] / kills[t]):
            if room <= 0:
                break
            lost += weight[t] * min(1.0, room / kills[t])
            room -= kills[t]
        return sum(weight.values()) - lost - 1e-9

    def above(self, query: list[int]) -> list[int]:
        """Items whose scaled score for the distinct terms of a query is 1 or more, by block-max WAND."""
        out: list[int] = []
        cursors = [[int(self.docs[t][0]), 0, t] for t in query]  # item, place, term
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= 1 - 1e-6:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # bound by the blocks that hold the pivot item, and where the first of these ends
            bound, upto = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.items)
            for _, place, t in cursors[: pivot + 1]:
                k = place // BLOCK
                ends = self.block_end[t]
                while k < len(ends) and ends[k] < item:
                    k += 1
                if k < len(ends):
                    bound += self.block_max[t][k]
                    upto = min(upto, ends[k] + 1)
            if bound >= 1 - 1e-6:
                if cursors[0][0] == item:
                    score = 0.0
                    for c in cursors[: pivot + 1]:
                        score += float(self.impacts[c[2]][c[1]])
                    if score >= 1 - 1e-6:
                        out.append(item)
                    upto = item + 1
                else:
                    upto = item
            # move what is behind to the first item that can matter
            upto = max(upto, cursors[0][0] + 1) if upto <= cursors[0][0] else upto
            moved = []
            for c in cursors:
                if c[0] < upto:
                    d = self.docs[c[2]]
                    place = c[1] + int(np.searchsorted(d[c[1] :], upto))
                    if place >= len(d):
                        continue
                    c = [int(d[place]), place, c[2]]
                moved.append(c)
            cursors = moved
        return out

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """Per text the items verified in some passage, each with its greatest overlap, by item id."""
        out: list[dict[int, dict]] = [{} for _ in texts]
        coded = [np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int32, len(w)) for w in map(terms, texts)]
        starts = np.cumsum([0, *map(len, coded)])
        every = np.concatenate(coded) if coded else np.zeros(0, np.int32)
        half = self.half
        # each term lies in the passage that begins in its own half and in the one before
        n_half = [max(1, -(-len(c) // half)) for c in coded]
        first = np.cumsum([0, *n_half])
        text_of = np.repeat(np.arange(len(texts)), np.diff(starts))
        at = np.arange(len(every)) - starts[text_of] if len(every) else every
        known = np.flatnonzero(every >= 0)
        if not len(known):
            return [[] for _ in texts]
        h = first[text_of[known]] + at[known] // half
        t = every[known].astype(np.int64)
        size = len(self.vocabulary)
        second = at[known] >= half
        keys = np.unique(np.concatenate([h * size + t, (h[second] - 1) * size + t[second]]))
        passage, term = keys // size, keys % size
        heads = np.flatnonzero(np.diff(passage, prepend=-1))
        live = np.add.reduceat(self.most[term], heads) >= 1 - 1e-6
        ends = np.append(heads[1:], len(keys))
        text_at = np.repeat(np.arange(len(texts)), n_half)
        for i in np.flatnonzero(live):
            query = term[heads[i] : ends[i]]
            if (self.grid[query].sum(axis=0) < 1 - 1e-4).all():
                continue
            found = self.above(query.tolist())
            if not found:
                continue
            p = int(passage[heads[i]])
            n = int(text_at[p])
            ids = coded[n][(p - first[n]) * half : (p - first[n] + 2) * half].tolist()
            here, words = shingles(ids), set(ids)
            for item in found:
                whole = self.shingles[item]
                if len(next(iter(whole))) < SHINGLE:  # a short item is one shingle of its own length
                    k = len(next(iter(whole)))
                    share = float(any(tuple(ids[j : j + k]) in whole for j in range(len(ids) - k + 1)))
                else:
                    share = len(whole & here) / len(whole)
                q, a = (len(side & words) / len(side) for side in self.sides[item])
                if share >= LEAST and q >= LEAST_WORDS and a >= LEAST_WORDS and share > out[n].get(item, {"overlap": 0})["overlap"]:
                    out[n][item] = {"item_id": self.items[item], "overlap": share, "question": q, "answer": a}
        return [[d[i] for i in sorted(d)] for d in out]


def _leaked(index):
    """The search of an index, a broadcast, as a function of text columns."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("overlap", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))

    @arrow_udf(LEAKS)
    def leaked(texts: pa.Array) -> pa.Array:
        out = pa.array(index.value.leaks([t.as_py() for t in texts]), kind)
        common.release()
        return out

    return leaked


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "item_id", item_text: str = "text", text_col: str = "text", out: str = "leaks") -> DataFrame:
    """Add ``out`` to every row of ``docs``: the items leaked into its text, in order of item id (item_id, overlap, question, answer).

    A leak holds, in one passage, LEAST of the item's distinct shingles and LEAST_WORDS of the distinct words
    of its question and of its answer. Ids are whole numbers. Items with another or a null id, or a null text or one without words, match nothing; items with
    the same id are each searched for. Null and empty texts leak nothing. Rows, order and other
    columns stay; an input column named ``out`` is replaced.
    """
    spark = docs.sparkSession
    common.tune(spark)
    sound = items.where(F.col(id_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(id_col).try_cast("long").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL")
    n_indexes = max(1, -(-sound.count() // ITEMS_AN_INDEX))
    if n_indexes == 1:
        sent = spark.sparkContext.broadcast(_index(sound))
        return docs.withColumn(out, _leaked(sent)(F.col(text_col)))
    # index after index over the distinct texts, so that one is alive at a time; what it finds goes to a table by text
    sound = common.materialize(sound.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(n_indexes)).cast("int")), "items")
    texts = docs.select(common.text_key(F.col(text_col)).alias("k"), F.col(text_col).alias("t"))
    found = None
    for part in range(n_indexes):
        sent = spark.sparkContext.broadcast(_index(sound.where(F.col("part") == part)))
        hits = texts.select("k", _leaked(sent)("t").alias("l")).where(F.size("l") > 0).dropDuplicates(["k"])
        hits = common.materialize(hits, "leaks")
        sent.destroy()
        found = hits if found is None else found.unionByName(hits)
    every = common.materialize(found.groupBy("k").agg(F.array_sort(F.flatten(F.collect_list("l"))).alias("l")), "leaks")  # a list an index
    mark = "_leak"
    while any(c.lower().startswith(mark) for c in docs.columns):  # a name that no input column has
        mark = f"_{mark}"
    rows = docs.withColumn(f"{mark}_text", common.text_key(F.col(text_col))).join(every.select(F.col("k").alias(f"{mark}_k"), F.col("l").alias(f"{mark}_l")), F.col(f"{mark}_text") == F.col(f"{mark}_k"), "left")
    return rows.withColumn(out, F.coalesce(f"{mark}_l", F.array().cast(LEAKS))).drop(f"{mark}_text", f"{mark}_k", f"{mark}_l")


def _index(items: DataFrame) -> Index:
    """The index of about ITEMS_AN_INDEX items, which reach the driver for it."""
    return Index([(r["i"], r["t"]) for r in items.select("i", "t").collect()])
