"""Filter interaction audit by the multilinear extension of the removal game.

A document's failures are a mask of filters. Of each part of the corpus only the counts by mask are kept: they make a
polynomial, linear in each filter's variable, whose value at a corner (1 for the filters that have run, 0 for the
others) is the number of documents removed by then. Its corners tell what every order of the filters keeps and removes
at each step; a filter's Shapley share is the integral of the polynomial's partial derivative along the diagonal,
by exact rationals.

One pass reads the texts; only rows of a digest, a mask and labels are shuffled, and identical
texts meet as partial counts. Texts count as identical when their whole SHA-256 digests are equal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"


class Removal:
    """The polynomial of a count by mask: the coefficient of a product of variables stands at the mask of its filters."""

    def __init__(self, counts: Sequence[int]) -> None:
        self.at = list(counts)
        n = len(self.at).bit_length() - 1
        for i in range(n):  # how many documents fail at least the filters of each mask
            for s in range(len(self.at)):
                if not s >> i & 1:
                    self.at[s] += self.at[s | 1 << i]
        # a document of failures m is removed with 1 - prod(1 - x_i, i in m)
        self.at = [0 if not s else v if s.bit_count() % 2 else -v for s, v in enumerate(self.at)]

    def corner(self, filters: int) -> int:
        """Its value where the filters of a mask have run: the sum of the coefficients of all products within it."""
        total, s = 0, filters
        while s:
            total += self.at[s]
            s = (s - 1) & filters
        return total

    def shapley(self, i: int) -> Fraction:
        """Integral from 0 to 1 of the derivative by variable i where all variables are equal: a product of k variables with i gives t**(k - 1), so 1 / k."""
        return sum((Fraction(v, s.bit_count()) for s, v in enumerate(self.at) if s >> i & 1), Fraction(0))


def audit_rows(counts: Sequence[int], good: Sequence[int], toxic: Sequence[int], filters: str = FILTERS) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of a part's counts by mask."""
    f, g, t = Removal(counts), Removal(good), Removal(toxic)
    n, every, orders = sum(counts), len(counts) - 1, factorial(len(filters))
    corners = [[p.corner(s) for s in range(len(counts))] for p in (f, g, t)]
    share = [int(f.shapley(i) * orders) for i in range(len(filters))]
    for order in permutations(range(len(filters))):
        ran = 0
        for step, i in enumerate(order, 1):
            after = ran | 1 << i
            removed, good_lost, toxic_lost = (c[after] - c[ran] for c in corners)
            fails, alone = corners[0][1 << i], corners[0][every] - corners[0][every & ~(1 << i)]
            yield "".join(filters[k] for k in order), step, n - corners[0][after], removed, fails - removed, alone, good_lost, toxic_lost, share[i]
            ran = after


def failures(text: Column) -> Column:
    """Bits of the four filters that look at a text alone (null counts as empty): A under 100 words, B under 80 of 100 words distinct, C over 10 of 100 code points A to Z, D any of #$%&*|."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", F.lit("")))
    tests = (n < 100, 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * F.length(t).cast("long"), t.rlike(r"[#$%&*|]"))
    return sum((test.cast("int") * (1 << i) for i, test in enumerate(tests)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str, id_col: str = "doc_id", text_col: str = "text", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failures, E (an identical text has a smaller id) among them.

    A null part or text counts as empty. A null id has no smaller one and is smaller than none; rows that repeat an id do not
    precede each other. Labels of an id that stand in several rows count by their greatest values, null ones as 0.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.encode(t, "UTF-8"), 256)).alias("_text"), failures(F.col(text_col)).alias("_mask"))
    known = labels.groupBy(F.col(id_col).alias("_id")).agg(*[(F.coalesce(F.max(c), F.lit(0)) == 1).alias(a) for c, a in ((good, "_good"), (toxic, "_toxic"))])
    no = F.lit(False)
    rows = rows.join(known, "_id", "left").withColumns({"_good": F.coalesce("_good", no), "_toxic": F.coalesce("_toxic", no)})
    kind = ["_text", "_mask", "part", "_good", "_toxic"]
    same = rows.groupBy("_id", *kind).agg(F.count("*").alias("_n"))  # rows that repeat an id; dealt out by id already, unless labels were broadcast
    first = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_n")))
    met = same.groupBy(*kind).agg(F.sum("_n").alias("_n"), F.sum(F.when(F.col("_id").isNull(), F.col("_n")).otherwise(0)).alias("_null"), first.alias("_first"))
    least = F.min("_first._id").over(Window.partitionBy("_text"))  # a row a part and label: identical texts met before
    kept = F.col("_null") + F.when(F.col("_first._id") == F.col("_least"), F.col("_first._n")).otherwise(0)
    met = met.withColumn("_least", least).withColumn("_kept", kept)
    either = F.explode(F.array(F.struct(F.col("_mask").alias("mask"), F.col("_kept").alias("n")), F.struct((F.col("_mask") + 16).alias("mask"), (F.col("_n") - F.col("_kept")).alias("n"))))
    flat = met.select("part", "_good", "_toxic", either.alias("_e")).select("part", "_good", "_toxic", "_e.*")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c[1:])
    return flat.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("_good"), count("_toxic"))


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a part, order of the five filters and step, with what that step keeps and removes (SCHEMA); an empty table of documents has no parts and gives none."""
    counts = mask_counts(docs, labels, part, id_col, text_col)
    size = 1 << len(FILTERS)
    by_mask = lambda c: F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(size)]).alias(c)
    parts = counts.groupBy("part").agg(*[by_mask(c) for c in ("n", "good", "toxic")])
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    names = [x.strip().split()[0] for x in SCHEMA.split(",")]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = [(r["part"], *row) for row in audit_rows(r["n"], r["good"], r["toxic"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return parts.mapInArrow(told, SCHEMA)
