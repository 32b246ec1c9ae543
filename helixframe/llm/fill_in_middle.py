"""Fill-in-middle transformation on ropes.

A text becomes a rope: a balanced tree whose leaves hold runs of whole units and cache how many
units and code points they have. Two splits by unit rank part it into prefix, middle and suffix without
copying what lies between the cuts; the rearranged text is a concatenation of those subtrees with sentinel
leaves, and its inverse splits the output's rope at the sentinels' code-point ranks.

A unit is a word with the white space before it, or white space that no word follows. Which texts are turned, where they
are cut and in which form depends on a seed and the row's id alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from . import common

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
#: Units a leaf, at most.
LEAF_UNITS = 64
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (``text``) or two ropes one after the other."""

    units: int
    chars: int
    height: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0, 0)


def leaf(text: str, units: int) -> Rope:
    return Rope(units, len(text), 0, text) if text else EMPTY


def build(text: str) -> Rope:
    """The rope of a text: leaves of LEAF_UNITS units, paired up level by level."""
    row, begin, n = [], 0, 0
    for m in UNIT.finditer(text):
        n += 1
        if n == LEAF_UNITS:
            row.append(leaf(text[begin : m.end()], n))
            begin, n = m.end(), 0
    if n:
        row.append(leaf(text[begin:], n))
    while len(row) > 1:
        row = [_node(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0] if row else EMPTY


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.chars + b.chars, 1 + max(a.height, b.height), "", a, b)


def _balanced(a: Rope, b: Rope) -> Rope:
    """A node of two ropes whose heights differ by two at most, turned so that no side is over one higher."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return _node(a.left, _node(a.right, b))
        return _node(_node(a.left, a.right.left), _node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return _node(_node(a, b.left), b.right)
        return _node(_node(a, b.left.left), _node(b.left.right, b.right))
    return _node(a, b)


def concat(a: Rope, b: Rope) -> Rope:
    """One rope after the other: the lower one is hung in along the higher one's edge, in steps as many as their heights differ."""
    if not a.chars or not b.chars:
        return a if a.chars else b
    if a.height > b.height + 1:
        return _balanced(a.left, concat(a.right, b))
    if b.height > a.height + 1:
        return _balanced(concat(a, b.left), b.right)
    return _node(a, b)


def split(rope: Rope, units: int) -> tuple[Rope, Rope]:
    """The first ``units`` units and the rest, down one path of the tree by the cached unit counts."""
    if units <= 0:
        return EMPTY, rope
    if units >= rope.units:
        return rope, EMPTY
    if rope.left is None:
        at = 0
        for k, m in enumerate(UNIT.finditer(rope.text), 1):
            if k == units:
                at = m.end()
                break
        return leaf(rope.text[:at], units), leaf(rope.text[at:], rope.units - units)
    if units < rope.left.units:
        a, b = split(rope.left, units)
        return a, concat(b, rope.right)
    a, b = split(rope.right, units - rope.left.units)
    return concat(rope.left, a), b


def split_chars(rope: Rope, chars: int) -> tuple[Rope, Rope]:
    """The first ``chars`` code points and the rest, by the cached counts. A cut inside a leaf leaves the unit counts of its parts to a recount."""
    if chars <= 0:
        return EMPTY, rope
    if chars >= rope.chars:
        return rope, EMPTY
    if rope.left is None:
        a, b = rope.text[:chars], rope.text[chars:]
        return leaf(a, sum(1 for _ in UNIT.finditer(a))), leaf(b, sum(1 for _ in UNIT.finditer(b)))
    if chars < rope.left.chars:
        a, b = split_chars(rope.left, chars)
        return a, concat(b, rope.right)
    a, b = split_chars(rope.right, chars - rope.left.chars)
    return concat(rope.left, a), b


def leaves(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        r = stack.pop()
        if r.left is None:
            yield r.text
        else:
            stack += [r.right, r.left]


def text_of(rope: Rope) -> str:
    return "".join(leaves(rope))


def arrange(text: str, first: int, second: int, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[str, int, int]:
    """(output, code points of the prefix, of the middle) of a text cut after ``first`` and ``second`` units."""
    prefix, rest = split(build(text), first)
    middle, suffix = split(rest, second - first)
    p, s, m = (leaf(x, 1) for x in sentinels)
    parts = (p, prefix, s, suffix, m, middle) if form == PSM else (s, suffix, p, prefix, m, middle)
    out = EMPTY
    for part in parts:
        out = concat(out, part)
    return text_of(out), prefix.chars, middle.chars


def restore(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that ``arrange`` was given, exactly, from its output and form."""
    if form == PLAIN:
        return output
    order = [0, 1, 2] if form == PSM else [1, 0, 2]
    at = [output.index(sentinels[i]) for i in order]
    parts, rope, done = {}, build(output), 0
    for k, i in enumerate(order):
        _, rope = split_chars(rope, at[k] + len(sentinels[i]) - done)
        done = at[k] + len(sentinels[i])
        end = at[k + 1] if k < 2 else len(output)
        parts[i], rope = split_chars(rope, end - done)
        done = end
    return text_of(concat(concat(parts[0], parts[2]), parts[1]))


def draws(seed: int, id_col: Column) -> Column:
    """Four unsigned 32-bit numbers of a row: the first four 8-digit groups of the SHA-256 of ``seed:id``; a null id counts as empty text."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), "UTF-8"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, sentinels: tuple[str, str, str] = SENTINELS, out: str = "fim") -> DataFrame:
    """Add ``out``: struct(n units, form, prefix_chars, middle_chars, output) to every row.

    ``rate`` of 100 texts are turned, ``spm_rate`` of 100 of these with the suffix first; a text that is empty (null counts as empty)
    or holds a sentinel stays as it is (form plain, code-point counts null). Repeated ids draw the same numbers; other columns stay.
    """
    common.tune(docs.sparkSession)
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    @arrow_udf(schema)
    def turned(texts: pa.Array, drawn: pa.Array) -> pa.Array:
        rows: list[list] = [[], [], [], [], []]
        for text, (h1, h2, h3, h4) in zip(texts, drawn.to_pylist()):
            text = text.as_py() or ""
            n = sum(1 for _ in UNIT.finditer(text))
            if not text or h3 % 100 >= rate or any(s in text for s in sentinels):
                row = n, PLAIN, None, None, text
            else:
                form = SPM if h4 % 100 < spm_rate else PSM
                got, prefix, middle = arrange(text, *sorted((h1 % (n + 1), h2 % (n + 1))), form, sentinels)
                row = n, form, prefix, middle, got
            for column, value in zip(rows, row):
                column.append(value)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], [f.name for f in schema])

    return docs.withColumn(out, turned(F.col(text_col), draws(seed, F.col(id_col))))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The texts before ``transform``, from its output and form alone (empty for those that were null)."""

    @arrow_udf(T.StringType())
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([restore(o.as_py(), f.as_py(), sentinels) for o, f in zip(outputs, forms)], pa.string())

    return back(output, form)
