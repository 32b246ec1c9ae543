"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines decides where a chunk
ends, so an inserted line moves only the boundaries next to it. Multi-line
chunks that occur again are removed but for their first occurrence in the
order of document id. Chunks are grouped by their very bytes: equal hashes
alone remove nothing.

``dedup_runs`` goes on from the chunks to the ends of what repeats: a chunk with the line behind it
stands for all its occurrences, so repeated passages collapse to one copy first; the windows of MIN_LINES lines in
what is left, again grouped by their bytes, tell which lines repeat across chunk borders. Every run of MIN_LINES lines
or more that came before is removed whole, wherever its chunks end.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from . import common

#: Lines under the rolling hash; a chunk ends after a line in DIVISOR, on average; fewer lines than MIN_LINES are never removed.
WINDOW, DIVISOR, MIN_LINES = 2, 4, 2
_MULTIPLIER, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def chunk_spans(lines: list[str], window: int = WINDOW, divisor: int = DIVISOR) -> list[tuple[int, int]]:
    """Spans [from, to) of the chunks of a list of lines. The rolling hash is a polynomial in the line hashes of the last ``window`` lines; only full windows end a chunk."""
    spans, start, rolled = [], 0, 0
    gone = pow(_MULTIPLIER, window, 1 << 64)
    hashes: list[int] = []
    for i, line in enumerate(lines):
        hashes.append(xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")))
        rolled = (rolled * _MULTIPLIER + hashes[i] - (hashes[i - window] * gone if i >= window else 0)) & _MASK
        if i + 1 >= window and (rolled >> 40) % divisor == 0:
            spans.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        spans.append((start, len(lines)))
    return spans


_CHUNKS = T.ArrayType(T.StructType([T.StructField("no", T.IntegerType()), T.StructField("lines", T.IntegerType()), T.StructField("body", T.StringType())]))


@arrow_udf(_CHUNKS)
def _chunks(texts: pa.Array) -> pa.Array:
    """The chunks of MIN_LINES lines or more."""
    kind = pa.list_(pa.struct([("no", pa.int32()), ("lines", pa.int32()), ("body", pa.string())]))
    out = []
    for t in texts:
        lines = (t.as_py() or "").split("\n")
        out.append([(k, b - a, "\n".join(lines[a:b])) for k, (a, b) in enumerate(chunk_spans(lines)) if b - a >= MIN_LINES])
    found = pa.array([[{"no": k, "lines": n, "body": s} for k, n, s in row] for row in out], kind)
    del out
    common.release()
    return found


@arrow_udf(T.StringType())
def _without(texts: pa.Array, removed: pa.Array) -> pa.Array:
    """Each text without the chunks of the given numbers."""
    out = []
    for t, r in zip(texts, removed):
        text, gone = t.as_py(), set(r.as_py() or ())
        if gone:
            lines = text.split("\n")
            text = "\n".join(x for k, (a, b) in enumerate(chunk_spans(lines)) if k not in gone for x in lines[a:b])
        out.append(text)
    return pa.array(out, pa.string())


def _place(id_: Column, key: Column) -> Column:
    """A document's place in the order of ids, nulls last, then of texts."""
    return F.struct(id_.isNull().alias("none"), id_.alias("id"), key.alias("key"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, removed, removed_lines): per document (id and 64-bit text hash) that loses chunks, their numbers."""
    common.tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).where("instr(text, '\\n') > 0")
    found = rows.select("id", "key", F.explode(_chunks("text")).alias("c")).select("id", "key", "c.no", "c.lines", common.text_key(F.col("c.body")).alias("h"), F.col("c.body").alias("body"))
    first = F.min(F.struct(_place(F.col("id"), F.col("key")).alias("doc"), F.col("no")))
    # grouping by the body compares bytes; hot chunks shrink to a row a task before the shuffle
    repeated = found.groupBy("h", "body").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").select("h", F.col("first.doc").alias("doc"), F.col("first.no").alias("first_no"))
    repeated = common.materialize(repeated, "repeated-chunks")  # joined as a table, so that Spark can split a hot chunk's rows
    again = found.select("id", "key", "no", "lines", "h").join(repeated, "h")
    again = again.where(~((F.col("doc") == _place(F.col("id"), F.col("key"))) & (F.col("no") == F.col("first_no"))))
    # a document's own chunks: repeated rows give the same numbers, hence the set
    return again.groupBy("id", "key").agg(F.collect_set(F.struct("no", "lines")).alias("gone")).select("id", "key", F.col("gone.no").alias("removed"), F.aggregate("gone", F.lit(0), lambda n, g: n + g["lines"]).alias("removed_lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with text replaced by what is left and a column ``removed_lines`` (int).

    Lines end at ``\\n`` only; a chunk is removed if it has MIN_LINES lines or
    more and an equal chunk comes before it, in the order of ids (nulls last),
    then of text hashes, then of places in the text. Rows of one id and text count as one
    document and fare alike. A null text stays null, a text of one line stays as it is, a text of
    which nothing is left becomes empty. Column order and other columns stay; an input column named ``removed_lines`` is replaced.
    """
    return _applied(docs, removals(docs, id_col, text_col), _without, id_col, text_col)


def _applied(docs: DataFrame, removed: DataFrame, without: Callable[[Column, Column], Column], id_col: str, text_col: str) -> DataFrame:
    """``docs`` joined to its removals, with texts cut by ``without``."""
    mark = "_gone"
    while any(c.lower().startswith(mark) for c in docs.columns):  # a name that no input column has
        mark = f"_{mark}"
    gone = removed.select(*[F.col(c).alias(f"{mark}_{c}") for c in ("id", "key", "removed", "removed_lines")])
    rows = docs.withColumn(f"{mark}_text", F.xxhash64(text_col))
    rows = rows.join(gone, F.col(id_col).eqNullSafe(F.col(f"{mark}_id")) & (F.col(f"{mark}_text") == F.col(f"{mark}_key")), "left")
    changed = without(F.col(text_col), F.col(f"{mark}_removed"))
    rows = rows.withColumns({text_col: changed, "removed_lines": F.coalesce(f"{mark}_removed_lines", F.lit(0))})
    return rows.drop(f"{mark}_text", *[f"{mark}_{c}" for c in ("id", "key", "removed", "removed_lines")])


@arrow_udf(T.StringType())
def _without_lines(texts: pa.Array, removed: pa.Array) -> pa.Array:
    """Each text without the lines of the given numbers."""
    out = []
    for t, r in zip(texts, removed):
        text, gone = t.as_py(), set(r.as_py() or ())
        if gone:
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        out.append(text)
    return pa.array(out, pa.string())


@arrow_udf(_CHUNKS)
def _long_chunks(texts: pa.Array) -> pa.Array:
    """Every chunk with the MIN_LINES - 1 lines behind it; no is its first line's number."""
    kind = pa.list_(pa.struct([("no", pa.int32()), ("lines", pa.int32()), ("body", pa.string())]))
    out = []
    for t in texts:
        lines = (t.as_py() or "").split("\n")
        ends = [(a, min(b + MIN_LINES - 1, len(lines))) for a, b in chunk_spans(lines)]
        out.append([{"no": a, "lines": b - a, "body": "\n".join(lines[a:b])} for a, b in ends if b - a >= MIN_LINES])
    return pa.array(out, kind)


def run_removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, removed, removed_lines): per document (id and 64-bit text hash) that loses lines, their numbers.

    A run of MIN_LINES lines or more came before just if each window of MIN_LINES lines in it did, at least as many lines
    ahead where it is the same document; so windows stand for runs of all lengths. A window lies in the long chunk of its first line.
    """
    common.tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).where("instr(text, '\\n') > 0")
    found = rows.select("id", "key", F.explode(_long_chunks("text")).alias("c")).select("id", "key", "c.no", common.text_key(F.col("c.body")).alias("h"), F.col("c.body").alias("body"))
    # grouping by the body compares bytes; of all occurrences the first place stays
    first = F.min(F.struct(_place(F.col("id"), F.col("key")).alias("doc"), F.col("no")))
    lines = F.split("body", "\n", -1)
    windows = F.slice(lines, 1, F.size(lines) - (MIN_LINES - 1))
    for k in range(1, MIN_LINES):
        windows = F.zip_with(windows, F.slice(lines, k + 1, F.size(lines) - (MIN_LINES - 1)), lambda a, b: F.concat(a, F.lit("\n"), b))
    # a set of bodies under each digest compares bytes, and rows stay dealt out by digest: the bucketed table is joined below without moving bodies
    chunks = found.groupBy("h").agg(first.alias("first"), F.count("*").alias("n"), F.collect_set("body").alias("bodies"))
    chunks = chunks.select("h", "first", "n", F.explode("bodies").alias("body")).withColumn("digests", F.transform(windows, common.text_key))
    chunks = common.bucketed(chunks, "chunks", "h")

    spread = chunks.select("h", "first", "n", F.posexplode("digests").alias("k", "w"))
    earliest = F.min(F.struct(F.col("first.doc").alias("doc"), (F.col("first.no") + F.col("k")).alias("no"))).alias("first")
    # digests first: where one row has a window its bytes have been compared within its chunk; where several have it, only their chunks' bytes are read
    counted = spread.groupBy("w").agg(earliest, F.sum("n").alias("n"), F.count("*").alias("holders")).where("n > 1")
    counted = common.materialize(counted, "repeated-digests")
    sharing = spread.select("h", "w").join(counted.where("holders > 1").select("w"), "w", "left_semi").select("h").distinct()
    sharing = common.materialize(sharing, "sharing-chunks")
    shared = chunks.join(sharing, "h", "left_semi").select("first", "n", F.posexplode(windows).alias("k", "window"))
    shared = shared.groupBy(common.text_key(F.col("window")).alias("w"), "window").agg(earliest, F.sum("n").alias("n")).where("n > 1")
    repeated = counted.where("holders = 1").select("w", "first").unionByName(shared.select("w", "first")).select("w", F.col("first.doc").alias("doc"), F.col("first.no").alias("first_no"))
    repeated = common.materialize(repeated, "repeated-windows")  # joined as tables, so that Spark can split a hot window's and a hot chunk's rows
    marked = spread.select("h", "k", "w").join(repeated, "w").groupBy("h").agg(F.collect_set(F.struct("k", "doc", "first_no")).alias("marks"))  # of one chunk; both parts may name a window
    marked = common.materialize(marked, "marked-chunks")

    again = found.select("id", "key", "no", "h").join(marked, "h").withColumn("place", _place(F.col("id"), F.col("key")))
    starts = F.expr(f"transform(filter(marks, m -> NOT (m.doc = place AND no + m.k < m.first_no + {MIN_LINES})), m -> no + m.k)")
    gone = again.select("id", "key", starts.alias("starts")).where(F.size("starts") > 0).groupBy("id", "key").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + MIN_LINES - 1))))
    return gone.select("id", "key", covered.alias("removed")).withColumn("removed_lines", F.size("removed"))


def dedup_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with text replaced by what is left and a column ``removed_lines`` (int), as in ``dedup_lines``.

    A line goes if it lies in a run of MIN_LINES lines or more (blank ones count) of which an equal run comes before it: in an earlier
    document of the same order, or in the same one, ending where this run begins or sooner. Runs are those of the texts as given, so
    the first place of each line stays. Nulls, single lines, repeated rows and other columns fare as in ``dedup_lines``.
    """
    return _applied(docs, run_removals(docs, id_col, text_col), _without_lines, id_col, text_col)
