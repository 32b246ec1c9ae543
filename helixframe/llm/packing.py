"""Best-fit packing of documents into token sequences, planned on a length histogram.

Tokens are counted once and each piece of at most ``capacity`` tokens becomes a
small row. Only the histogram of piece lengths (``capacity`` rows at most)
reaches the driver; best-fit decreasing runs over its counts and yields
classes of equal sequences. Pieces are ranked within their length without any
global sort and take the planned slot of that rank.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common

#: Words whose token ids a worker remembers, at most.
CACHE_WORDS = 30_000
#: Texts of these characters only are cut into words by ``SPLIT``; all others go to the tokenizer whole.
PLAIN = re.compile("[\\n\\r\\t\x20-~À-ÖØ-öø-ÿ]*")
#: The vocabulary's published word pattern, for texts of PLAIN's characters.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def byte_tokens(path: str) -> dict[bytes, int]:
    """Token bytes to ids of a byte-level BPE file. Printable bytes stand for themselves there, the others for the characters from 256 on."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if all(c in of for c in token)}


class _Words(dict):
    """Token ids of a word as bytes, remembered; a full memory starts anew. New words are merged by the file's own ranks, which are its ids."""

    def __init__(self, path: str) -> None:
        import tiktoken

        super().__init__()
        self.merge = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=byte_tokens(path), special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self.merge(word)
        self[word] = data = _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else struct.pack(f"<{len(ids)}I", *ids)
        return data


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(32)]


class _Tokens:
    """What a worker keeps of a tokenizer file. The tokenizer itself is loaded when a text first needs it."""

    def __init__(self, path: str) -> None:
        self.path, self.words = path, _Words(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return Tokenizer.from_file(self.path)


_LOADED: dict[str, _Tokens] = {}


def _known(path: str) -> _Tokens:
    if path not in _LOADED:
        _LOADED[path] = _Tokens(path)
        common.release()  # what reading the file has taken
    return _LOADED[path]


def _tokenizer(path: str) -> tuple:
    known = _known(path)
    return known.whole, known.words, known.special


def token_bytes(text: str, path: str) -> bytes:
    """Token ids of a text as little-endian unsigned 32-bit numbers, exactly those of the tokenizer file."""
    known = _known(path)
    if PLAIN.fullmatch(text) and not any(s in text for s in known.special):
        return b"".join(map(known.words.__getitem__, SPLIT.findall(text)))
    import numpy as np

    return np.array(known.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) per piece; a longer document is cut into pieces of ``capacity`` with the remainder first."""
    common.tune(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long"
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0), batch.column(1)):
                data = token_bytes(text.as_py() or "", tokenizer_path) + end
                n = len(data) // 4
                at, k, first = 0, 0, n % capacity or min(n, capacity)
                while at < n:
                    size = capacity if k else first
                    for column, value in zip(out, (doc.as_py(), k, at, size, zlib.crc32(data[4 * at : 4 * (at + size)]))):
                        column.append(value)
                    at, k = at + size, k + 1
            types = pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        common.release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over counts: classes (number of sequences, [(length, how many of it), ...]).

    Lengths are placed in falling order, each into the sequence with the least
    room that still holds it; equal sequences stay one class, so the work
    depends on the number of lengths and not on the number of documents.
    """
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []

    def put(room: int, count: int, held: list[tuple[int, int]]) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((count, held))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        at = bisect_left(rooms, length)
        fresh: list[tuple[int, int, list[tuple[int, int]]]] = []
        while left and at < len(rooms):
            room = rooms[at]
            each = room // length
            while left and open_[room]:
                count, held = open_[room].pop()
                full = min(count, left // each)
                if full:
                    fresh.append((room - each * length, full, [*held, (length, each)]))
                    left -= full * each
                if full < count and left:
                    fresh.append((room - left * length, 1, [*held, (length, left)]))
                    left, full = 0, full + 1
                if full < count:
                    open_[room].append((count - full, held))
                    break
            if open_[room]:
                at += 1
            else:
                del open_[room]
                rooms.pop(at)
        each = capacity // length
        if left >= each:
            fresh.append((capacity - each * length, left // each, [(length, each)]))
        if left % each:
            fresh.append((capacity - left % each * length, 1, [(length, left % each)]))
        for f in fresh:
            put(*f)
    return [(count, held) for room in rooms for count, held in open_[room]]


def slots(classes: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, how many in one sequence, offset of the first) of the plan, ranks within length."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for count, held in classes:
        offset = 0
        for length, each in held:
            at = taken.get(length, 0)
            out.append((length, at, at + count * each, sequence, each, offset))
            taken[length] = at + count * each
            offset += length * each
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents; per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Null and repeated ids are packed
    like any other. Other columns are ignored. No documents give no rows.
    """
    spark = docs.sparkSession
    parts = 8 * common.partitions(spark)
    # a piece's part is written with it, by its row's number, so that equal rows are dealt out too
    dealt = pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col).withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
    cut = common.materialize(dealt, "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    planned = slots(plan(histogram, capacity))

    # rank within length: row number inside (length, part) plus the parts before it
    sizes = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = cut.withColumn("at", F.row_number().over(inside)).join(sizes, ["length", "part"]).withColumn("rank", F.col("before") + F.col("at") - 1)

    # the plan has a few thousand rows at most, whatever the number of documents
    table = spark.createDataFrame(pd.DataFrame(planned, columns=["length", "lo", "hi", "first", "each", "base"]), "length int, lo long, hi long, first long, each long, base long") if planned else spark.createDataFrame([], "length int, lo long, hi long, first long, each long, base long")
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(table["length"])
    return placed.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + (F.col("rank") - F.col("lo")) % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
