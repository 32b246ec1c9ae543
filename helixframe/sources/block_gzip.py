"""Block-gzip text: parallel writing, an index of line starts, reads of single blocks and lines.

A block-gzip file is a row of gzip members of at most 64 KB of text, each with its own size in its header, so a member can be
read by its offset alone. ``line_index`` splits even one large file: a task finds the first member of its stretch by the header's fixed
bytes and then follows the sizes. The index is a table of line starts (file, offset of the member, place in its text); summed up
by ``block_index`` it tells which members hold which stretch of a chromosome, and ``read_blocks`` reads only those. Lines may run over members.

Files are opened inside tasks by pyarrow's file systems; nothing is read or kept on the driver.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed values of the format: the start of a member's header up to its size field, and the empty member at a file's end.
_MAGIC = b"\x1f\x8b\x08\x04"
_EXTRA = b"BC\x02\x00"
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Text of a member, at most, and bytes of a file that one task looks through.
BLOCK, STRETCH = 65_280, 64 << 20
_HEAD = 18


def member(text: bytes, level: int = 6) -> bytes:
    """One gzip member that tells its own size."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    return _MAGIC + b"\0\0\0\0\0\xff\x06\0" + _EXTRA + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


def _size(head: bytes) -> int:
    """A member's size from its first 18 bytes, 0 if they are none."""
    return struct.unpack("<H", head[16:18])[0] + 1 if len(head) >= _HEAD and head[:4] == _MAGIC and head[12:16] == _EXTRA else 0


def _open(path: str) -> pa.NativeFile:
    uri = "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    system, name = pyarrow.fs.FileSystem.from_uri(uri)
    return system.open_input_file(name)


def _block(f: pa.NativeFile, at: int) -> tuple[int, bytes]:
    """(size in the file, text) of the member at an offset; size 0 at the file's end."""
    f.seek(at)
    head = f.read(_HEAD)
    if not head:
        return 0, b""
    size = _size(head)
    if not size:
        raise ValueError(f"no block-gzip member at offset {at}")
    body = f.read(size - _HEAD)
    text = zlib.decompress(body[:-8], -15)
    if zlib.crc32(text) != struct.unpack("<I", body[-8:-4])[0]:
        raise ValueError(f"damaged block-gzip member at offset {at}")
    return size, text


def _first(f: pa.NativeFile, begin: int, length: int) -> tuple[int, int]:
    """The first member at or after an offset, and the one before it (-1 at the file's start).

    Members from 128 KB before on are looked for by the header's fixed bytes. These may stand in packed text by chance, so a find counts only if
    sizes lead from it over the offset and through three more members, or to the file's end.
    """
    if begin == 0:
        return 0, -1
    start = max(0, begin - (128 << 10))
    f.seek(start)
    window = f.read(begin - start)
    at = -1
    while (at := window.find(_MAGIC, at + 1)) >= 0:
        here, before, first, further = start + at, -1, None, 0
        while here < length and further < 3:
            if here >= begin:
                first, further = here if first is None else first, further + 1
            f.seek(here)
            size = _size(f.read(_HEAD))
            if not size:
                break
            before, here = here if here < begin else before, here + size
        else:
            return (first if first is not None else here), before
    raise ValueError(f"no block-gzip members before offset {begin}")


def line_index(spark: SparkSession, path: str | Sequence[str], columns: Sequence[int] = (0, 1), separator: str = "\t", comment: str = "#") -> DataFrame:
    """A row a line: (file, offset of the member it starts in, size of that member, at: its place in the text, key: the given columns). Empty lines and comments have none."""
    files = spark.read.format("binaryFile").load([path] if isinstance(path, str) else list(path)).select("path", "length")  # content is not read
    stretches = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length"), F.lit(STRETCH).cast("long"))).alias("begin"))
    stretches = stretches.where("begin < length").repartition(F.col("path"), F.col("begin"))
    most, mark, sep = max(columns) + 1, comment.encode(), separator.encode()

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as f:
                    yield from _stretch(f, row["path"], row["begin"], row["length"])

    def _stretch(f: pa.NativeFile, path: str, begin: int, length: int) -> Iterator[pa.RecordBatch]:
        at, before = _first(f, begin, length)
        fresh = before < 0 or _ends_line(f, before)
        out: list[tuple] = []
        while at < min(begin + STRETCH, length):
            size, text = _block(f, at)
            place = 0 if fresh else text.find(b"\n") + 1 or len(text)
            more, ahead = text, at + size
            while place < len(text):
                stop = more.find(b"\n", place)
                # a key may reach into the next members
                while stop < 0 and more.count(sep, place) < most and ahead < length:
                    step, text_on = _block(f, ahead)
                    more, ahead = more + text_on, ahead + step
                    stop = more.find(b"\n", place)
                head = more[place : stop if stop >= 0 else len(more)]
                if head.strip() and not head.startswith(mark):
                    parts = head.rstrip(b"\r").split(sep, most)
                    out.append((path, at, size, place, [parts[c].decode("utf-8", "replace") if c < len(parts) else None for c in columns]))
                if stop < 0:
                    break
                place = stop + 1
            fresh = text.endswith(b"\n") or (fresh and not text)
            at += size
            if len(out) > 5000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def _ends_line(f: pa.NativeFile, at: int) -> bool:
        return _block(f, at)[1].endswith(b"\n")

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["file", "offset", "size", "at", "key"])

    return stretches.mapInArrow(starts, "file string, offset long, size long, at long, key array<string>")


def block_index(lines: DataFrame) -> DataFrame:
    """What each member holds, of a line index by (chromosome, position): (file, offset, at, chr, first, last, n), a row a member and chromosome."""
    rows = lines.select("file", "offset", "at", F.col("key")[0].alias("chr"), F.col("key")[1].cast("long").alias("pos"))
    return rows.groupBy("file", "offset", "chr").agg(F.min("at").alias("at"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))


def in_region(index: DataFrame, chromosome: str, start: int, end: int) -> DataFrame:
    """Members that hold lines of a chromosome with start <= position < end."""
    return index.where((F.col("chr") == chromosome) & (F.col("last") >= start) & (F.col("first") < end))


def _taken(rows: DataFrame, whole: bool) -> DataFrame:
    dealt = rows.repartitionByRange(F.col("file"), F.col("offset")).sortWithinPartitions("file", "offset", "at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, name, place, text, after = None, None, -1, b"", 0
        try:
            for batch in batches:
                out: list[tuple] = []
                for row in batch.to_pylist():
                    if row["file"] != name:
                        if f is not None:
                            f.close()
                        f, name, place = _open(row["file"]), row["file"], -1
                    if row["offset"] != place:
                        size, text = _block(f, row["offset"])
                        place, after = row["offset"], row["offset"] + size
                    at = row["at"]
                    while at < len(text):
                        stop, more, ahead = text.find(b"\n", at), text, after
                        while stop < 0:  # the line goes on in the next members
                            size, on = _block(f, ahead)
                            if not size:
                                break
                            more, ahead, stop = more + on, ahead + size, on.find(b"\n")
                            stop = stop + len(more) - len(on) if stop >= 0 else -1
                        line = more[at : stop if stop >= 0 else len(more)]
                        if line.strip():
                            out.append((name, place, line.rstrip(b"\r").decode("utf-8", "replace")))
                        at = stop + 1 if stop >= 0 else len(text)
                        if not whole:
                            break
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], ["file", "offset", "value"])
        finally:
            if f is not None:
                f.close()

    return dealt.select("file", "offset", "at").mapInArrow(read, "file string, offset long, value string")


def read_blocks(index: DataFrame) -> DataFrame:
    """(file, offset, value): the lines that start in the given members, each member read once."""
    return _taken(index.groupBy("file", "offset").agg(F.min("at").alias("at")), True)


def lookup(lines: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(file, offset, value): the lines whose first key column is in a table of keys, by their places in a line index."""
    return _taken(lines.join(keys.select(F.col(key).cast("string").alias("_k")).distinct(), F.col("key")[0] == F.col("_k"), "left_semi"), False)


def write(df: DataFrame, path: str, order: Sequence[str], header: str = "", value: str = "value") -> DataFrame:
    """Write lines in ranges of an order, a file a range, each with the header's lines first; returns what is in place, (file, lines, bytes), as a table that has run.

    A task that runs twice leaves a second file, which no row names; readers go by the rows.
    """
    from helixframe.session import stored

    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(value).alias("value"))
    head = header.encode() + b"\n" if header else b""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pyarrow.fs.FileSystem.from_uri(path)
        out, name, held, n, size = None, None, bytearray(head), 0, 0
        for batch in batches:
            if out is None and batch.num_rows:
                system.create_dir(folder, recursive=True)
                name = f"part-{uuid.uuid4().hex}.gz"
                out = system.open_output_stream(f"{folder}/{name}", compression=None)
            for line in batch.column(0).to_pylist():
                held += line.encode() + b"\n"
                n += 1
                while len(held) >= BLOCK:
                    size += out.write(member(bytes(held[:BLOCK])))
                    del held[:BLOCK]
        if out is not None:
            if held:
                size += out.write(member(bytes(held)))
            size += out.write(_END)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "lines", "bytes"])

    return stored(ordered.mapInArrow(pack, "file string, lines long, bytes long"), "files")
