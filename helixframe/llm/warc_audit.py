"""WARC records and a Merkle fixity audit between replicas.

Every record is hashed where it is read and has a place: a file, an offset and
a length. Leaves are ordered offset ranges of CELL bytes of a file: each digests the
offsets, lengths and hashes of the records that begin in it, in order. FANOUT neighbouring ranges make up their
parent, up to one hash a file; files meet in a fixed number of buckets, and FANOUT buckets
in their parent, up to one root. A row of a level holds the hashes of both replicas. The roots are compared first, and
at each level below only children of differing parents are looked at; records are compared in the
differing ranges alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

#: Children of a node, bytes of a leaf's range, buckets of files (a power of FANOUT), record ids to a file of ``placed``, files for rows without an id.
FANOUT, CELL, BUCKETS, FILE_SLOTS, NULL_FILES = 16, 1 << 16, 16**2, 4096, 4096


def warc_record(record_id: Column, url: Column, body: Column) -> Column:
    """A WARC/1.1 response record as a string of the given fields; nulls count as empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), text(record_id), F.lit(">\r\nWARC-Target-URI: "), text(url),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(text(body)).cast("string"), F.lit("\r\n\r\n"), text(body), F.lit("\r\n\r\n"),
    )


def hashed(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", **also: Column) -> DataFrame:
    """(id, length, sha256) of every page's record, and a column more for each of ``also``. Ids that are null or no whole numbers become -1."""
    record = warc_record(F.col(id_col), F.col(url), F.col(html))
    rows = pages.select(F.coalesce(F.col(id_col).try_cast("long"), F.lit(-1)).alias("id"), record.alias("record"), *[c.alias(k) for k, c in also.items()])
    return rows.select("id", F.octet_length("record").cast("long").alias("length"), sha256(F.col("record")).alias("sha256"), *also)


def sha256(record: Column) -> Column:
    return F.sha2(F.encode(record, "UTF-8"), 256)


def placed(records: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Distinct records with copies, file_id and byte offset there, as a writer lays them out.

    A file takes FILE_SLOTS ids, in order of id and hash; copies stand side by side and share a row, with the offset of the
    first. Records of id -1 are dealt to NULL_FILES files of their own by hash. ``carried``: columns that depend on the record alone.
    """
    rows = records.groupBy("id", "sha256", "length").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in carried])
    nowhere = -1 - F.pmod(F.xxhash64("sha256"), F.lit(NULL_FILES))
    rows = rows.withColumn("file_id", F.when(F.col("id") == -1, nowhere).otherwise(F.floor(F.col("id") / FILE_SLOTS)))
    before = Window.partitionBy("file_id").orderBy("id", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)).cast("long"))


def _digest(parts: Column) -> Column:
    """Hash of an ordered list of strings; null for an empty one."""
    return F.when(F.size(parts) > 0, F.sha2(F.array_join(parts, ","), 256))


def _cell() -> Column:
    return F.floor(F.col("offset") / CELL).alias("n")


def levels(primary: DataFrame, replica: DataFrame) -> list[tuple[DataFrame, list[Column]]]:
    """The tree's levels, leaves first, each with the columns of its parents' keys: (file, n, h0, h1), a null hash where a replica has nothing."""
    sides = primary.withColumn("side", F.lit(0)).unionByName(replica.withColumn("side", F.lit(1)))
    # a leaf holds CELL / 100 records at most, a node FANOUT children
    told = F.struct("offset", F.concat_ws(":", "offset", "length", "copies", F.coalesce(F.col("id").cast("string"), F.lit("")), "sha256").alias("record"))
    sums = [_digest(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == k, told))), lambda r: r["record"])).alias(f"h{k}") for k in (0, 1)]
    leaf = sides.groupBy(F.col("file_id").cast("string").alias("file"), _cell()).agg(*sums)
    out: list[tuple[DataFrame, list[Column]]] = []
    up = [F.col("file"), F.floor(F.col("n") / FANOUT).alias("n")]
    now = common.materialize(leaf, "merkle-0")
    highest = now.agg(F.max("n")).first()[0]

    def above(keys: list[Column]) -> None:
        nonlocal now
        children = F.sort_array(F.collect_list(F.struct("file", "n", "h0", "h1")))
        sums = [_digest(F.expr(f"transform(filter(c, x -> x.h{k} IS NOT NULL), x -> concat_ws('=', x.file, x.n, x.h{k}))")).alias(f"h{k}") for k in (0, 1)]
        out.append((now, keys))
        now = common.materialize(now.groupBy(*keys).agg(children.alias("c")).select("file", "n", *sums), f"merkle-{len(out)}")

    while highest and highest > 0:
        above(up)
        highest //= FANOUT
    above([F.lit("").alias("file"), F.pmod(F.xxhash64("file"), F.lit(BUCKETS)).alias("n")])
    width = BUCKETS
    while width > 1:
        above(up)
        width //= FANOUT
    return [*out, (now, [])]


def differing(tree: list[tuple[DataFrame, list[Column]]]) -> DataFrame:
    """Leaves (file, n) whose hashes differ between the replicas or that only one has, found by descent from the root."""
    bad = None
    for level, keys in reversed(tree):
        if bad is not None:
            found = bad.select(F.col("file").alias("_file"), F.col("n").alias("_n"))
            level = level.withColumns({"_file": keys[0], "_n": keys[1]}).join(found, ["_file", "_n"], "left_semi")
        bad = common.materialize(level.where(~F.col("h0").eqNullSafe(F.col("h1"))).select("file", "n"), "merkle-bad")
    return bad


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of ``primary`` with its status in ``replica``; both as from ``placed`` or ``warc_files``: id, file_id, offset, length, sha256, copies.

    status: ``intact``; ``moved`` if the replica's file holds the record at another offset only; ``corrupt``
    if it holds something else at the offset (or another number of copies); ``missing`` if it holds nothing there. Records of
    the replica at offsets where the primary has none, and not moved ones, are returned with their place and status ``extra``. Two records at
    one offset of a file are compared by hash. Null ids are allowed; files are matched by file_id. An empty replica
    gives missing rows only, an empty primary extra ones, two empty ones no rows. Other columns are ignored.
    """
    names = ["id", "file_id", "offset", "length", "sha256", "copies"]
    primary, replica = common.materialize(primary.select(*names), "records"), common.materialize(replica.select(*names), "replica")
    bad = differing(levels(primary, replica)).withColumn("bad", F.lit(True))
    at = lambda df: df.withColumn("file", F.col("file_id").cast("string")).withColumn("n", _cell())
    ours = at(primary).join(bad, ["file", "n"], "left")
    theirs = common.materialize(at(replica).join(bad.drop("bad"), ["file", "n"], "left_semi").select(*names), "replica-bad")
    here = ours.where("bad").select(*names)
    # what both hold at one place; then what stands elsewhere in the file
    same = theirs.groupBy("file_id", "offset", "sha256").agg(F.max("copies").alias("c"), F.max("length").alias("l")).withColumn("same", F.lit(True))
    there = theirs.select("file_id", "offset").distinct().withColumn("there", F.lit(True))
    elsewhere = theirs.select("file_id", "sha256").distinct().withColumn("elsewhere", F.lit(True))
    met = here.join(same, ["file_id", "offset", "sha256"], "left").join(there, ["file_id", "offset"], "left").join(elsewhere, ["file_id", "sha256"], "left")
    status = F.when(F.col("same") & (F.col("c") == F.col("copies")) & (F.col("l") == F.col("length")), "intact").when(F.col("same"), "corrupt").when(F.col("elsewhere"), "moved").when(F.col("there"), "corrupt").otherwise("missing")
    known = here.select("file_id", "offset").distinct()
    extra = theirs.join(known, ["file_id", "offset"], "left_anti").join(here.select("file_id", "sha256").distinct(), ["file_id", "sha256"], "left_anti")
    out = ours.where("bad IS NULL").select(*names, F.lit("intact").alias("status")).unionByName(met.select(*names, status.alias("status")))
    return out.unionByName(extra.select(*names, F.lit("extra").alias("status")))


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or of gzip members: offset and length in the file, headers (lower-case names), body and sha256 of the record's plain bytes. What cannot be read is skipped up to the next record that can; a member is inflated by itself."""
    at, mark = 0, _MEMBER if data.startswith(_MEMBER) else b"WARC/"
    while at < len(data):
        if data.startswith(_MEMBER, at):
            plain, end = _inflated(data, at)
            inside, whole = 0, end > 0
            while whole and (found := _record(plain, inside)) is not None:  # as a rule one
                yield {"offset": at, "length": end - at, **found[0]}
                inside = found[1]
            if whole:
                at = end
                continue
        elif (found := _record(data, at)) is not None:
            yield {"offset": at, "length": found[1] - at, **found[0]}
            at = found[1]
            continue
        ahead = data.find(mark, at + 1)
        at = ahead if ahead >= 0 else len(data)


_MEMBER = b"\x1f\x8b\x08"


def _inflated(data: bytes, at: int) -> tuple[bytes, int]:
    """A gzip member's plain bytes and its end, which is 0 for a broken one."""
    member, parts = zlib.decompressobj(31), []
    while at < len(data) and not member.eof:
        piece = data[at : at + (1 << 16)]
        try:
            parts.append(member.decompress(piece))
        except zlib.error:
            return b"", 0
        at += len(piece)
    return b"".join(parts), at - len(member.unused_data) if member.eof else 0


def _record(data: bytes, at: int) -> tuple[dict, int] | None:
    """A plain record's fields and its end, blank lines behind it included."""
    head = data.find(b"\r\n\r\n", at) if data.startswith(b"WARC/", at) else -1
    if head < 0:
        return None
    lines = data[at:head].decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = headers.get("content-length", "")
    if not size.isdigit() or (end := head + 8 + int(size)) > len(data):
        return None
    return {"headers": headers, "body": data[head + 4 : end - 4], "sha256": hashlib.sha256(data[at:end]).hexdigest()}, end


def warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at ``path``: file_id (the file's name), offset, length, id (WARC-Record-ID), type, url, body, sha256, copies (1).

    Files are read whole, one to a task, so a file has to fit a worker's memory and Spark's 2 GB a value; WARC files are
    customarily of 1 GB. Empty files and broken stretches give no records.
    """
    schema = "file_id string, offset long, length long, id string, type string, url string, body binary, sha256 string, copies long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for r in parse_warc(content.as_py()):
                    h = r["headers"]
                    rows.append((name, r["offset"], r["length"], h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), r["body"], r["sha256"], 1))
                    held += len(r["body"])
                    if held > 4 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    common.tune(spark)
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInArrow(run, schema)
