import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from helixframe.llm import warc_audit as W

SCHEMA = "page_id long, url string, html string"


def test_audit(spark, monkeypatch):
    monkeypatch.setattr(W, "CELL", 700)  # several levels
    rows = [(i, f"http://x/{i}", "é" * (i % 50)) for i in range(6000)] + [(None, "u", "n"), (7, "again", None), (7, None, "z"), (9_000_000, None, ""), (-5, "neg", "x")] + [(42, "hot", "copy")] * 200
    a = W.placed(W.hashed(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as hash", "2 as node")))
    there = F.col("id")
    b = a.where(~there.isin(100, 5999)).withColumn("sha256", F.when(there == 3000, "changed").otherwise(F.col("sha256"))).withColumn("copies", F.when(F.length("sha256") * 0 + F.col("copies") == 200, 201).otherwise(F.col("copies")))
    b = b.withColumn("offset", F.when(there == 4095, F.col("offset") + 10_000_000).otherwise(F.col("offset")))
    b = b.unionByName(spark.createDataFrame([(8888, 2, 10**9, 5, "new", 1)], "id long, file_id long, offset long, length long, sha256 string, copies long"))
    got = W.audit(a, b).collect()
    status = {}
    for r in got:
        status.setdefault(r.status, set()).add(r.id)
    assert {k: v for k, v in status.items() if k != "intact"} == {"missing": {100, 5999}, "corrupt": {3000, 42}, "extra": {8888}, "moved": {4095}}
    assert sum(r.copies for r in got if r.status != "extra") == len(rows)
    by_file = {}
    for r in sorted((r for r in got if r.status != "extra"), key=lambda r: (r.file_id, r.offset)):
        assert by_file.get(r.file_id, 0) == r.offset
        by_file[r.file_id] = r.offset + r.length * r.copies
    assert W.audit(a, a).where("status <> 'intact'").count() == 0
    none = a.limit(0)
    assert W.audit(none, none).count() == 0
    assert {r.status for r in W.audit(a, none).collect()} == {"missing"}
    assert {r.status for r in W.audit(none, a).collect()} == {"extra"}


def test_null_ids_are_dealt_out(spark):
    files = W.placed(W.hashed(spark.createDataFrame([(None, "u", str(i)) for i in range(500)], SCHEMA))).groupBy("file_id").count().collect()
    assert len(files) > 300 and all(r.file_id < 0 for r in files)


@pytest.mark.parametrize("pack", [bytes, gzip.compress], ids=["plain", "gzip"])
def test_files(spark, tmp_path, pack):
    """Two folders of WARC files, one of them with a flipped byte, a cut-off tail and a lost file."""
    r = random.Random(8)
    pages = {(f, i): r.randbytes(r.choice([0, 5, 900, 70_000])) for f in range(3) for i in range(40)}
    places = {}
    for side in "ab":
        os.makedirs(tmp_path / side)
        for f in range(3 if side == "a" else 2):
            data = b""
            for i in range(40):
                body = pages[f, i]
                record = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{f}-{i}>\r\nWARC-Target-URI: http://{i}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
                packed = pack(record)
                places[f, i] = (len(data), len(packed))
                data += packed
            if side == "b" and f == 0:
                at = places[0, 11][0] + places[0, 11][1] // 2
                data = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
            if side == "b" and f == 1:
                data = data[: places[1, 38][0] + 9]
            (tmp_path / side / f"{f}.warc").write_bytes(data)
    a = W.warc_files(spark, str(tmp_path / "a"))
    found = {r.id: (r.file_id, r.offset, r.length, bytes(r.body)) for r in a.collect()}
    assert found == {f"<urn:{f}-{i}>": (f"{f}.warc", *places[f, i], b) for (f, i), b in pages.items()}
    got = {r.id: r.status for r in W.audit(a, W.warc_files(spark, str(tmp_path / "b"))).collect()}
    lost = {(1, 38), (1, 39), *((2, i) for i in range(40))}
    if pack is gzip.compress:
        lost.add((0, 11))  # the member cannot be inflated
    bad = {"missing": {f"<urn:{f}-{i}>" for f, i in lost}}
    assert {i for i, s in got.items() if s == "missing"} == bad["missing"]
    assert {i for i, s in got.items() if s == "corrupt"} == ({"<urn:0-11>"} if pack is bytes else set())


def test_records_round_trip(spark):
    pages = [(1, "http://a", "<p>é</p>"), (2, None, None), (3, "u", "x\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame(pages, SCHEMA)
    text = df.orderBy("page_id").select(W.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).collect()
    data = "".join(r.r for r in text).encode()
    found = list(W.parse_warc(b"noise" + data + b"WARC/1.1\r\nbroken"))
    assert [r["body"].decode() for r in found] == [h or "" for _, _, h in pages]
    assert [r["headers"]["warc-target-uri"] for r in found] == [u or "" for _, u, _ in pages]
    assert sum(r["length"] for r in found) == len(data)
