"""Block-gzip files: member borders anywhere, reads of few members, lines by key."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from helixframe.sources import block_gzip as B
from helixframe.sources import formats


def _lines(n, width, seed=1):
    r = random.Random(seed)
    return [(f"c{i * 5 // n}", i * 10, "\t".join([f"c{i * 5 // n}", str(i * 10), f"rs{i}", "A", "G", ".", "PASS", "é" * r.choice([1, width])])) for i in range(n)]


@pytest.mark.parametrize("block", [97, 1000, 65280])
def test_lines_over_members(spark, tmp_path, monkeypatch, block):
    rows = _lines(700, 300)
    # one file of foreign make: borders at any byte, a header, an empty member in between, no line end at the last line
    text = ("##head\n#CHROM\tPOS\n" + "\n".join(x[2] for x in rows)).encode()
    pieces = [text[i : i + block] for i in range(0, len(text), block)]
    data = b"".join(B.member(p) for p in pieces[:3]) + B.member(b"") + b"".join(B.member(p) for p in pieces[3:]) + B._END
    assert gzip.decompress(data) == text
    path = tmp_path / "one.gz"
    path.write_bytes(data)
    monkeypatch.setattr(B, "STRETCH", 3000)  # many tasks in one file
    got = B.line_index(spark, str(path)).orderBy("offset", "at").collect()
    assert [(x.key[0], int(x.key[1])) for x in got] == [(c, p) for c, p, _ in rows]
    index = B.block_index(B.line_index(spark, str(path)))
    every = B.read_blocks(index).collect()
    assert sorted(x.value for x in every) == sorted(x[2] for x in rows)


def test_region_reads_few_members(spark, tmp_path):
    rows = _lines(6000, 200)
    df = spark.createDataFrame(rows, "chr string, pos long, value string")
    files = B.write(df, f"file://{tmp_path}/out", ["chr", "pos"], "#CHROM\tPOS")
    assert files.agg(F.sum("lines")).first()[0] == 6000
    index = B.block_index(B.line_index(spark, [x.file for x in files.collect()])).cache()
    members = index.select("file", "offset").distinct().count()
    picked = B.in_region(index, "c2", 25000, 25500)
    read = B.read_blocks(picked).select("file", "offset").distinct().count()
    assert members >= 12 and read <= 2
    got = formats.vcf_region_of_blocks(index, "c2", 25000, 25500).collect()
    assert sorted(x.pos for x in got) == list(range(25000, 25500, 10))
    assert formats.vcf_region_of_blocks(index, "c9", 0, 10**9).count() == 0


def test_lookup_and_damage(spark, tmp_path):
    rows = [(i, f"k{i}\tvalue {i}") for i in range(2000)]
    files = B.write(spark.createDataFrame(rows, "k long, value string"), f"file://{tmp_path}/out", ["k"])
    index = B.line_index(spark, [x.file for x in files.collect()], (0,))
    keys = spark.createDataFrame([("k3",), ("k1999",), ("none",), ("k3",)], "key string")
    assert sorted(x.value for x in B.lookup(index, keys, "key").collect()) == ["k1999\tvalue 1999", "k3\tvalue 3"]
    bad = bytearray(B.member(b"some text\n" * 50) + B._END)
    bad[24] ^= 255
    (tmp_path / "bad.gz").write_bytes(bytes(bad))
    with pytest.raises(Exception, match="damaged|invalid|incorrect"):
        B.line_index(spark, str(tmp_path / "bad.gz")).collect()
    empty = B.write(spark.createDataFrame([], "k long, value string"), f"file://{tmp_path}/none", ["k"])
    assert empty.count() == 0
