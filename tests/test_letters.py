"""Letter-wise work on long and odd sequences against plain Python."""

import collections
import random

from pyspark.sql import functions as F

from helixframe.functions import sequence
from helixframe.operators import alignment


def test_translation_and_kmers(spark):
    r = random.Random(2)
    seqs = ["".join(r.choice("ACGTUacgtN-é😀") for _ in range(n)) for n in (0, 1, 2, 3, 4, 7, 50, 301)] + ["ACG" * 40_000, None, "---AC-ATG", "".join(r.choice("ACGT") for _ in range(5000))]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, seq string")
    code = {a + b + c: sequence.AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    want = lambda t: code.get(t.upper().replace("U", "T"), "-" if t == "---" else "X")
    for x in df.select("id", "seq", sequence.translate(F.col("seq")).alias("p")).collect():
        s = x.seq or ""
        assert x.p == "".join(want(s[i : i + 3]) for i in range(0, len(s) // 3 * 3, 3))
    for k in (1, 3, 4, 30):
        for x in df.select("seq", sequence.kmer_counts(F.col("seq"), k).alias("c")).collect():
            s = x.seq or ""
            assert {c.kmer: c.n for c in x.c} == collections.Counter(s[i : i + k] for i in range(len(s) - k + 1)) and len({c.kmer for c in x.c}) == len(x.c)


def test_column_counts(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.randint(0, 1), "".join(r.choice("acGT-é") for _ in range(r.randint(0, 30)))) for _ in range(200)] + [("a", 0, None), ("b", 1, "x" * 30_000)]
    df = spark.createDataFrame(rows, "g string, h int, s string").repartition(3)
    for by in (["g", "h"], ["g"], []):
        want = collections.Counter()
        for g, h, s in rows:
            for i, c in enumerate(s or ""):
                want[(*[{"g": g, "h": h}[k] for k in by], i, c.upper())] += 1
        got = {tuple(x[:-1]): x.n for x in alignment.column_counts(df, by, "s").select(*by, "pos", "letter", "n").collect()}
        assert got == want
    assert alignment.column_counts(df.limit(0), ["g"], "s").count() == 0


def test_long_back_alignment(spark):
    r = random.Random(4)
    dna = "".join(r.choice("ACGT") for _ in range(60_000))
    protein = sequence.amino_letters(dna[1:])
    df = spark.createDataFrame([(protein[:50] + "-" + protein[50:], dna), (None, "ACG"), ("MK-", "ATG"), ("", "ACG")], "p string, d string")
    got = [x[0] for x in df.select(alignment.back_aligned(F.col("p"), F.col("d"))).collect()]
    assert got[0] == dna[1:151] + "---" + dna[151 : 1 + 3 * len(protein)] and got[1:] == [None, "ATGNNN---", ""]


def test_hypermutation(spark):
    rows = [("GGTGATGCAGCC", "AGTAATACAGCC"), ("GAC", "AAC"), ("GA", "AA"), ("", ""), (None, "A"), ("GGG", "AG")]
    got = [x[0] for x in spark.createDataFrame(rows, "r string, s string").select(alignment.hypermutation(F.col("r"), F.col("s"))).collect()]
    import re

    for (r, s), x in zip(rows, got):
        if r is None or len(r) != len(s):
            assert x is None
            continue
        want = [0, 0, 0, 0]
        for i in range(len(r) - 2):
            a, b = r[i : i + 3], s[i : i + 3]
            for k, pattern in ((0, "G[AG][^C]"), (2, "G(([CT][ACGT])|([AG]C))")):
                if re.fullmatch(pattern, a):
                    want[k] += b == "A" + a[1:]
                    want[k + 1] += b in (a, "A" + a[1:])
        assert list(x) == want


def test_ambiguous_codons(spark):
    rows = [("ATG",), ("TTY",), ("ATN",), ("ata",), ("AUG",), ("NNN",), ("TA",), ("A?G",), (None,), ("MGR",)]
    df = spark.createDataFrame(rows, "c string").withColumn("p", sequence.possible_amino_acids("c"))
    got = {x.c: (x.p, x.a) for x in df.select("c", "p", sequence.ambiguous_amino_acid(F.col("p")).alias("a")).collect()}
    assert got["ATG"] == (["M"], "M") and got["TTY"] == (["F"], "F") and got["ATN"] == (["I", "M"], "X") and got["ata"] == (["I"], "I") and got["AUG"] == (["M"], "M")
    assert got["TA"] == (["X"], "X") and got["A?G"] == (None, None) and got[None] == (None, None) and got["MGR"] == (["R"], "R") and len(got["NNN"][0]) == 21
