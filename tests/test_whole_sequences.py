"""Sequence queries over whole texts, against plain Python on a text far longer than 60 letters."""

import random
from collections import Counter

from helixframe.plans import catalogue


def test_letters_after_the_sixtieth_count(spark, tmp_path):
    r = random.Random(5)
    texts = {i: "".join(r.choice("abcdefghijklmnopqrstuvwxyz A.\n") for _ in range(n)) for i, n in enumerate([0, 3, 61, 200, 4000])}
    spark.createDataFrame([(i, "en", t) for i, t in texts.items()], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seqs = {i: "".join("ACGT"[(ord(c) - 97) % 4] for c in t if "a" <= c <= "z") for i, t in texts.items()}
    run = lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()
    assert {x.kmer: x.n for x in run("kmer_counts")} == Counter(s[i : i + 4] for s in seqs.values() for i in range(len(s) - 3))
    assert {x.doc_id: x.rc for x in run("revcomp")} == {i: s[::-1].translate(str.maketrans("ACGT", "TGCA")) for i, s in seqs.items()}
    assert {x.doc_id: len(x.protein) for x in run("translate_codons")} == {i: len(s) // 3 for i, s in seqs.items()}
    assert {x.doc_id: (x.context, x.control) for x in run("hypermutation")} == {i: tuple(sum(s[k : k + 2] in pair for k in range(len(s))) for pair in (("GG", "GA"), ("GC", "GT"))) for i, s in seqs.items()}
    assert {(x.pos, x.letter): x.n for x in run("letter_coverage")} == Counter((k, c) for s in seqs.values() for k, c in enumerate(s))
