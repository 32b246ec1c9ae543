from helixframe.sources import annotations as A, formats


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_blocks(spark, tmp_path):
    p = write(tmp_path, "a.maf", "##maf\na score=1\ns hg.1 5 4 + 100 AC-T\ns pt.1 7 4 - 90 acGA\n\na score=2\ns hg.1 9 2 + 100 AA\n")
    b = A.alignment_blocks(spark, p)
    assert [(r.source, r.start) for r in b.orderBy("start").collect()] == [("hg.1", 5), ("pt.1", 7), ("hg.1", 9)]
    assert [r.differences for r in A.block_differences(b).collect()] == [2]


def test_effects_and_counts(spark, tmp_path):
    v = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t5\t.\tA\tG,T\t.\tPASS\tEFF=STOP_GAINED(HIGH|x|c|p|9|G1),INTRON(LOW|||||G2);AC=2;AN=20\n1\t6\t.\tC\tG\t.\tPASS\tAC_Het=3;AC_Hom=1;AN_Adj=20\n1\t7\t.\tC\tG\t.\tPASS\tGTC=1,2,7\n"
    df = formats.vcf(spark, write(tmp_path, "a.vcf", v))
    e = A.effects(df)
    assert [tuple(r)[4:] for r in e.orderBy("gene").collect()] == [("STOP_GAINED", "HIGH", "G1"), ("INTRON", "LOW", "G2")]
    assert A.loss_of_function(e).count() == 1
    got = {r.pos: (round(r.homref, 6), round(r.het, 6), round(r.homvar, 6)) for r in A.allele_counts(df).collect()}
    assert got == {5: (8.1, 1.8, 0.1), 6: (6.0, 3.0, 1.0), 7: (7.0, 2.0, 1.0)}
    assert [(r.pos, r.alt, r.allele) for r in A.split_alleles(df).orderBy("pos", "allele").collect()][:2] == [(5, "G", 1), (5, "T", 2)]
    assert A.in_key_set(df, df.where("pos = 6")).count() == 1


def test_imputed(spark, tmp_path):
    p = write(tmp_path, "a.gprobs", "marker alleleA alleleB i1 i1 i1 i2 i2 i2\nrs1 A C 0.5 0.5 0 0 0 1\n")
    assert [tuple(r) for r in A.imputed_alleles(spark, p).orderBy("ind").collect()] == [("rs1", "A", "C", 0, 1.5), ("rs1", "A", "C", 1, 0.0)]
    df = spark.createDataFrame([("a", 0.9), (".", 0.95), ("b", 0.5)], "snp string, info double")
    assert [r.snp for r in A.keep_imputed(df).collect()] == ["a"]
