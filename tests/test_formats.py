"""Readers and writers on tiny files written here."""

import gzip

import pytest
from pyspark.sql import functions as F

from helixframe.sources import formats, plink_bed, sinks


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        with (gzip.open(path, "wt") if name.endswith(".gz") else open(path, "w", newline="")) as f:
            f.write(text)
        return str(path)

    return write


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_delimited(spark, put):
    p = put("a.csv", 'k,v\r\n1,"a ""q"", b"\r\n2,"two\nlines"\r\n3,\r\n')
    assert rows(formats.delimited(spark, p), "k") == [("1", 'a "q", b'), ("2", "two\nlines"), ("3", None)]
    assert rows(formats.delimited(spark, p, key_in=("k", ["2"]))) == [("2", "two\nlines")]
    with pytest.raises(Exception):
        formats.delimited(spark, put("b.csv", "a,b\n1,2,3\n4\n"), schema="a int, b int").collect()
    assert rows(formats.whitespace_table(spark, put("w.txt", "  a  b\n\n 1 \t 2\n"))) == [("1", "2")]


def test_sequences(spark, put):
    p = put("x.fasta.gz", ">s1 first one\nACGT\nAC\n>s2\nGG\n\n>s3 x\r\nTT\r\n")
    assert rows(formats.fasta(spark, p), "id") == [("s1", "first one", "ACGTAC"), ("s2", "", "GG"), ("s3", "x", "TT")]
    assert rows(formats.fastq(spark, put("x.fastq", "@r1 a\nAC\n+\nII\n@r2\nGT\n+\n@I\n")), "id") == [("r1", "AC", "II"), ("r2", "GT", "@I")]


def test_tables(spark, put):
    assert rows(formats.gmt(spark, put("a.gmt", "S/1\td\tg1\tg2\nB\td\tg3\nB\td\tg4\n")), "set", "gene") == [("B", "g4"), ("S1", "g1"), ("S1", "g2")]
    assert rows(formats.bed(spark, put("a.bed", "1\t5\t9\tn\n2\t0\t4\t.\n3\t1\t2\n")), "chr") == [("1", 5, 9, "n"), ("2", 0, 4, "2:0-4"), ("3", 1, 2, "3:1-2")]
    assert rows(formats.bim(spark, put("a.bim", "1 rs1 0 100 A C\n")))[0] == ("1", "rs1", 0.0, 100, "A", "C")
    assert rows(formats.map_file(spark, put("a.map", "1 rs1 0.5 100\n1 rs2 200\n")), "snp") == [("1", "rs1", 0.5, 100), ("1", "rs2", None, 200)]
    assert rows(formats.fam(spark, put("a.fam", "f i 0 0 1 -9\nf j 0 0 0 2\n")), "iid") == [("f", "i", "0", "0", 1, None), ("f", "j", "0", "0", None, 2.0)]
    assert rows(formats.frequencies(spark, put("a.frq", " CHR SNP A1 A2 MAF NCHROBS\n 1 a A C 0.25 8\n 1 b A C NA 0\n"))) == [("1", "a", "A", "C", 0.25, 8)]
    assert rows(formats.covariates(spark, put("a.cov", "FID IID c1\nf i -9\nf j 1.5\n")), "IID") == [("f", "i", None), ("f", "j", 1.5)]
    assert rows(formats.grm_text(spark, put("a.grm", "1 1 5 0.9\n2 1 5 -0.7\n")), "i", "j") == [(1, 1, 5.0, 0.9), (1, 2, 5.0, -0.7), (2, 1, 5.0, -0.7)]
    a = put("a.assoc", "CHR SNP BP A1 BETA SE P\n1 1:77 . A 0.1 0.2 0.03\n. 2:88 x A 0 1 NA\n")
    assert rows(formats.association(spark, a).select("snp", "chr", "bp", "p")) == [("1:77", "1", 77, 0.03)]


def test_genotypes(spark, put):
    d = put("a.pdosage", "SNP A1 A2 f1 i1 f1 i2\nrs1 A C 0.5 -9\nrs2 G T 2 1\n")
    assert rows(formats.dosages(spark, d).select("snp", "iid", "dosage"), "snp", "iid") == [("rs1", "i1", 0.5), ("rs1", "i2", None), ("rs2", "i1", 2.0), ("rs2", "i2", 1.0)]
    with pytest.raises(Exception):
        formats.dosages(spark, put("b.pdosage", "SNP A1 A2 f1 i1\nrs1 A C 2.5\n")).collect()
    t = formats.tped(spark, put("a.tped", "1 rs1 0 10 0 0 A A A CC C C N A\n"))
    assert rows(t.select("a1", "a2", "ind", "dosage"), "ind") == [("A", "C", 0, None), ("A", "C", 1, 2.0), ("A", "C", 2, 1.0), ("A", "C", 3, 0.0), ("A", "C", 4, None)]
    g = formats.genotype_probabilities(spark, put("a.gprobs", "1 rs1 5 A C 0.25 0.5 0.25 1 0 0\n"))
    assert rows(g.select("ind", "dosage"), "ind") == [(0, 1.0), (1, 2.0)]


def test_plink_bed(spark, tmp_path):
    want = [[0.0, 1.0, 2.0, None, 1.0], [2.0, 2.0, None, 0.0, 0.0], [1.0] * 5]
    path = tmp_path / "a.bed"
    path.write_bytes(plink_bed.encode(want))
    spark.dataSource.register(plink_bed.PlinkBed)
    df = spark.read.format("plink_bed").option("individuals", 5).option("markers", 3).load(str(path))
    assert [list(r.dosages) for r in df.orderBy("marker").collect()] == want


def test_vcf(spark, put):
    v = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\nchr1\t10\trs\tA\tG,T\t50\tPASS\tAC=2;DB\tGT:DP\t0/1:3\t1|2:4\t./.:0\n1\t20\t.\tCTCC\tC\t.\tq10\t.\tGT\t1\t0/0\t1/1\n"
    path = put("a.vcf", v)
    df = formats.vcf(spark, path)
    first = df.where("pos = 10").first()
    assert first.info == {"AC": "2", "DB": "true"} and first.qual == 50.0 and formats.vcf_samples(spark, path) == ["s1", "s2", "s3"]
    assert rows(formats.vcf_dosages(df).where("pos = 10").select("alt", "sample", "dosage"), "alt", "sample") == [("G", 0, 1.0), ("G", 1, 1.0), ("G", 2, None), ("T", 0, 0.0), ("T", 1, 1.0), ("T", 2, None)]
    assert rows(formats.vcf_genotype_counts(df).select("pos", "homref", "het", "homvar", "nocall"), "pos") == [(10, 0, 2, 0, 1), (20, 1, 0, 2, 0)]
    assert rows(formats.vcf_sites_only(df)) == [("1", 10, ".", "A", "G,T")]
    assert rows(formats.vcf_region(df, "1", 20, 21).select("pos")) == [(20,)]
    assert rows(formats.minimal_sites(df), "pos", "alt")[-1] == ("1", 20, "CTCC", "C")


def test_features_and_reads(spark, put):
    g = formats.gtf(spark, put("a.gtf", '1\tsrc\texon\t11\t20\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\n1\tsrc\tCDS\t1\t2\t.\t+\t.\tgene_id "g1";\n'), "exon").first()
    assert (g.start, g.end, g.attributes["transcript_id"]) == (10, 20, "t1")
    s = formats.sam(spark, put("a.sam", "@HD\tVN:1\nr1\t16\t1\t6\t60\t5M2N3M\t*\t0\t0\tA\tI\tNH:i:2\nr2\t0\t1\t6\t60\t*\t*\t0\t0\tA\tI\n"))
    assert rows(s.select("name", "start", "end", "strand", "nh")) == [("r1", 5, 15, "-", 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGTACG", True, 1, None), ("b", "GG", False, 2, 0.5)], "id string, seq string, ok boolean, sex int, p double")
    sinks.fasta(df, f"{tmp_path}/f", "id", "seq", 3)
    assert rows(formats.fasta(spark, f"{tmp_path}/f").select("id", "seq"), "id") == [("a", "ACGTACG"), ("b", "GG")]
    sinks.formatted_table(df.select("id", "ok", "sex", "p"), f"{tmp_path}/t", "plink_covar", "sex")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect() if not r.value.startswith("id")) == ["a 2 1 -9", "b 1 2 0.5"]
    sinks.csv(df.select(F.lit('q"x,').alias("q")), f"{tmp_path}/c")
    assert formats.delimited(spark, f"{tmp_path}/c").first().q == 'q"x,'
    sinks.split_by_key(df.select("id", "sex"), f"{tmp_path}/k", "sex")
    assert {p.name for p in (tmp_path / "k").iterdir() if p.is_dir()} == {"sex=1", "sex=2"}
    assert sinks.significant(df, "p", 0.6).count() == 1 and sinks.significant(df, "p", 1).count() == 2
    call = df.limit(1).select(sinks.hard_calls(0.9, F.lit(1.95)).alias("c")).first().c
    assert (round(call.hom, 2), round(call.het, 2), call.call) == (0.95, 0.05, 2)


def test_fastq_in_splits_of_files(spark, tmp_path):
    """Records that splits of a file cut, carriage returns, an open last record: by line numbers, whatever the splits, and in time in proportion to the lines."""
    want = []
    for f, n in enumerate((1, 700, 3)):
        text = ""
        for i in range(n):
            want.append((f"f{f}r{i}", "ACGT"[: i % 5] + "A" * (i % 60), "@" + "I" * (i % 7)))
            text += f"@{want[-1][0]} lane\r\n{want[-1][1]}\n+\n{want[-1][2]}\r\n"
        (tmp_path / f"{f}.fastq").write_text(text + ("@open\nAC\n+\n" if f else ""), newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1001")
    try:
        got = formats.fastq(spark, str(tmp_path))
        assert formats.numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20
        assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
