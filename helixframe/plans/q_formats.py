"""Queries: tables written out in each file format and read back by its reader.

Files go to the shared folder, one new path a call.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import sequence
from helixframe.operators import genotype, joins, sets
from helixframe.plans.q_genotype import _G, _N, dosages, nation_dosages
from helixframe.plans.q_multitest import pseudo_p
from helixframe.session import new_path, stored
from helixframe.sources import annotations, block_gzip, formats, sinks
from helixframe.sources.tables import table

#: A column an individual: the nations.
INDIVIDUALS = [str(i) for i in range(25)]


def _written(df, name, header=None):
    """Path of lines (a column ``value``) of ``df``."""
    path = new_path(df.sparkSession, name)
    sinks.text_lines(df.select("value"), path, header)
    return path


def _line(separator, *parts):
    return F.concat_ws(separator, *[p if not isinstance(p, str) else F.lit(p) for p in parts]).alias("value")


def _text(name):
    return F.col(name).cast("string")


def delimited_rows(spark, d):
    """Fields with quotes, separators and line ends; two segments are read."""
    note = F.concat(F.lit('"'), "c_name", F.lit('",\n'), "c_mktsegment")
    path = new_path(spark, "delimited")
    sinks.csv(table(spark, d, "customer").select("c_custkey", "c_mktsegment", note.alias("note"), "c_acctbal"), path)
    return formats.delimited(spark, path, schema="c_custkey long, c_mktsegment string, note string, c_acctbal double", key_in=("c_mktsegment", ["BUILDING", "MACHINERY"]))


def keyed_rows(spark, d):
    """The last row of a key in order."""
    path = new_path(spark, "keyed")
    sinks.csv(table(spark, d, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n")), path, "\t")
    return joins.last_per_key(formats.delimited(spark, path, separator="\t", schema="l_partkey long, n long"), ["l_partkey"], "n")


def whitespace_rows(spark, d):
    n = table(spark, d, "customer").select(F.concat(F.lit("  "), _text("c_custkey"), F.lit(" \t "), F.col("c_name"), F.lit("   "), _text("c_nationkey"), F.lit(" ")).alias("value"))
    got = formats.whitespace_table(spark, _written(n, "whitespace"), ["custkey", "name", "nation"])
    return got.select(F.col("custkey").cast("long").alias("custkey"), "name", F.col("nation").cast("int").alias("nation"))


def split_fields(spark, d):
    """Fields between single separators, empty ones too, and between runs."""
    text = F.concat(F.regexp_replace("p_name", " ", ";;"), F.lit(","), "p_brand", F.lit(";"))
    got = table(spark, d, "part").select("p_partkey", text.alias("t"))
    return got.select("p_partkey", F.array_join(formats.split_keep_empty(F.col("t"), ";,"), "|").alias("every"), F.array_join(formats.split_runs(F.col("t"), ";,"), "|").alias("runs"))


def fasta_records(spark, d):
    """All letters of every text, 60 to a line."""
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^a-z]", "").alias("seq"))
    path = new_path(spark, "fasta")
    sinks.fasta(docs, path, "doc_id", "seq", 60)
    return formats.fasta(spark, path).select(F.col("id").cast("long").alias("doc_id"), F.length("seq").cast("long").alias("length"), F.md5(F.col("seq").cast("binary")).alias("md5"))


def fastq_records(spark, d):
    letters = F.upper(F.regexp_replace("p_name", " ", ""))
    p = table(spark, d, "part").select(F.concat(F.lit("@r"), _text("p_partkey"), F.lit(" lane 1\n"), letters, F.lit("\n+\n@"), F.expr("repeat('I', length(p_name) - 2)")).alias("value"))
    return formats.fastq(spark, _written(p, "fastq"))


def gene_sets(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set(_text("l_partkey")).alias("genes"))
    return formats.gmt(spark, _written(by.select(F.concat_ws("\t", F.concat(F.lit("set/"), _text("l_suppkey")), F.lit("about"), F.col("genes")).alias("value")), "gmt"))


def bed_regions(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id") % 3
    name = F.when(k == 0, F.lit("\t.")).when(k == 1, F.concat(F.lit("\t"), "event_type")).otherwise("")
    return formats.bed(spark, _written(e.select(F.concat(_line("\t", _text("user_id"), _text("event_id"), (F.col("event_id") + 100).cast("string")), name).alias("value")), "bed"))


def _sites(spark, d):
    return table(spark, d, "part").select((F.col("p_partkey") % 22 + 1).cast("string").alias("chr"), F.concat(F.lit("rs"), "p_partkey").alias("snp"), (F.col("p_size") / 4).alias("cm"), (F.col("p_partkey") * 10).alias("bp"), F.lit("A").alias("a1"), F.lit("C").alias("a2"))


def marker_sites(spark, d):
    return formats.bim(spark, _written(sinks.bim_lines(_sites(spark, d)), "bim"))


def marker_map(spark, d):
    """Lines of four columns, every third of three."""
    s = _sites(spark, d)
    line = F.when(F.col("bp") % 3 == 0, _line(" ", F.col("chr"), F.col("snp"), _text("bp"))).otherwise(_line(" ", F.col("chr"), F.col("snp"), _text("cm"), _text("bp"))).alias("value")
    return formats.map_file(spark, _written(s.select(line), "map"))


def individuals(spark, d):
    """Sex 0 and phenotype -9 become null."""
    c = table(spark, d, "customer")
    phenotype = F.when(F.col("c_custkey") % 5 == 0, F.lit("-9")).otherwise(_text("c_acctbal"))
    got = formats.fam(spark, _written(c.select(_line(" ", F.concat(F.lit("f"), "c_nationkey"), _text("c_custkey"), "0", "0", (F.col("c_custkey") % 3).cast("string"), phenotype)), "fam"))
    return got.select("fid", "iid", "sex", "phenotype")


def allele_frequencies(spark, d):
    p = table(spark, d, "part")
    maf = F.when(F.col("p_partkey") % 7 == 0, F.lit("NA")).otherwise((F.col("p_size") / 128).cast("string"))
    return formats.frequencies(spark, _written(p.select(_line("  ", "", "1", F.concat(F.lit("rs"), "p_partkey"), "A", "C", maf, _text("p_size"))), "frq", "  CHR SNP A1 A2 MAF NCHROBS"))


def covariate_rows(spark, d):
    """A table in the covariate dialect, missing code -9, and back."""
    c = table(spark, d, "customer").select(F.concat(F.lit("f"), "c_nationkey").alias("FID"), _text("c_custkey").alias("IID"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal")).alias("c1"), (F.col("c_custkey") % 2 == 0).alias("c2"))
    path = new_path(spark, "covariates")
    sinks.formatted_table(c, path, "plink_covar")
    return formats.covariates(spark, path).select(F.col("FID").alias("fid"), F.col("IID").alias("iid"), "c1", "c2")


def _marked(spark, d):
    return nation_dosages(spark, d).select(F.concat(F.lit("m"), "marker").alias("snp"), F.lit("A").alias("a1"), F.lit("C").alias("a2"), "ind", "dosage", (F.col("marker") % 22 + 1).alias("chr"), (F.col("marker") * 100).alias("bp"))


def _dosage_file(spark, d):
    path = new_path(spark, "dosages")
    sinks.dosage_text(_marked(spark, d), path, "snp", "a1", "a2", "ind", "dosage", INDIVIDUALS)
    spark.createDataFrame([("SNP A1 A2 " + " ".join(f"f{i} {i}" for i in INDIVIDUALS),)], "value string").coalesce(1).write.mode("append").text(path)
    return path


def dosage_lines(spark, d):
    """Dosages of all line items as text, missing ones as -9, and back."""
    return formats.dosages(spark, _dosage_file(spark, d))


def dosages_with_places(spark, d):
    """Dosage text with its map and its individuals."""
    sites = _marked(spark, d).select("chr", "snp", "bp").distinct().select(_line(" ", _text("chr"), F.col("snp"), "0", _text("bp")))
    n = F.col("n_nationkey")
    people = table(spark, d, "nation").select(_line(" ", F.concat(F.lit("f"), n), n.cast("string"), "0", "0", (n % 3).cast("string"), "-9"))
    return formats.plink_dosage(spark, _dosage_file(spark, d), _written(sites, "map"), _written(people, "fam"))


def probability_lines(spark, d):
    """Dosages as three probabilities and back; missing ones come back as 0."""
    path = new_path(spark, "probabilities")
    sinks.genotype_probabilities(_marked(spark, d), path, ["chr", "snp", "bp", "a1", "a2"], "ind", "dosage", INDIVIDUALS)
    return formats.genotype_probabilities(spark, path).select("chr", "snp", "bp", "ind", F.round("dosage", 4).alias("dosage"))


def hard_call_lines(spark, d):
    """Dosages as letters where a genotype's probability is 0.9 or more, and back as the dosage of the first known letter."""
    path = new_path(spark, "tped")
    sinks.tped(_marked(spark, d), path, ["chr", "snp", "bp", "a1", "a2"], "ind", "dosage", INDIVIDUALS, 0.9)
    got = formats.tped(spark, path)
    return got.select("snp", "ind", F.when(F.col("a1") == "A", F.col("dosage")).otherwise(2 - F.col("dosage")).alias("dosage"))


def pedigree_matrix(spark, d):
    """Three markers of every customer; letters by the key's remainders, some missing."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    pair = lambda m: F.when(k % m == 0, "A A").when(k % m == 1, "A C").when(k % m == 2, "0 0").otherwise("C C")
    rows = c.select(_line(" ", F.concat(F.lit("f"), "c_nationkey"), _text("c_custkey"), "0", "0", "1", "-9", pair(5), pair(7), pair(4)))
    names = spark.createDataFrame([("1 s5 0 10\n1 s7 0 20\n1 s4 0 30",)], "value string")
    return formats.ped(spark, _written(rows, "ped"), _written(names, "map"))


def stored_genotypes(spark, d):
    """The columnar store, read whole."""
    path = new_path(spark, "store")
    sinks.genotype_store(_marked(spark, d), path, "snp", "ind", "dosage")
    return formats.genotype_store(spark, path)


def stored_markers(spark, d):
    """Two markers by name out of the store: the filter reaches the scan."""
    path = new_path(spark, "store")
    sinks.genotype_store(_marked(spark, d), path, "snp", "ind", "dosage")
    return formats.genotype_store(spark, path, ["m3", "m17"])


_VCF_HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3"


def _vcf_lines(spark, d):
    """A site a part with three samples; every fifth has two alternatives."""
    k = F.col("p_partkey")
    sample = lambda m: F.when(k % m == 0, "0/1:7").when(k % m == 1, "1|1:8").when(k % m == 2, "./.:0").otherwise("0/0:9")
    alt = F.when(k % 5 == 0, "G,T").otherwise("G")
    info = F.concat(F.lit("DP="), _text("p_size"), F.when(k % 2 == 0, ";DB").otherwise(""))
    return table(spark, d, "part").select(F.concat(F.lit("chr"), k % 22 + 1).alias("chr"), (k * 10).alias("pos"), _line("\t", F.concat(F.lit("chr"), (k % 22 + 1).cast("string")), (k * 10).cast("string"), F.when(k % 3 == 0, ".").otherwise(F.concat(F.lit("rs"), k)), "A", alt, F.when(k % 4 == 0, ".").otherwise(_text("p_size")), F.when(k % 6 == 0, "q10").otherwise("PASS"), info, "GT:DP", sample(4), sample(5), sample(3)))


def _vcf(spark, d):
    return formats.vcf(spark, _written(_vcf_lines(spark, d), "vcf", _VCF_HEAD))


def vcf_sites(spark, d):
    """Sites read, written by the site writer and read again."""
    again = formats.vcf(spark, _written(sinks.vcf_lines(_vcf(spark, d)), "vcf"))
    return again.select("chr", "pos", "id", "ref", "alt", "qual", "filter", F.col("info")["DP"].cast("int").alias("depth"), F.map_contains_key("info", "DB").alias("known"))


def vcf_dosage_rows(spark, d):
    return formats.vcf_dosages(_vcf(spark, d)).select("pos", "alt", "sample", "dosage")


def vcf_genotype_counts(spark, d):
    return formats.vcf_genotype_counts(_vcf(spark, d)).select("pos", "homref", "het", "homvar", "nocall")


def _vcf_blocks(spark, d):
    """The lines in block-gzip files, and their index of lines."""
    files = block_gzip.write(_vcf_lines(spark, d), new_path(spark, "blocks"), ["chr", "pos"], _VCF_HEAD)
    return block_gzip.line_index(spark, [r["file"] for r in files.select("file").collect()])  # a file a range


def vcf_region(spark, d):
    """Sites of a region: the block index tells which members to read."""
    index = stored(block_gzip.block_index(_vcf_blocks(spark, d)), "index")
    return formats.vcf_region_of_blocks(index, "chr3", 1000, 15000).select("chr", "pos")


def vcf_block_contents(spark, d):
    """All lines through the block index, whole."""
    return formats.vcf_rows(block_gzip.read_blocks(block_gzip.block_index(_vcf_blocks(spark, d)))).select("chr", "pos", "alt", F.size("samples").alias("samples"))


def lines_by_key(spark, d):
    """Customers' lines by the keys of large orders, out of block-gzip files by their places."""
    c = table(spark, d, "customer").select("c_custkey", _line("\t", _text("c_custkey"), F.col("c_name"), F.col("c_mktsegment")))
    files = block_gzip.write(c, new_path(spark, "blocks"), ["c_custkey"])
    index = block_gzip.line_index(spark, [r["file"] for r in files.select("file").collect()], (0,))
    keys = table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey")
    f = F.split("value", "\t")
    return block_gzip.lookup(index, keys, "o_custkey").select(f[0].cast("long").alias("c_custkey"), f[1].alias("c_name"), f[2].alias("c_mktsegment"))


def vcf_pass_sites(spark, d):
    return formats.vcf_sites_only(_vcf(spark, d))


def vcf_minimal_alleles(spark, d):
    return formats.minimal_sites(_vcf(spark, d))


def aligned_reads(spark, d):
    """SAM lines: unmapped and CIGAR-less ones go, ends follow from the CIGAR."""
    k = F.col("event_id")
    cigar = F.when(k % 11 == 0, "*").when(k % 2 == 0, "5M2N3M").otherwise("4S10M1D2I5M")
    tags = F.when(k % 3 == 0, "\tNH:i:2").otherwise("")
    rows = table(spark, d, "events").select(F.concat(_line("\t", F.concat(F.lit("r"), _text("event_id")), F.when(k % 5 == 0, "16").when(k % 7 == 0, "4").otherwise("0"), _text("user_id"), (k + 1).cast("string"), (k % 60).cast("string"), cigar, "*", "0", "0", "A", "I"), tags).alias("value"))
    return formats.sam(spark, _written(rows, "sam", "@HD\tVN:1.6")).select("name", "chr", "start", "end", "strand", "mapq", "nh")


def transcript_features(spark, d):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    about = F.concat(F.lit('gene_id "g'), _text("l_partkey"), F.lit('"; transcript_id "t'), _text("l_suppkey"), F.lit('";'))
    rows = table(spark, d, "lineitem").select(_line("\t", _text("l_suppkey"), "src", F.when(F.col("l_linenumber") % 2 == 0, "CDS").otherwise("exon"), k.cast("string"), (k + 50).cast("string"), ".", "+", ".", about))
    got = formats.gtf(spark, _written(rows, "gtf", "#!genome"), "exon")
    return got.select("chr", "start", "end", "strand", F.col("attributes")["gene_id"].alias("gene"), F.col("attributes")["transcript_id"].alias("transcript"))


def block_differences(spark, d):
    """Pairwise alignment blocks: a part's letters against the same with every a changed."""
    seq = F.upper(F.regexp_replace("p_name", " ", ""))
    row = lambda name, s: F.concat(F.lit(f"s {name} 0 "), F.length(seq).cast("string"), F.lit(" + "), _text("p_partkey"), F.lit(" "), s)
    blocks = table(spark, d, "part").select(F.concat(F.lit("a score=1\n"), row("x", seq), F.lit("\n"), row("y", F.translate(seq, "A", "-")), F.lit("\n")).alias("value"))
    got = annotations.alignment_blocks(spark, _written(blocks, "maf"))
    first = got.groupBy("block").agg(F.max("total").alias("p_partkey"))
    return annotations.block_differences(got).join(first, "block").select("p_partkey", "differences")


def association_rows(spark, d):
    """Results written under the common header and read by any dialect's reader; places missing from the columns come from names chr:bp."""
    p = pseudo_p(spark, d).select(F.concat((F.col("o_orderkey") % 22 + 1).cast("string"), F.lit(":"), _text("o_orderkey")).alias("snp"), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 22 + 1).cast("string")).alias("chr"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("bp"), F.lit("A").alias("a1"), F.lit(0.25).alias("beta"), F.lit(0.5).alias("se"), F.when(F.col("o_orderkey") % 9 != 0, F.col("p")).alias("p"))
    path = new_path(spark, "association")
    sinks.association(p, path)
    got = formats.association(spark, path)
    return got.select("snp", F.nullif("chr", F.lit("NA")).alias("chr"), "bp", "beta", F.round("p", 9).alias("p")).withColumn("chr", F.coalesce("chr", F.substring_index("snp", ":", 1)))


def relatedness_rows(spark, d):
    """The lower triangle as text and back as the whole matrix."""
    g = genotype.gram(dosages(spark, d), "marker", "ind", "dosage").select("i", "j", "n", F.round("value", 4).alias("value"))
    path = new_path(spark, "grm")
    sinks.grm_text(g, path)
    return formats.grm_text(spark, path).select("i", "j", F.col("n").cast("long").alias("n"), (F.round("value", 4) + 0.0).alias("value"))


def imputed_allele_rows(spark, d):
    """Marker lines of probability triples for two individuals."""
    k = F.col("p_partkey")
    three = lambda m: [((k % m) / 8).cast("string"), F.lit("0.25"), F.lit("0")]
    rows = table(spark, d, "part").select(_line(" ", F.concat(F.lit("rs"), k), "A", "P", *three(4), *three(3)))
    return annotations.imputed_alleles(spark, _written(rows, "gprobs", "marker alleleA alleleB i1 i1 i1 i2 i2 i2")).select("marker", "ind", "dosage")


def _effect_vcf(spark, d):
    k = F.col("p_partkey")
    kinds = F.when(k % 3 == 0, "STOP_GAINED(HIGH|NONSENSE|c|q|9|G1),INTRON(LOW|||x|1|G2)").when(k % 3 == 1, "NON_SYNONYMOUS_CODING(MODERATE|MISSENSE|c|q|9|G3)").otherwise(F.lit(None))
    info = F.coalesce(F.concat(F.lit("EFF="), kinds), F.lit("."))
    return formats.vcf(spark, _written(table(spark, d, "part").select(_line("\t", "1", k.cast("string"), ".", "A", "G", ".", "PASS", info)), "vcf", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"))


def variant_effects(spark, d):
    return annotations.effects(_effect_vcf(spark, d)).select("pos", "effect", "impact", "gene")


def loss_of_function_variants(spark, d):
    return annotations.loss_of_function(annotations.effects(_effect_vcf(spark, d))).select("pos", "effect", "gene")


def allele_count_dialects(spark, d):
    """Three ways of INFO fields to genotype counts."""
    k = F.col("p_partkey")
    info = F.when(k % 3 == 0, F.concat(F.lit("AC_Het="), _text("p_size"), F.lit(";AC_Hom=3;AN_Adj=400"))).when(k % 3 == 1, F.concat(F.lit("GTC=4,"), _text("p_size"), F.lit(",90"))).otherwise("AC=10;AN=40")
    v = formats.vcf(spark, _written(table(spark, d, "part").select(_line("\t", "1", k.cast("string"), ".", "A", "G", ".", "PASS", info)), "vcf", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"))
    return annotations.allele_counts(v).select("pos", *[F.round(c, 6).alias(c) for c in ("homref", "het", "homvar")])


def files_by_key(spark, d):
    """One folder a segment, read back one by one."""
    path = new_path(spark, "by-key")
    sinks.split_by_key(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), path, "c_mktsegment")
    return spark.read.option("header", True).csv(path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment")


def concatenated_files(spark, d):
    """Two files with headers as one table."""
    paths = [new_path(spark, "part") for _ in range(2)]
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for k, path in enumerate(paths):
        sinks.csv(o.where(F.col("o_orderkey") % 2 == k), path)
    return spark.read.option("header", True).schema("o_orderkey long, o_orderstatus string").csv(paths)


def compressed_lines(spark, d):
    """Gzip by file name, lines with letters beyond ASCII."""
    path = new_path(spark, "gzip")
    table(spark, d, "documents").select(F.concat(_text("doc_id"), F.lit(" é"), F.length("text").cast("string")).alias("value")).write.option("compression", "gzip").text(path)
    return formats.lines(spark, path)


def row_subset(spark, d):
    return formats.row_range(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, 5000)


def genotype_file_sets(spark, d):
    """The same dosages from two kinds of files, one after the other."""
    d1 = formats.dosages(spark, _dosage_file(spark, d)).select("snp", _text("iid").alias("individual"), "dosage")
    return d1.where("dosage IS NOT NULL").unionByName(stored_genotypes(spark, d).where("dosage IS NOT NULL")).groupBy("snp", "individual").agg(F.count("*").alias("n"), F.round(F.min("dosage"), 4).alias("low"), F.round(F.max("dosage"), 4).alias("high"))


def chromosome_numbers(spark, d):
    name = F.when(F.col("p_partkey") % 6 == 0, "chrX").when(F.col("p_partkey") % 6 == 1, "Y").when(F.col("p_partkey") % 6 == 2, "chrMT").when(F.col("p_partkey") % 6 == 3, "XY").when(F.col("p_partkey") % 6 == 4, "scaffold").otherwise(F.concat(F.lit("chr"), (F.col("p_partkey") % 22).cast("string")))
    return table(spark, d, "part").select("p_partkey", sequence.chromosome_number(name).alias("number"))


def primer_removed(spark, d):
    return table(spark, d, "part").select("p_partkey", sequence.remove_primer(F.col("p_name"), "red ", 1).alias("rest"))


def oriented(spark, d):
    """A part's letters or their reverse complement, whichever is nearer to the brand's first letters."""
    from helixframe.plans.q_sequence import names

    return names(spark, d).select("id", sequence.orient_to(F.col("seq"), F.lit("ACGTTGCATTACGGTA")).alias("seq"))


def iupac_bases(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(sequence.expand(F.substring("p_name", 1, 1)), "").alias("bases"))


def splice_junctions(spark, d):
    k = F.col("event_id")
    cigar = F.when(k % 2 == 0, "5M2N3M10N1M").otherwise("4S10M1D2I5M")
    got = table(spark, d, "events").select("event_id", F.explode(sequence.splice_gaps(k, cigar)).alias("g"))
    return got.select("event_id", "g.start", "g.end")


def multinomial_draws(spark, d):
    """10,000 draws over suppliers by line items; all draws are dealt out."""
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("w"))
    got = sets.multinomial(s, "l_suppkey", "w", 10_000, 5)
    return got.agg(F.sum(got.columns[-1]).cast("long").alias("draws"))


QUERIES = {
    f.__name__: f
    for f in (delimited_rows, keyed_rows, whitespace_rows, split_fields, fasta_records, fastq_records, gene_sets, bed_regions, marker_sites, marker_map, individuals, allele_frequencies, covariate_rows, dosage_lines, dosages_with_places, probability_lines, hard_call_lines, pedigree_matrix, stored_genotypes, stored_markers, vcf_sites, vcf_dosage_rows, vcf_genotype_counts, vcf_region, vcf_block_contents, lines_by_key, vcf_pass_sites, vcf_minimal_alleles, aligned_reads, transcript_features, block_differences, association_rows, relatedness_rows, imputed_allele_rows, variant_effects, loss_of_function_variants, allele_count_dialects, files_by_key, concatenated_files, compressed_lines, row_subset, genotype_file_sets, chromosome_numbers, primer_removed, oriented, iupac_bases, splice_junctions, multinomial_draws)
}

_FULL = _N + ", f AS (SELECT 'm' || m.marker AS snp, m.marker AS marker, i.i AS ind, dosage FROM (SELECT DISTINCT marker FROM g) m CROSS JOIN (SELECT unnest(range(25)) AS i) i LEFT JOIN g ON g.marker = m.marker AND g.ind = i.i)"
_K = "p_partkey"
_GT = "CASE WHEN k % {m} = 0 THEN 1 WHEN k % {m} = 1 THEN 2 WHEN k % {m} <> 2 THEN 0 END"
_CALLS = f"SELECT k, 0 AS sample, {_GT.format(m=4)} AS x FROM v UNION ALL SELECT k, 1, {_GT.format(m=5)} FROM v UNION ALL SELECT k, 2, {_GT.format(m=3)} FROM v"
_PED = "CASE WHEN c_custkey % {m} = 0 THEN 2 WHEN c_custkey % {m} = 1 THEN 1 WHEN c_custkey % {m} <> 2 THEN 0 END"
_EFFECTS = "(SELECT p_partkey AS pos, 'STOP_GAINED' AS effect, 'HIGH' AS impact, 'G1' AS gene FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'INTRON', 'LOW', 'G2' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'NON_SYNONYMOUS_CODING', 'MODERATE', 'G3' FROM part WHERE p_partkey % 3 = 1)"
_ALTS = "(SELECT p_partkey AS k, 'G' AS alt FROM part UNION ALL SELECT p_partkey, 'T' FROM part WHERE p_partkey % 5 = 0)"
_NAMES = "SELECT p_partkey AS id, translate(regexp_replace(lower(p_name || p_brand || p_type), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM part"
ORACLES = {
    "delimited_rows": "SELECT c_custkey, c_mktsegment, '\"' || c_name || '\",' || chr(10) || c_mktsegment AS note, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "keyed_rows": "SELECT l_partkey, max(l_orderkey * 10 + l_linenumber) AS n FROM lineitem GROUP BY 1",
    "whitespace_rows": "SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nation FROM customer",
    "split_fields": "WITH t AS (SELECT p_partkey, replace(p_name, ' ', ';;') || ',' || p_brand || ';' AS t FROM part) SELECT p_partkey, array_to_string(string_split_regex(t, '[;,]'), '|') AS every, array_to_string(list_filter(string_split_regex(t, '[;,]'), lambda x: x <> ''), '|') AS runs FROM t",
    "fasta_records": "SELECT doc_id, length(seq) AS length, md5(seq) AS md5 FROM (SELECT doc_id, coalesce(regexp_replace(text, '[^a-z]', '', 'g'), '') AS seq FROM documents)",
    "fastq_records": "SELECT 'r' || p_partkey AS id, upper(replace(p_name, ' ', '')) AS seq, '@' || repeat('I', length(p_name) - 2) AS quality FROM part",
    "gene_sets": "SELECT DISTINCT 'set' || l_suppkey AS \"set\", CAST(l_partkey AS VARCHAR) AS gene FROM lineitem",
    "bed_regions": "SELECT CAST(user_id AS VARCHAR) AS chr, event_id AS \"start\", event_id + 100 AS \"end\", CASE WHEN event_id % 3 = 1 THEN event_type ELSE user_id || ':' || event_id || '-' || (event_id + 100) END AS name FROM events",
    "marker_sites": "SELECT CAST(p_partkey % 22 + 1 AS VARCHAR) AS chr, 'rs' || p_partkey AS snp, CAST(p_size / 4 AS DOUBLE) AS cm, p_partkey * 10 AS bp, 'A' AS a1, 'C' AS a2 FROM part",
    "marker_map": "SELECT CAST(p_partkey % 22 + 1 AS VARCHAR) AS chr, 'rs' || p_partkey AS snp, CASE WHEN p_partkey * 10 % 3 <> 0 THEN CAST(p_size / 4 AS DOUBLE) END AS cm, p_partkey * 10 AS bp FROM part",
    "individuals": "SELECT 'f' || c_nationkey AS fid, CAST(c_custkey AS VARCHAR) AS iid, CAST(nullif(c_custkey % 3, 0) AS INTEGER) AS sex, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS phenotype FROM customer",
    "allele_frequencies": "SELECT '1' AS chr, 'rs' || p_partkey AS snp, 'A' AS a1, 'C' AS a2, CAST(p_size / 128 AS DOUBLE) AS maf, CAST(p_size AS BIGINT) AS nchrobs FROM part WHERE p_partkey % 7 <> 0",
    "covariate_rows": "SELECT 'f' || c_nationkey AS fid, CAST(c_custkey AS VARCHAR) AS iid, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS c1, CASE WHEN c_custkey % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS c2 FROM customer",
    "dosage_lines": _FULL + " SELECT snp, 'A' AS a1, 'C' AS a2, 'f' || ind AS fid, CAST(ind AS VARCHAR) AS iid, dosage FROM f",
    "dosages_with_places": _FULL + " SELECT snp, CAST(marker % 22 + 1 AS VARCHAR) AS chr, CAST(marker * 100 AS BIGINT) AS bp, 'A' AS a1, 'C' AS a2, 'f' || ind AS fid, CAST(ind AS VARCHAR) AS iid, CAST(nullif(ind % 3, 0) AS INTEGER) AS sex, CAST(NULL AS DOUBLE) AS phenotype, dosage FROM f",
    "probability_lines": _FULL + " SELECT CAST(marker % 22 + 1 AS VARCHAR) AS chr, snp, CAST(marker * 100 AS BIGINT) AS bp, CAST(ind AS INTEGER) AS ind, round(coalesce(dosage, 0.0), 4) AS dosage FROM f",
    "hard_call_lines": _FULL + ", h AS (SELECT marker, snp, ind, CASE WHEN greatest(0.0, dosage - 1) >= 0.9 THEN 2.0 WHEN CASE WHEN dosage <= 1 THEN dosage ELSE 2 - dosage END >= 0.9 THEN 1.0 WHEN greatest(0.0, 1 - dosage) >= 0.9 THEN 0.0 END AS call FROM f) SELECT snp, CAST(ind AS INTEGER) AS ind, CAST(call AS DOUBLE) AS dosage FROM h",
    "pedigree_matrix": "WITH x AS (" + " UNION ALL ".join(f"SELECT 's{m}' AS snp, c_nationkey, c_custkey, {_PED.format(m=m)} AS a FROM customer" for m in (5, 7, 4)) + "), n AS (SELECT snp, sum(a) AS a, sum(2 - a) AS c FROM x GROUP BY 1) SELECT x.snp, 'f' || c_nationkey AS fid, CAST(c_custkey AS VARCHAR) AS iid, CASE WHEN n.a <= n.c THEN 'A' ELSE 'C' END AS a1, CASE WHEN n.a <= n.c THEN 'C' ELSE 'A' END AS a2, CAST(CASE WHEN n.a <= n.c THEN x.a ELSE 2 - x.a END AS DOUBLE) AS dosage FROM x JOIN n USING (snp)",
    "stored_genotypes": _N + " SELECT 'm' || marker AS snp, CAST(ind AS VARCHAR) AS individual, dosage FROM g",
    "stored_markers": _N + " SELECT 'm' || marker AS snp, CAST(ind AS VARCHAR) AS individual, dosage FROM g WHERE marker IN (3, 17)",
    "vcf_sites": "SELECT 'chr' || (p_partkey % 22 + 1) AS chr, p_partkey * 10 AS pos, CASE WHEN p_partkey % 3 <> 0 THEN 'rs' || p_partkey END AS id, 'A' AS ref, CASE WHEN p_partkey % 5 = 0 THEN 'G,T' ELSE 'G' END AS alt, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS qual, CASE WHEN p_partkey % 6 = 0 THEN 'q10' ELSE 'PASS' END AS filter, p_size AS depth, p_partkey % 2 = 0 AS known FROM part",
    "vcf_dosage_rows": f"WITH v AS (SELECT p_partkey AS k FROM part), c AS ({_CALLS}) SELECT a.k * 10 AS pos, a.alt, CAST(sample AS INTEGER) AS sample, CAST(CASE WHEN a.alt = 'T' AND x IS NOT NULL THEN 0 ELSE x END AS DOUBLE) AS dosage FROM c JOIN {_ALTS} a USING (k)",
    "vcf_genotype_counts": f"WITH v AS (SELECT p_partkey AS k FROM part), c AS ({_CALLS}) SELECT k * 10 AS pos, count(*) FILTER (WHERE x = 0) AS homref, count(*) FILTER (WHERE x = 1) AS het, count(*) FILTER (WHERE x = 2) AS homvar, count(*) FILTER (WHERE x IS NULL) AS nocall FROM c GROUP BY 1",
    "vcf_region": "SELECT 'chr3' AS chr, p_partkey * 10 AS pos FROM part WHERE p_partkey % 22 = 2 AND p_partkey * 10 >= 1000 AND p_partkey * 10 < 15000",
    "vcf_block_contents": "SELECT 'chr' || (p_partkey % 22 + 1) AS chr, p_partkey * 10 AS pos, CASE WHEN p_partkey % 5 = 0 THEN 'G,T' ELSE 'G' END AS alt, 3 AS samples FROM part",
    "lines_by_key": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "vcf_pass_sites": "SELECT CAST(p_partkey % 22 + 1 AS VARCHAR) AS chr, p_partkey * 10 AS pos, '.' AS id, 'A' AS ref, CASE WHEN p_partkey % 5 = 0 THEN 'G,T' ELSE 'G' END AS alt FROM part WHERE p_partkey % 6 <> 0",
    "vcf_minimal_alleles": f"SELECT 'chr' || (k % 22 + 1) AS chr, k * 10 AS pos, 'A' AS ref, alt FROM {_ALTS}",
    "aligned_reads": "SELECT 'r' || event_id AS name, CAST(user_id AS VARCHAR) AS chr, event_id AS \"start\", event_id + CASE WHEN event_id % 2 = 0 THEN 10 ELSE 16 END AS \"end\", CASE WHEN event_id % 5 = 0 THEN '-' ELSE '+' END AS strand, CAST(event_id % 60 AS INTEGER) AS mapq, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS nh FROM events WHERE event_id % 11 <> 0 AND (event_id % 5 = 0 OR event_id % 7 <> 0)",
    "transcript_features": "SELECT CAST(l_suppkey AS VARCHAR) AS chr, l_orderkey * 10 + l_linenumber - 1 AS \"start\", l_orderkey * 10 + l_linenumber + 50 AS \"end\", '+' AS strand, 'g' || l_partkey AS gene, 't' || l_suppkey AS transcript FROM lineitem WHERE l_linenumber % 2 <> 0",
    "block_differences": "SELECT p_partkey, length(p_name) - length(replace(p_name, 'a', '')) AS differences FROM part",
    "association_rows": "WITH p AS (SELECT o_orderkey, x * x * x AS p FROM (SELECT o_orderkey, CAST((o_orderkey * 48271 % 2147483647) / 2147483647.0 AS DOUBLE) AS x FROM orders)) SELECT (o_orderkey % 22 + 1) || ':' || o_orderkey AS snp, CAST(o_orderkey % 22 + 1 AS VARCHAR) AS chr, o_orderkey AS bp, CAST(0.25 AS DOUBLE) AS beta, round(p, 9) AS p FROM p WHERE o_orderkey % 9 <> 0",
    "relatedness_rows": "",
    "imputed_allele_rows": "SELECT 'rs' || p_partkey AS marker, 0 AS ind, CAST((p_partkey % 4) / 4 + 0.25 AS DOUBLE) AS dosage FROM part UNION ALL SELECT 'rs' || p_partkey, 1, CAST((p_partkey % 3) / 4 + 0.25 AS DOUBLE) FROM part",
    "variant_effects": f"SELECT * FROM {_EFFECTS}",
    "loss_of_function_variants": f"SELECT pos, effect, gene FROM {_EFFECTS} WHERE effect = 'STOP_GAINED'",
    "allele_count_dialects": "SELECT p_partkey AS pos, CAST(CASE p_partkey % 3 WHEN 0 THEN 200 - p_size - 3 WHEN 1 THEN 90 ELSE 11.25 END AS DOUBLE) AS homref, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size ELSE 7.5 END AS DOUBLE) AS het, CAST(CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 1.25 END AS DOUBLE) AS homvar FROM part",
    "files_by_key": "SELECT c_custkey, c_mktsegment FROM customer",
    "concatenated_files": "SELECT o_orderkey, o_orderstatus FROM orders",
    "compressed_lines": "SELECT doc_id || ' é' || length(text) AS value FROM documents",
    "row_subset": "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000",
    "genotype_file_sets": _N + " SELECT 'm' || marker AS snp, CAST(ind AS VARCHAR) AS individual, CAST(2 AS BIGINT) AS n, round(dosage, 4) AS low, round(dosage, 4) AS high FROM g WHERE dosage IS NOT NULL",
    "chromosome_numbers": "SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN 23 WHEN 1 THEN 24 WHEN 2 THEN 26 WHEN 3 THEN 25 WHEN 5 THEN p_partkey % 22 END AS INTEGER) AS number FROM part",
    "primer_removed": "SELECT p_partkey, CASE WHEN levenshtein(left(p_name, 4), 'red ') <= 1 THEN substr(p_name, 5) ELSE p_name END AS rest FROM part",
    "oriented": f"WITH s AS (SELECT id, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM ({_NAMES})) SELECT id, CASE WHEN levenshtein(rc, 'ACGTTGCATTACGGTA') < levenshtein(seq, 'ACGTTGCATTACGGTA') THEN rc ELSE seq END AS seq FROM s",
    "iupac_bases": "SELECT p_partkey, CASE upper(left(p_name, 1)) WHEN 'A' THEN 'A' WHEN 'C' THEN 'C' WHEN 'G' THEN 'G' WHEN 'T' THEN 'T' WHEN 'R' THEN 'AG' WHEN 'Y' THEN 'CT' WHEN 'S' THEN 'CG' WHEN 'W' THEN 'AT' WHEN 'K' THEN 'GT' WHEN 'M' THEN 'AC' WHEN 'B' THEN 'CGT' WHEN 'D' THEN 'AGT' WHEN 'H' THEN 'ACT' WHEN 'V' THEN 'ACG' WHEN 'N' THEN 'ACGT' END AS bases FROM part",
    "splice_junctions": "SELECT event_id, event_id + 5 AS \"start\", event_id + 7 AS \"end\" FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_id + 10, event_id + 20 FROM events WHERE event_id % 2 = 0",
    "multinomial_draws": "SELECT CAST(10000 AS BIGINT) AS draws",
}
_M = _G + ", m AS (SELECT marker, sum(dosage) / (2 * count(dosage)) AS freq FROM g GROUP BY 1), z AS (SELECT marker, ind, (dosage - 2 * freq) / sqrt(2 * freq * (1 - freq)) AS z FROM g JOIN m USING (marker) WHERE dosage IS NOT NULL AND least(freq, 1 - freq) > 0)"
ORACLES["relatedness_rows"] = _M + " SELECT CAST(a.ind AS INTEGER) AS i, CAST(b.ind AS INTEGER) AS j, count(*) AS n, round(sum(a.z * b.z) / count(*), 4) + 0.0 AS value FROM z a JOIN z b USING (marker) GROUP BY 1, 2"
