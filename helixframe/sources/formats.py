"""Readers of common genetics text formats as DataFrames.

All are line- or record-based scans that Spark splits and decompresses by
itself (gzip by file name); nothing is opened on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from helixframe.functions import sequence


def lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Non-empty lines as ``value``."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0)


def _fields(df: DataFrame, names: Sequence[str], pattern: str = r"\s+") -> DataFrame:
    parts = F.split(F.trim("value"), pattern)
    return df.select(parts.alias("_f")).select(*[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)])


def delimited(spark: SparkSession, path: str, header: bool = True, separator: str = ",", key_in: tuple[str, Sequence[str]] | None = None, schema: str | None = None) -> DataFrame:
    """Quoted delimited text (RFC 4180, quotes doubled inside quotes, line ends allowed); a ragged row fails the query. ``key_in`` keeps rows whose key is listed, inside the scan's stage."""
    reader = spark.read.option("header", header).option("sep", separator).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").option("enforceSchema", False)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.where(F.col(key_in[0]).isin(list(key_in[1]))) if key_in else df


def whitespace_table(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """Runs of blanks and tabs separate; without ``names`` the first line names the columns."""
    df = lines(spark, path)
    if names is None:
        head = df.first()
        names = head["value"].split() if head else []
        df = df.where(F.col("value") != (head["value"] if head else ""))
    return _fields(df, names, r"[ \t]+")


def split_keep_empty(text: Column, separators: str) -> Column:
    """Fields between single separator characters, empty ones too."""
    return F.split(text, "[" + "".join("\\" + c for c in separators) + "]", -1)


def split_runs(text: Column, separators: str) -> Column:
    """Fields between runs of separator characters; none are empty."""
    return F.filter(split_keep_empty(text, separators), lambda x: x != "")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq): records start at ``>`` at a line's start; wrapped lines are joined."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    head = F.substring_index(body, "\n", 1)
    rest = F.when(F.instr(body, "\n") > 0, body.substr(F.instr(body, "\n") + 1, F.length(body))).otherwise("")
    rows = raw.where(F.length(F.trim("value")) > 0).select(F.trim(F.regexp_replace(head, "\r", "")).alias("_h"), F.regexp_replace(rest, r"\s", "").alias("seq"))
    return rows.select(F.substring_index("_h", " ", 1).alias("id"), F.trim(F.regexp_replace("_h", r"^\S+", "")).alias("description"), "seq")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value): every line with its number within its file, from 0, and a number for the file; carriage returns are dropped.

    Rows of a file's split follow each other in the scan, so a line's number is its place in the split and the lines of the
    file's earlier splits, a row a split that is broadcast; no file is read as a whole.
    """
    at = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_m")]
    rows = spark.read.option("lineSep", "\n").text(path).select("value", *at)
    splits = rows.groupBy("_f", "_s").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_f").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("_f", "_s", F.dense_rank().over(Window.orderBy("_f")).alias("file"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(F.broadcast(splits), ["_f", "_s"]).select("file", (F.col("_m") + F.col("_shift")).alias("n"), F.replace("value", F.lit("\r"), F.lit("")).alias("value"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq, quality) of four-line records, by line numbers within each file, since a quality line may begin with ``@`` too."""
    place = F.col("n") % 4
    line = lambda i: F.max(F.when(place == i, F.col("value")))
    records = numbered_lines(spark, path).groupBy("file", F.floor(F.col("n") / 4)).agg(line(0).alias("h"), line(1).alias("seq"), line(3).alias("quality"), F.count("*").alias("n")).where("n = 4")
    return records.select(F.regexp_replace(F.substring_index("h", " ", 1), "^@", "").alias("id"), "seq", "quality")


def gmt(spark: SparkSession, path: str) -> DataFrame:
    """(set, gene): the second column is dropped, ``/`` removed from names; of sets of one name the last in file order counts."""
    parts = F.split("value", "\t")
    rows = lines(spark, path).select(F.regexp_replace(parts[0], "/", "").alias("set"), F.slice(parts, 3, F.size(parts)).alias("genes"), F.monotonically_increasing_id().alias("_n"))
    return rows.groupBy("set").agg(F.max_by("genes", "_n").alias("genes")).select("set", F.explode("genes").alias("gene"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, name): a missing or ``.`` name becomes chr:start-end."""
    df = _fields(lines(spark, path).where(~F.col("value").rlike("^(#|track|browser)")), ["chr", "start", "end", "name"], "\t")
    name = F.when(F.col("name").isNull() | (F.col("name") == "."), F.concat("chr", F.lit(":"), "start", F.lit("-"), "end")).otherwise(F.col("name"))
    return df.select("chr", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), name.alias("name"))


def bim(spark: SparkSession, path: str) -> DataFrame:
    df = _fields(lines(spark, path), ["chr", "snp", "cm", "bp", "a1", "a2"])
    return df.withColumns({"cm": F.col("cm").cast("double"), "bp": F.col("bp").cast("long")})


def map_file(spark: SparkSession, path: str) -> DataFrame:
    """MAP of four columns, or three without the genetic distance."""
    f = F.split(F.trim("value"), r"\s+")
    four = F.size(f) >= 4
    return lines(spark, path).select(f[0].alias("chr"), f[1].alias("snp"), F.when(four, f[2]).cast("double").alias("cm"), F.when(four, F.get(f, F.lit(3))).otherwise(f[2]).cast("long").alias("bp"))


def fam(spark: SparkSession, path: str) -> DataFrame:
    """Individuals; phenotype -9 and sex 0 become null."""
    df = _fields(lines(spark, path), ["fid", "iid", "father", "mother", "sex", "phenotype"])
    return df.withColumns({"sex": F.nullif(F.col("sex").cast("int"), F.lit(0)), "phenotype": F.nullif(F.col("phenotype").cast("double"), F.lit(-9.0))})


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """.frq table; rows of NA frequency are dropped."""
    df = whitespace_table(spark, path, ["chr", "snp", "a1", "a2", "maf", "nchrobs"]).where("snp <> 'SNP'")
    return df.where("maf <> 'NA'").withColumns({"maf": F.col("maf").cast("double"), "nchrobs": F.col("nchrobs").cast("long")})


def covariates(spark: SparkSession, path: str, missing: str = "-9") -> DataFrame:
    """FID, IID and numeric columns; the missing code and NA become null."""
    df = whitespace_table(spark, path)
    rest = [c for c in df.columns if c not in ("FID", "IID")]
    return df.select("FID", "IID", *[F.when(~F.col(c).isin(missing, "NA", "NaN"), F.col(c)).cast("double").alias(c) for c in rest])


def dosages(spark: SparkSession, path: str, missing: float = -9.0) -> DataFrame:
    """Text dosages in long form (snp, a1, a2, fid, iid, dosage): header ``SNP A1 A2 fid iid ..``; values outside [0, 2] other than the missing code fail the query."""
    df = lines(spark, path)
    head = df.where(F.col("value").startswith("SNP")).first()["value"].split()
    people = list(zip(head[3::2], head[4::2]))
    f = F.split(F.trim("value"), r"\s+")
    rows = df.where(~F.col("value").startswith("SNP")).select(f[0].alias("snp"), f[1].alias("a1"), f[2].alias("a2"), F.posexplode(F.slice(f, 4, len(people))).alias("_i", "_d"))
    who = F.array(*[F.struct(F.lit(a).alias("fid"), F.lit(b).alias("iid")) for a, b in people])
    d = F.col("_d").cast("double")
    value = F.when(d == missing, F.lit(None)).when((d >= 0) & (d <= 2), d).otherwise(F.raise_error(F.concat(F.lit("dosage out of range: "), F.col("_d"))).cast("double"))
    return rows.select("snp", "a1", "a2", F.element_at(who, F.col("_i") + 1).alias("_w"), value.alias("dosage")).select("snp", "a1", "a2", "_w.fid", "_w.iid", "dosage")


def plink_dosage(spark: SparkSession, path: str, map_path: str, fam_path: str) -> DataFrame:
    """Text dosages with their markers' places and their individuals' sex and phenotype; markers without a place and individuals not listed are dropped."""
    d = dosages(spark, path)
    people = fam(spark, fam_path).select("fid", "iid", "sex", "phenotype")
    return d.join(map_file(spark, map_path).select("snp", "chr", "bp"), "snp").join(people, ["fid", "iid"]).select("snp", "chr", "bp", "a1", "a2", "fid", "iid", "sex", "phenotype", "dosage")


def ped(spark: SparkSession, path: str, map_path: str) -> DataFrame:
    """PED rows as long dosages (snp, fid, iid, a1, a2, dosage) of each marker's rarer letter a1 (ties: the lesser); ``0`` is missing.

    The map's lines name the markers in their order; it is read to the driver, a name a marker.
    """
    names = [r["snp"] for r in map_file(spark, map_path).select("snp", F.monotonically_increasing_id().alias("n")).orderBy("n").collect()]
    f = F.split(F.trim("value"), r"\s+")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.array(F.get(f, 2 * i + 6), F.get(f, 2 * i + 7)))
    rows = lines(spark, path).select(f[0].alias("fid"), f[1].alias("iid"), F.posexplode(pairs).alias("_i", "_p"))
    letters = rows.select("_i", F.explode("_p").alias("l")).where("l <> '0'").groupBy("_i", "l").agg(F.count("*").alias("n"))
    alleles = letters.groupBy("_i").agg(F.min(F.struct("n", "l")).alias("low"), F.max(F.struct("n", "l")).alias("high"))
    alleles = alleles.select("_i", F.col("low.l").alias("a1"), F.when(F.col("high.l") != F.col("low.l"), F.col("high.l")).alias("a2"))
    count = F.size(F.filter("_p", lambda x: x == F.col("a1"))).cast("double")
    known = ~F.array_contains("_p", "0")
    return rows.join(alleles, "_i").select(F.element_at(F.lit(names), F.col("_i") + 1).alias("snp"), "fid", "iid", "a1", "a2", F.when(known, count).alias("dosage"))


def genotype_store(spark: SparkSession, path: str, markers: Sequence[str] | None = None) -> DataFrame:
    """Long dosages as ``sinks.genotype_store`` lays them out; listed markers reach the scan as a filter on sorted row groups."""
    df = spark.read.parquet(path)
    return df.where(F.col("snp").isin(list(markers))) if markers is not None else df


def genotype_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """Triples of probabilities per individual in long form: dosage = 2 P(hom) + P(het). Columns: chr, snp, bp, a1, a2, then triples."""
    f = F.split(F.trim("value"), r"\s+")
    n = F.floor((F.size(f) - 5) / 3).cast("int")
    at = lambda i, k: F.element_at(f, 5 + 3 * i + k).cast("double")
    d = F.transform(F.sequence(F.lit(0), n - 1), lambda i: 2 * at(i, 1) + at(i, 2))
    return lines(spark, path).select(f[0].alias("chr"), f[1].alias("snp"), f[2].cast("long").alias("bp"), f[3].alias("a1"), f[4].alias("a2"), F.posexplode(d).alias("ind", "dosage"))


def tped(spark: SparkSession, path: str) -> DataFrame:
    """Long dosages of allele 1, the row's first known allele (by first character); other letters than two are missing."""
    f = F.split(F.trim("value"), r"\s+")
    letters = F.transform(F.slice(f, 5, F.size(f)), lambda x: F.substring(x, 1, 1))
    base = lines(spark, path).select(f[0].alias("chr"), f[1].alias("snp"), f[2].cast("double").alias("cm"), f[3].cast("long").alias("bp"), letters.alias("_l"))
    known = F.filter("_l", lambda x: ~x.isin("0", "N", "-"))
    base = base.withColumns({"a1": F.get(known, F.lit(0)), "a2": F.get(F.filter(known, lambda x: x != F.get(known, F.lit(0))), F.lit(0))})
    sound = lambda x: (x == F.col("a1")) | x.eqNullSafe(F.col("a2"))
    n = F.floor(F.size("_l") / 2).cast("int")
    pair = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(sound(F.element_at("_l", 2 * i + 1)) & sound(F.element_at("_l", 2 * i + 2)), (F.element_at("_l", 2 * i + 1) == F.col("a1")).cast("double") + (F.element_at("_l", 2 * i + 2) == F.col("a1")).cast("double")))
    return base.select("chr", "snp", "cm", "bp", "a1", "a2", F.posexplode(pair).alias("ind", "dosage"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Site rows: chr, pos, id, ref, alt, qual, filter, info (map), format and samples as an array."""
    return vcf_rows(lines(spark, path))


def vcf_rows(df: DataFrame) -> DataFrame:
    """The site rows of lines in ``value``."""
    rows = df.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    info = F.map_from_entries(F.transform(F.filter(F.split(F.col("f")[7], ";"), lambda x: x != "."), lambda x: F.struct(F.substring_index(x, "=", 1), F.when(F.instr(x, "=") > 0, F.regexp_replace(x, "^[^=]*=", "")).otherwise("true"))))
    dot = lambda i: F.when(F.col("f")[i] != ".", F.col("f")[i])
    return rows.select(F.col("f")[0].alias("chr"), F.col("f")[1].cast("long").alias("pos"), dot(2).alias("id"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"), dot(5).cast("double").alias("qual"), F.col("f")[6].alias("filter"), info.alias("info"), F.get("f", F.lit(8)).alias("format"), F.slice("f", 10, F.greatest(F.lit(0), F.size("f") - 9)).alias("samples"))


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    return head["value"].split("\t")[9:] if head else []


def vcf_dosages(variants: DataFrame) -> DataFrame:
    """Long dosages (chr, pos, ref, alt, sample number, dosage): homref 0, het 1, homvar 2, no call null; a row for each alternative allele."""
    v = variants.select("chr", "pos", "ref", F.posexplode(F.split("alt", ",")).alias("_k", "alt"), F.col("samples"))
    v = v.select("chr", "pos", "ref", "alt", "_k", F.posexplode("samples").alias("sample", "_s"))
    calls = F.split(F.substring_index("_s", ":", 1), "[|/]")
    no_call = F.exists(calls, lambda c: (c == ".") | (c == ""))
    hits = F.size(F.filter(calls, lambda c: c == (F.col("_k") + 1).cast("string")))
    return v.select("chr", "pos", "ref", "alt", "sample", F.when(~no_call, hits.cast("double")).alias("dosage"))


def vcf_genotype_counts(variants: DataFrame) -> DataFrame:
    """homref, het, homvar and nocall per site, any alternative counting alike; haploid calls are homozygous."""
    g = F.transform("samples", lambda s: F.split(F.substring_index(s, ":", 1), "[|/]"))
    n = lambda test: F.size(F.filter(g, test)).cast("long")
    missing = lambda c: F.exists(c, lambda x: x == ".")
    ref = lambda c: F.forall(c, lambda x: x == "0")
    same = lambda c: F.size(F.array_distinct(c)) == 1
    return variants.select("chr", "pos", "ref", "alt", n(lambda c: ~missing(c) & ref(c)).alias("homref"), n(lambda c: ~missing(c) & ~same(c)).alias("het"), n(lambda c: ~missing(c) & ~ref(c) & same(c)).alias("homvar"), n(missing).alias("nocall"))


def vcf_region(variants: DataFrame, chromosome: str, start: int, end: int) -> DataFrame:
    """Sites of one chromosome with start <= pos < end; on stored Parquet both reach the scan as filters."""
    return variants.where((F.col("chr") == chromosome) & (F.col("pos") >= start) & (F.col("pos") < end))


def vcf_region_of_blocks(index: DataFrame, chromosome: str, start: int, end: int) -> DataFrame:
    """The same from block-gzip files by their block index: only members that hold such sites are read."""
    from helixframe.sources import block_gzip

    return vcf_region(vcf_rows(block_gzip.read_blocks(block_gzip.in_region(index, chromosome, start, end))), chromosome, start, end)


def vcf_sites_only(variants: DataFrame) -> DataFrame:
    """PASS (or unfiltered) rows as chr without prefix, pos, ``.`` id, ref, alt."""
    return variants.where(F.col("filter").isin("PASS", ".")).select(F.regexp_replace("chr", "^chr", "").alias("chr"), "pos", F.lit(".").alias("id"), "ref", "alt")


def minimal_sites(variants: DataFrame) -> DataFrame:
    """Alternatives one a row in minimal representation."""
    v = variants.select("chr", "pos", "ref", F.explode(F.split("alt", ",")).alias("alt"))
    return v.select("chr", sequence.minimal_representation(F.col("pos"), F.col("ref"), F.col("alt")).alias("_m")).select("chr", "_m.pos", "_m.ref", "_m.alt")


def gtf(spark: SparkSession, path: str, feature: str | None = None) -> DataFrame:
    """Features with half-open start (file start - 1) and an attribute map."""
    f = F.split("value", "\t")
    rows = lines(spark, path).where(~F.col("value").startswith("#"))
    pairs = F.regexp_extract_all(f[8], F.lit(r'(\S+ "[^"]*")'), 1)
    attributes = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, " ", 1), F.regexp_extract(p, r'"([^"]*)"', 1))))
    df = rows.select(f[0].alias("chr"), f[2].alias("feature"), (f[3].cast("long") - 1).alias("start"), f[4].cast("long").alias("end"), f[6].alias("strand"), attributes.alias("attributes"))
    return df.where(F.col("feature") == feature) if feature else df


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped reads: name, flag, chr, half-open start and end from the CIGAR, mapq, cigar, strand and NH (1 if absent)."""
    f = F.split("value", "\t")
    rows = lines(spark, path).where(~F.col("value").rlike("^@[A-Z][A-Z]\t"))
    nh = F.regexp_extract("value", r"\tNH:i:(\d+)", 1)
    got = rows.select(f[0].alias("name"), f[1].cast("int").alias("flag"), f[2].alias("chr"), (f[3].cast("long") - 1).alias("start"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), F.when(nh == "", 1).otherwise(nh.cast("int")).alias("nh"))
    got = got.where((F.col("cigar") != "*") & (F.col("flag").bitwiseAND(4) == 0))
    return got.withColumns({"end": F.col("start") + sequence.cigar_length(F.col("cigar")), "strand": F.when(F.col("flag").bitwiseAND(16) == 0, "+").otherwise("-")})


def grm_text(spark: SparkSession, path: str) -> DataFrame:
    """Lower-triangle rows (i, j, n, value) made symmetric."""
    low = _fields(lines(spark, path), ["i", "j", "n", "value"]).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("n").cast("double").alias("n"), F.col("value").cast("double").alias("value"))
    return low.unionByName(low.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "n", "value"))


#: Header names of association results, per dialect, as (snp, chr, bp, a1, beta, se, p).
ASSOCIATION_COLUMNS = {
    "snp": ("SNP", "MARKERNAME", "RSID", "ID"), "chr": ("CHR", "CHROM", "#CHROM", "CHROMOSOME"), "bp": ("BP", "POS", "POSITION"), "a1": ("A1", "ALLELE1", "EFFECT_ALLELE"),
    "beta": ("BETA", "EFFECT", "B", "OR"), "se": ("SE", "STDERR"), "p": ("P", "PVALUE", "P-VALUE", "PVAL"), "n": ("NMISS", "N", "OBS_CT"),
}


def association(spark: SparkSession, path: str) -> DataFrame:
    """Result tables of any dialect whose header names the columns: snp, chr, bp, a1, beta, se, p, n. NA p are dropped; absent chr and bp are parsed from a chr:bp name."""
    df = whitespace_table(spark, path)
    upper = {c.upper(): c for c in df.columns}
    found = {k: next((upper[n] for n in names if n in upper), None) for k, names in ASSOCIATION_COLUMNS.items()}
    number = {"bp": "long", "beta": "double", "se": "double", "p": "double", "n": "double"}
    cols = [(F.col(f"`{c}`") if c else F.lit(None)).try_cast(number.get(k, "string")).alias(k) for k, c in found.items()]
    got = df.select(*cols).where(F.col("p").isNotNull() & ~F.isnan("p"))
    parts = F.split("snp", ":")
    return got.withColumns({"chr": F.coalesce("chr", F.when(F.size(parts) > 1, parts[0])), "bp": F.coalesce("bp", F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("long")))})


def row_range(df: DataFrame, order: str, start: int, end: int) -> DataFrame:
    """Rows of numbers [start, end) in a column of row numbers."""
    return df.where((F.col(order) >= start) & (F.col(order) < end))


def heritability(spark: SparkSession, path: str) -> DataFrame:
    """Heritability estimates (source, value, se) of a variance-component run: tab-separated lines under a header; lines of one value have no se."""
    f = F.split("value", "\t")
    got = lines(spark, path).where(~F.col("value").startswith("Source"))
    return got.select(f[0].alias("source"), f[1].try_cast("double").alias("value"), F.get(f, F.lit(2)).try_cast("double").alias("se"))


def principal_component_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores of a principal-component run in long form (individual, component, score): a first line of eigenvalues begins with ``#``; the last field is the population."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).where(~F.trim("value").startswith("#"))
    return rows.select(f[0].alias("individual"), F.element_at(f, -1).alias("population"), F.posexplode(F.slice(f, 2, F.size(f) - 2)).alias("component", "_s")).select("individual", "population", "component", F.col("_s").cast("double").alias("score"))
