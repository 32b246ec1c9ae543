"""Annotation and less common genotype sources: alignment blocks, effect fields, allele counts, imputed alleles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixframe.sources import formats


def alignment_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block text lines, source, start, size, strand, total, seq) of blank-line separated multiple alignments; only ``s`` lines count."""
    raw = spark.read.text(path, lineSep="\n\n")
    lines = F.filter(F.split("value", "\n"), lambda x: x.startswith("s "))
    rows = raw.select(F.monotonically_increasing_id().alias("block"), lines.alias("ls")).select("block", F.explode("ls").alias("l"))
    f = F.split("l", r"\s+")
    return rows.select("block", f[1].alias("source"), f[2].cast("long").alias("start"), f[3].cast("long").alias("size"), f[4].alias("strand"), f[5].cast("long").alias("total"), f[6].alias("seq"))


def block_differences(blocks: DataFrame) -> DataFrame:
    """Differing columns (case aside) of blocks of exactly two rows: (block, differences)."""
    two = blocks.groupBy("block").agg(F.count("*").alias("_n"), F.min(F.upper("seq")).alias("_a"), F.max(F.upper("seq")).alias("_b")).where("_n = 2")
    from helixframe.functions.sequence import hamming

    return two.select("block", hamming(F.col("_a"), F.col("_b")).cast("long").alias("differences"))


def effects(variants: DataFrame, field: str = "EFF") -> DataFrame:
    """One row for each effect in an INFO field of the form NAME(impact|class|codon|amino|length|gene|..),..: chr, pos, ref, alt, effect, impact, gene."""
    items = F.regexp_extract_all(F.col("info")[field], F.lit(r"([^,()]+\([^)]*\))"), 1)
    e = variants.where(F.col("info")[field].isNotNull()).select("chr", "pos", "ref", "alt", F.explode(items).alias("e"))
    inside = F.split(F.regexp_extract("e", r"\(([^)]*)\)", 1), r"\|")
    return e.select("chr", "pos", "ref", "alt", F.trim(F.substring_index("e", "(", 1)).alias("effect"), inside[0].alias("impact"), F.get(inside, F.lit(5)).alias("gene"))


#: Effect names that count as loss of function.
LOSS_OF_FUNCTION = ("STOP_GAINED", "FRAME_SHIFT", "SPLICE_SITE_ACCEPTOR", "SPLICE_SITE_DONOR", "START_LOST", "STOP_LOST")


def loss_of_function(effect_rows: DataFrame) -> DataFrame:
    return effect_rows.where(F.col("effect").isin(*LOSS_OF_FUNCTION))


def allele_counts(variants: DataFrame) -> DataFrame:
    """Genotype counts from INFO by whatever fields there are: AC_Het and AC_Hom with AN_Adj or AN; GTC as homvar,het,homref; else AC and AN under random mating of the count."""
    info = lambda k: F.try_element_at("info", F.lit(k))
    first = lambda c: F.substring_index(c, ",", 1).cast("double")
    n = F.coalesce(info("AN_Adj"), info("AN")).cast("double") / 2
    het, hom = first(info("AC_Het")), first(info("AC_Hom"))
    gtc = F.split(info("GTC"), ",")
    freq = first(info("AC")) / info("AN").cast("double")
    homvar = F.coalesce(hom, F.get(gtc, F.lit(0)).cast("double"), n * freq * freq)
    hets = F.coalesce(het, F.get(gtc, F.lit(1)).cast("double"), 2 * n * freq * (1 - freq))
    homref = F.coalesce(F.when(het.isNotNull(), n - het - hom), F.get(gtc, F.lit(2)).cast("double"), n - homvar - hets)
    return variants.select("chr", "pos", "ref", "alt", homref.alias("homref"), hets.alias("het"), homvar.alias("homvar"))


def imputed_alleles(spark: SparkSession, path: str) -> DataFrame:
    """Beagle probabilities (marker, alleles, then triples): dosage of allele A per individual column."""
    f = F.split(F.trim("value"), r"\s+")
    n = F.floor((F.size(f) - 3) / 3).cast("int")
    at = lambda i, k: F.element_at(f, 3 + 3 * i + k).cast("double")
    rows = formats.lines(spark, path).where(~F.lower("value").startswith("marker"))
    d = F.transform(F.sequence(F.lit(0), n - 1), lambda i: 2 * at(i, 1) + at(i, 2))
    return rows.select(f[0].alias("marker"), f[1].alias("a1"), f[2].alias("a2"), F.posexplode(d).alias("ind", "dosage"))


def keep_imputed(df: DataFrame, info: str = "info", least: float = 0.8, name: str = "snp") -> DataFrame:
    """Markers with an imputation quality above ``least`` and a name other than ``.``."""
    return df.where((F.col(info) > least) & (F.col(name) != "."))


def in_key_set(variants: DataFrame, keys: DataFrame) -> DataFrame:
    """Variants whose (chr, pos, ref, alt) is in a key table."""
    return variants.join(keys.select("chr", "pos", "ref", "alt").distinct(), ["chr", "pos", "ref", "alt"], "left_semi")


def split_alleles(variants: DataFrame) -> DataFrame:
    """One row for each alternative allele, with its number from 1."""
    return variants.select("*", F.posexplode(F.split("alt", ",")).alias("_k", "_alt")).withColumns({"allele": F.col("_k") + 1, "alt": F.col("_alt")}).drop("_k", "_alt")


def essentiality_class(posterior_essential: Column, posterior_dispensable: Column, power: Column) -> Column:
    """essential or dispensable from a posterior of 0.99 on, underpowered below a power of 0.1, else undecided."""
    return F.when(power < 0.1, "underpowered").when(posterior_essential >= 0.99, "essential").when(posterior_dispensable >= 0.99, "dispensable").otherwise("undecided")
