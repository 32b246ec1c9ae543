"""Writers: every one is a distributed text or CSV write; headers go with each part file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Missing, male and female codes of the covariate dialects.
DIALECTS = {"r": ("NA", "M", "F"), "plink_covar": ("-9", "1", "2"), "plink_fam": ("-9", "1", "2"), "emmax": ("NA", "1", "2")}


def csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """Quoted only where needed, quotes doubled."""
    df.write.option("header", True).option("sep", separator).option("quote", '"').option("escape", '"').csv(path)


def wrapped(seq: Column, width: int) -> Column:
    """A sequence cut into lines."""
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def fasta(df: DataFrame, path: str, id_col: str, seq: str, width: int = 80) -> None:
    df.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), wrapped(F.col(seq), width)).alias("value")).write.text(path)


def formatted_table(df: DataFrame, path: str, dialect: str, sex: str | None = None) -> None:
    """Blank-separated columns by a dialect's codes: null, booleans as 1/2 (or TRUE/FALSE in r), sex by its codes."""
    missing, male, female = DIALECTS[dialect]

    def cell(name: str, kind: str) -> Column:
        c = F.col(name)
        if name == sex:
            c = F.when(c == 1, male).when(c == 2, female)
        elif kind == "boolean":
            c = F.when(c, "TRUE" if dialect == "r" else "2").when(~c, "FALSE" if dialect == "r" else "1")
        return F.coalesce(c.cast("string"), F.lit(missing)).alias(name)

    df.select(*[cell(n, t) for n, t in df.dtypes]).write.option("header", dialect in ("r", "plink_covar")).option("sep", " ").csv(path)


def split_by_key(df: DataFrame, path: str, key: str) -> None:
    """One folder a value of ``key``; rows of a value are written by as many tasks as hold them."""
    df.write.partitionBy(key).option("header", True).csv(path)


def significant(df: DataFrame, p: str, threshold: float) -> DataFrame:
    """Rows with p <= threshold (NaN and null never pass); a threshold of 1 keeps all rows."""
    return df if threshold == 1 else df.where(F.col(p).isNotNull() & ~F.isnan(p) & (F.col(p) <= threshold))


def dosage_text(df: DataFrame, path: str, snp: str, a1: str, a2: str, individual: str, dosage: str, individuals: Sequence[str], missing: float = -9.0) -> None:
    """Markers as lines: snp a1 a2 and a dosage an individual, in the given order."""
    by = df.groupBy(snp, a1, a2).agg(F.map_from_entries(F.collect_list(F.struct(F.col(individual).cast("string"), F.coalesce(dosage, F.lit(missing))))).alias("_m"))
    each = F.transform(F.lit(list(individuals)), lambda i: F.format_string("%.4f", F.coalesce(F.try_element_at("_m", i), F.lit(missing))))
    by.select(F.concat_ws(" ", snp, a1, a2, each).alias("value")).write.text(path)


def bim_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", "chr", "snp", F.coalesce(F.col("cm"), F.lit(0.0)).cast("string"), F.col("bp").cast("string"), "a1", "a2").alias("value"))


def hard_calls(probability: float, dosage: Column) -> Column:
    """Dosage to the three genotype probabilities, piecewise linear; ``probability`` is the least a hard call needs."""
    hom, het = F.greatest(F.lit(0.0), dosage - 1), F.when(dosage <= 1, dosage).otherwise(2 - dosage)
    ref = F.greatest(F.lit(0.0), 1 - dosage)
    call = F.when(hom >= probability, 2).when(het >= probability, 1).when(ref >= probability, 0)
    return F.struct(hom.alias("hom"), het.alias("het"), ref.alias("ref"), call.alias("call"))


def grm_text(df: DataFrame, path: str) -> None:
    """Lower triangle lines: i, j, n, value."""
    df.where("i >= j").select(F.concat_ws("\t", F.col("i").cast("string"), F.col("j").cast("string"), F.col("n").cast("string"), F.format_string("%.8g", F.col("value"))).alias("value")).write.text(path)


def vcf_lines(df: DataFrame) -> DataFrame:
    """Site rows (chr, pos, id, ref, alt, qual, filter, info map) as the eight leading columns; nulls as dots, INFO keys in order."""
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"] == "true", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return df.select(F.concat_ws("\t", "chr", F.col("pos").cast("string"), dot("id"), "ref", "alt", dot("qual"), dot("filter"), F.when(F.coalesce(F.size("info"), F.lit(0)) > 0, info).otherwise(".")).alias("value"))


def association(df: DataFrame, path: str) -> None:
    """Result rows under the header SNP CHR BP A1 BETA SE P; nulls as NA."""
    names = {"snp": "SNP", "chr": "CHR", "bp": "BP", "a1": "A1", "beta": "BETA", "se": "SE", "p": "P"}
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(n) for c, n in names.items()]).write.option("header", True).option("sep", " ").csv(path)


def genotype_store(df: DataFrame, path: str, snp: str, individual: str, dosage: str) -> None:
    """Long dosages as Parquet dealt out by ranges of the marker and sorted, so that a marker's rows stand in few row groups."""
    df.select(F.col(snp).cast("string").alias("snp"), F.col(individual).cast("string").alias("individual"), F.col(dosage).alias("dosage")).repartitionByRange("snp").sortWithinPartitions("snp", "individual").write.parquet(path)


def text_lines(df: DataFrame, path: str, header: str | None = None) -> None:
    """One text column as lines; a header line in a file of its own, which readers know by what it holds."""
    df.write.text(path)
    if header is not None:
        df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("append").text(path)


def genotype_probabilities(df: DataFrame, path: str, site: Sequence[str], individual: str, dosage: str, individuals: Sequence[str]) -> None:
    """Site columns (chr, snp, bp, a1, a2) and the three probabilities of each individual's dosage; missing ones are zeros."""
    by = df.groupBy(*site).agg(F.map_from_entries(F.collect_list(F.struct(F.col(individual).cast("string"), F.col(dosage)))).alias("_m"))
    each = F.transform(F.transform(F.lit(list(individuals)), lambda i: F.try_element_at("_m", i)), lambda x: hard_calls(1.0, x))
    triples = F.transform(each, lambda p: F.format_string("%.4f %.4f %.4f", *[F.coalesce(p[k], F.lit(0.0)) for k in ("hom", "het", "ref")]))
    by.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in site], triples).alias("value")).write.text(path)


def tped(df: DataFrame, path: str, site: Sequence[str], individual: str, dosage: str, individuals: Sequence[str], probability: float) -> None:
    """Hard calls: chr, snp, 0, bp and two letters an individual; a call under ``probability`` is ``0 0``. ``site`` is chr, snp, bp, a1, a2."""
    by = df.groupBy(*site).agg(F.map_from_entries(F.collect_list(F.struct(F.col(individual).cast("string"), F.col(dosage)))).alias("_m"))
    a1, a2 = F.col(site[3]), F.col(site[4])

    def letters(dosage: Column) -> Column:
        call = hard_calls(probability, dosage)["call"]
        return F.when(call == 2, F.concat_ws(" ", a1, a1)).when(call == 1, F.concat_ws(" ", a1, a2)).when(call == 0, F.concat_ws(" ", a2, a2)).otherwise("0 0")

    each = F.transform(F.transform(F.lit(list(individuals)), lambda i: F.try_element_at("_m", i)), letters)
    chr_, snp, bp = (F.col(c).cast("string") for c in site[:3])
    by.select(F.concat_ws(" ", chr_, snp, F.lit("0"), bp, each).alias("value")).write.text(path)
