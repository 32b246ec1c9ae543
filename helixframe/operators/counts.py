"""Read counting, coverage and expression normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from helixframe.operators import intervals
from helixframe.session import stored


def count_reads(reads: DataFrame, features: DataFrame, width: int = 10_000, min_quality: int = 10, stranded: str = "no") -> DataFrame:
    """(gene, n): reads over exactly one gene's features; the rest in ``__alignment_not_unique``, ``__too_low_aQual``, ``__no_feature`` and ``__ambiguous``.

    reads: name, chr, start, end, strand, mapq, nh. features: gene, chr, start,
    end, strand. stranded: no, yes or reverse. Multi-mapped reads are set
    aside before quality is looked at. No reads give no rows.
    """
    r = reads.withColumn("_id", F.monotonically_increasing_id())
    bucket = F.when(F.col("nh") > 1, "__alignment_not_unique").when(F.col("mapq") < min_quality, "__too_low_aQual")
    r = r.withColumn("_bucket", bucket)
    hits = intervals.overlap_join(r.where("_bucket IS NULL").select("_id", "chr", "start", "end", "strand"), features.select("gene", "chr", "start", "end", "strand"), "chr", width)
    if stranded != "no":
        same = F.col("strand") == F.col("strand_b")
        hits = hits.where(same if stranded == "yes" else ~same)
    genes = hits.groupBy("_id").agg(F.min("gene_b").alias("_g"), F.max("gene_b").alias("_h"))
    found = r.select("_id", "_bucket").join(genes, "_id", "left")
    label = F.coalesce("_bucket", F.when(F.col("_g").isNull(), "__no_feature").when(F.col("_g") != F.col("_h"), "__ambiguous").otherwise(F.col("_g")))
    got = found.groupBy(label.alias("gene")).agg(F.count("*").alias("n"))
    names = features.select("gene").distinct()
    buckets = reads.sparkSession.createDataFrame([(b,) for b in ("__no_feature", "__ambiguous", "__too_low_aQual", "__alignment_not_unique")], "gene string")
    every = names.unionByName(buckets).crossJoin(F.broadcast(reads.limit(1).select(F.lit(1).alias("_any")))).drop("_any")
    return every.join(got, "gene", "left").select("gene", F.coalesce("n", F.lit(0)).alias("n"))


def gene_lengths(features: DataFrame) -> DataFrame:
    """Union length of each gene's features."""
    one = intervals.collapse(features.select(F.concat_ws("|", "gene", "chr").alias("_k"), "start", "end"), "_k")
    return one.groupBy(F.substring_index("_k", "|", 1).alias("gene")).agg(F.sum(F.col("end") - F.col("start")).alias("length"))


def longest_transcript(exons: DataFrame) -> DataFrame:
    """The transcript with the greatest sum of exon lengths per gene, ties to the lesser name."""
    t = exons.groupBy("gene", "transcript").agg(F.sum(F.col("end") - F.col("start")).alias("length"))
    best = t.groupBy("gene").agg(F.min(F.struct((-F.col("length")).alias("m"), "transcript", "length")).alias("b"))
    return best.select("gene", "b.transcript", "b.length")


def size_factors(counts: DataFrame, gene: str, sample: str, n: str) -> DataFrame:
    """Median of ratios to the geometric mean per gene, over genes with counts in every sample."""
    samples = counts.agg(F.countDistinct(sample).alias("_s"))
    g = counts.where(F.col(n) > 0).groupBy(gene).agg(F.exp(F.avg(F.log(n))).alias("_gm"), F.countDistinct(sample).alias("_k"))
    g = g.crossJoin(F.broadcast(samples)).where("_k = _s").select(gene, "_gm")
    return counts.join(g, gene).groupBy(sample).agg(F.percentile(F.col(n) / F.col("_gm"), 0.5).alias("size_factor"))


def total_count_factors(counts: DataFrame, sample: str, n: str) -> DataFrame:
    """Library totals over their mean."""
    t = counts.groupBy(sample).agg(F.sum(n).alias("_t"))
    return t.select(sample, (F.col("_t") / F.avg("_t").over(Window.partitionBy())).alias("size_factor"))  # a row a sample


def rpkm(counts: DataFrame, lengths: DataFrame, gene: str, sample: str, n: str, length: str) -> DataFrame:
    """1e9 n / (length * library total); 0 without a length."""
    t = counts.groupBy(sample).agg(F.sum(n).alias("_t"))
    j = counts.join(lengths.select(gene, length), gene, "left").join(t, sample)
    return j.select(gene, sample, F.when(F.col(length) > 0, F.col(n) * 1e9 / (F.col(length) * F.col("_t"))).otherwise(0.0).alias("rpkm"))


def row_moments(counts: DataFrame, gene: str, n: str) -> DataFrame:
    return counts.groupBy(gene).agg(F.avg(n).alias("mean"), F.var_samp(n).alias("variance"))


def filter_low(counts: DataFrame, gene: str, sample: str, n: str, least: float, share: float) -> DataFrame:
    """Genes with counts of ``least`` or more in at least ``share`` of the samples."""
    samples = counts.agg(F.countDistinct(sample).alias("_s"))
    keep = counts.groupBy(gene).agg(F.count_if(F.col(n) >= least).alias("_k")).crossJoin(F.broadcast(samples)).where(F.col("_k") >= share * F.col("_s")).select(gene)
    return counts.join(keep, gene, "left_semi")


def batch_axes(df: DataFrame, gene: str, sample: str, n: str, controls: DataFrame, k: int) -> DataFrame:
    """(sample, component, score): the first k components of the samples' log(count + 1) over control genes, each gene less its mean. The samples' products are one aggregation over genes; every gene has a row in every sample."""
    from helixframe.operators.models import gram_components

    rows = df.join(controls.select(gene).distinct(), gene, "left_semi").select(gene, sample, F.log1p(F.col(n).cast("double")).alias("_v"))
    mean = rows.groupBy(gene).agg(F.avg("_v").alias("_m"))
    rows = rows.join(mean, gene).select(gene, sample, (F.col("_v") - F.col("_m")).alias("_v"))
    a, b = rows.select(gene, F.col(sample).alias("i"), F.col("_v").alias("_x")), rows.select(gene, F.col(sample).alias("j"), F.col("_v").alias("_y"))
    gram = a.join(b, gene).where("i >= j").groupBy("i", "j").agg(F.sum(F.col("_x") * F.col("_y")).alias("value"))
    return gram_components(gram, k)[0].select(F.col("i").alias(sample), "component", "score")


def without_unwanted(df: DataFrame, gene: str, sample: str, n: str, controls: DataFrame, k: int) -> DataFrame:
    """(gene, sample, residual): counts less what a Poisson regression on the control genes' k components explains, a gene whose least residual is negative lifted to 0.

    Genes whose regression fails are left out.
    """
    from helixframe.operators.models import glm

    axes = batch_axes(df, gene, sample, n, controls, k).groupBy(sample).agg(*[F.max(F.when(F.col("component") == c, F.col("score"))).alias(f"_c{c}") for c in range(k)])
    rows = stored(df.join(axes, sample), "counts")
    names = [f"_c{c}" for c in range(k)]
    fits = glm(rows, [gene], n, names, "poisson").groupBy(gene).agg(*[F.max(F.when(F.col("term") == t, F.col("beta"))).alias(f"_b{i}") for i, t in enumerate(["intercept", *names])])
    eta = sum((F.col(f"_b{i + 1}") * F.col(c) for i, c in enumerate(names)), F.col("_b0"))
    left = rows.join(fits.where("_b0 IS NOT NULL"), gene).select(gene, sample, (F.col(n) - F.exp(eta)).alias("_r"))
    least = left.groupBy(gene).agg(F.least(F.min("_r"), F.lit(0.0)).alias("_least"))
    return left.join(least, gene).select(gene, sample, (F.col("_r") - F.col("_least")).alias("residual"))
