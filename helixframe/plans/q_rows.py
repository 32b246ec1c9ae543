"""Queries: alignments in every mode, trees from text, variant keys, nested models, small table work."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import sequence
from helixframe.operators import alignment, frames, genotype, models, progressive, pruning, tree
from helixframe.plans.q_genotype import dosages
from helixframe.plans.q_sequence import _DNA, _NAMES, dna, names
from helixframe.sources import annotations
from helixframe.sources.tables import table


def _two(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", F.lower("p_type").alias("t"))


def local_alignment_scores(spark, d):
    """Where anything but a match costs more than all letters, a local score is the longest common run."""
    a = alignment.align(F.col("p_name"), F.col("t"), "local", None, 1000.0, 1000.0, 1.0, -1000.0)
    return _two(spark, d).select("p_partkey", F.round(a["score"], 6).alias("score"))


def fitting_alignment_scores(spark, d):
    """With unit costs the first four letters fit anywhere at the fewest edits, below zero."""
    a = alignment.align(F.col("t"), F.substring("p_name", 1, 4), "fitting", None, 1.0, 1.0, 0.0, -1.0)
    return _two(spark, d).select("p_partkey", F.round(a["score"], 6).alias("score"))


def overlap_alignment_scores(spark, d):
    """The longest end of a name that starts its other half."""
    half = F.floor(F.length("p_name") / 2).cast("int")
    a = alignment.align(F.col("p_name"), F.col("p_name").substr(half, F.length("p_name")), "overlap", None, 1000.0, 1000.0, 1.0, -1000.0)
    return _two(spark, d).select("p_partkey", F.round(a["score"], 6).alias("score"))


def common_subsequences(spark, d):
    """A longest common subsequence is one of both texts: its letters in order."""
    s = alignment.lcs_subsequence(F.col("p_name"), F.col("t"))
    return _two(spark, d).select("p_partkey", F.length(s).alias("length"))


def _newick(spark, d):
    """A tree a nation: customers by sevenths of their keys, with supports and lengths."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    leaf = F.concat(F.lit("c"), k, F.lit(":0.5"))
    mids = c.groupBy("c_nationkey", (k % 7).alias("m")).agg(F.array_join(F.sort_array(F.collect_list(leaf)), ",").alias("s"))
    mids = mids.groupBy("c_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("m", "s"))), lambda x: F.concat(F.lit("("), x["s"], F.lit(")"), (x["m"] * 10 + 35).cast("string"), F.lit(":2"))), ",").alias("s"))
    return mids.select("c_nationkey", F.concat(F.lit("("), "s", F.lit(");")).alias("text"))


def newick_leaves(spark, d):
    """Edges of the trees' texts; the leaves' ones."""
    got = tree.newick_edges(_newick(spark, d), "c_nationkey", "text")
    return got.where("leaf").select("c_nationkey", F.col("child").alias("leaf"), "length")


def newick_supports(spark, d):
    """How many splits of two leaves and more a support of at least 0.6 leaves."""
    got = tree.newick_splits(_newick(spark, d), "c_nationkey", "text", 0.6)
    return got.select("c_nationkey", F.size("side").alias("leaves"), F.round("support", 4).alias("support"))


def _variants(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select((k % 22 + 1).cast("string").alias("chr"), (k * 10).alias("pos"), F.lit("A").alias("ref"), F.when(k % 5 == 0, "G,T").otherwise("G").alias("alt"), F.concat(F.when(k % 8 == 0, ".").otherwise(F.concat(F.lit("rs"), k))).alias("snp"), (F.col("p_size") / 64).alias("info"))


def alleles_in_key_set(spark, d):
    """Alternatives one a row, those among the keys of other parts' variants."""
    v = annotations.split_alleles(_variants(spark, d))
    keys = v.where("pos % 30 = 0").unionByName(v.where("pos % 50 = 0")).withColumn("alt", F.when(F.col("pos") % 20 == 0, "C").otherwise(F.col("alt")))
    return annotations.in_key_set(v, keys).select("chr", "pos", "alt", "allele")


def annotated_counts(spark, d):
    """Variants beside counts by their whole key."""
    v = annotations.split_alleles(_variants(spark, d))
    n = table(spark, d, "lineitem").groupBy((F.col("l_partkey") * 10).alias("pos")).agg(F.count("*").alias("n")).withColumns({"ref": F.lit("A"), "alt": F.lit("G")})
    return v.join(n.join(v.select("chr", "pos").distinct(), "pos"), ["chr", "pos", "ref", "alt"]).select("chr", "pos", "alt", "n")


def imputed_markers(spark, d):
    return annotations.keep_imputed(_variants(spark, d), least=0.4).select("snp", "pos")


def essentiality_classes(spark, d):
    o = table(spark, d, "orders").withColumn("q", F.col("o_orderkey") % 1000 / 1000)
    return o.select("o_orderkey", annotations.essentiality_class(F.col("q"), 1 - F.col("q"), (F.col("o_orderkey") % 13 / 13)).alias("class"))


def renamed_distinct_columns(spark, d):
    """Columns equal to an earlier one go, one is renamed, a name that is not there changes nothing."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_acctbal").alias("same"), "c_nationkey", (F.col("c_nationkey") + 0).alias("also"))
    return frames.rename(frames.equal_columns(c, ["c_acctbal", "same", "c_nationkey", "also"]), {"c_acctbal": "balance", "none": "x"})


def likelihood_ratios(spark, d):
    """Prices on quantity and discount against prices alone."""
    li = table(spark, d, "lineitem").withColumn("one", F.col("l_extendedprice") * 1.0)
    by = ["l_returnflag"]
    got = models.nested_models(models.ols(li, by, "l_extendedprice", []), models.ols(li, by, "l_extendedprice", ["l_quantity", "l_discount"]), by, 1, 3)
    return got.select("l_returnflag", F.round("statistic", 4).alias("statistic"), F.round("p", 9).alias("p"), F.round("bic_small", 3).alias("bic_small"), F.round("bic_large", 3).alias("bic_large"))


def unrelated_individuals(spark, d):
    """Suppliers that stay when those with most low relatedness values go one by one."""
    g = genotype.gram(dosages(spark, d), "marker", "ind", "dosage")
    return pruning.drop_related(g, "i", "j", "value", -0.25).select(F.col("name").alias("ind"))


def hypermutation_ratios(spark, d):
    """Texts' letters against the same with some G as A."""
    s = dna(spark, d).where("seq IS NOT NULL")
    changed = F.regexp_replace(F.regexp_replace("seq", "GGT", "AGT"), "GCA", "ACA")
    got = s.select("doc_id", alignment.hypermutation(F.col("seq"), changed).alias("c"))
    return got.select("doc_id", "c.*", *[F.round(x, 6).alias(n) for x, n in zip(alignment.hypermutation_ratios(F.col("c")), ("odds_ratio", "rate_ratio", "phi"))])


def ambiguous_codons(spark, d):
    """The first three letters of parts' names, as IUPAC codes."""
    p = table(spark, d, "part").select("p_partkey", F.upper(F.substring("p_name", 1, 3)).alias("codon"))
    p = p.where(p.codon.rlike("^[ACGTRYSWKMBDHVN]{3}$")).withColumn("possible", sequence.possible_amino_acids("codon"))
    return p.select("p_partkey", F.array_join("possible", "").alias("possible"), sequence.ambiguous_amino_acid(F.col("possible")).alias("amino"), sequence.codon_matches(F.col("codon"), F.col("possible"), F.lit("X")).alias("x"))


def broken_stick(spark, d):
    return models.explained(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).select("component", F.round("eigenvalue", 8).alias("eigenvalue"), F.round("expected", 8).alias("expected"), "useful")


def family_alignments(spark, d):
    """Parts' letters in 150 families aligned: residues as they were, one width a family."""
    s = names(spark, d).withColumn("family", F.col("id") % 150)
    got = progressive.align_families(s, "family", "id", "seq")
    width = got.groupBy(F.col("family").alias("f")).agg((F.countDistinct(F.length("aligned")) == 1).alias("even"))
    return got.join(width, F.col("family") == F.col("f")).select("id", F.replace("aligned", F.lit("-"), F.lit("")).alias("residues"), "even")


QUERIES = {f.__name__: f for f in (local_alignment_scores, fitting_alignment_scores, overlap_alignment_scores, common_subsequences, newick_leaves, newick_supports, alleles_in_key_set, annotated_counts, imputed_markers, essentiality_classes, renamed_distinct_columns, likelihood_ratios, unrelated_individuals, hypermutation_ratios, ambiguous_codons, broken_stick, family_alignments)}

_T = "SELECT p_partkey, p_name AS a, lower(p_type) AS t FROM part"
_SUB = "SELECT DISTINCT p_partkey, t, a, substr(t, CAST(i AS INT), CAST(n AS INT)) AS s FROM x, range(1, 40) r(i), range(0, 40) q(n) WHERE i <= length(t) AND i + n - 1 <= length(t)"
_V = "SELECT CAST(p_partkey % 22 + 1 AS VARCHAR) AS chr, p_partkey * 10 AS pos, unnest(CASE WHEN p_partkey % 5 = 0 THEN ['G', 'T'] ELSE ['G'] END) AS alt, unnest(CASE WHEN p_partkey % 5 = 0 THEN [1, 2] ELSE [1] END) AS allele FROM part"
_MID = "SELECT c_nationkey, c_custkey % 7 AS m, count(*) AS n, min('c' || c_custkey) AS first FROM customer GROUP BY 1, 2"
ORACLES = {
    "local_alignment_scores": f"WITH x AS ({_T}) SELECT p_partkey, CAST(coalesce(max(length(s)) FILTER (contains(a, s)), 0) AS DOUBLE) AS score FROM ({_SUB}) GROUP BY 1",
    "fitting_alignment_scores": f"WITH x AS ({_T}) SELECT p_partkey, CAST(-min(levenshtein(s, left(a, 4))) AS DOUBLE) AS score FROM ({_SUB}) GROUP BY 1",
    "overlap_alignment_scores": "WITH x AS (SELECT p_partkey, p_name AS a, substr(p_name, CAST(length(p_name) // 2 AS INT)) AS b FROM part) SELECT p_partkey, CAST(max(CASE WHEN right(a, CAST(n AS INT)) = left(b, CAST(n AS INT)) AND n <= length(b) THEN n ELSE 0 END) AS DOUBLE) AS score FROM x, range(0, 40) r(n) WHERE n <= length(a) GROUP BY 1",
    "newick_leaves": "SELECT c_nationkey, 'c' || c_custkey AS leaf, CAST(0.5 AS DOUBLE) AS length FROM customer",
    "newick_supports": f"WITH m AS ({_MID}), t AS (SELECT c_nationkey, sum(n) AS total, min(first) AS first, max(m * 10 + 35) AS most FROM m GROUP BY 1), s AS (SELECT m.c_nationkey, (m * 10 + 35) / CAST(most AS DOUBLE) AS support, CASE WHEN m.first = t.first THEN total - n ELSE n END AS leaves, total FROM m JOIN t USING (c_nationkey)) SELECT c_nationkey, CAST(leaves AS INTEGER) AS leaves, round(support, 4) AS support FROM s WHERE leaves > 1 AND leaves < total - 1 AND support >= 0.6",
    "alleles_in_key_set": f"WITH v AS ({_V}) SELECT chr, pos, alt, allele FROM v WHERE (pos % 30 = 0 OR pos % 50 = 0) AND pos % 20 <> 0",
    "annotated_counts": f"WITH v AS ({_V}), n AS (SELECT l_partkey * 10 AS pos, count(*) AS n FROM lineitem GROUP BY 1) SELECT chr, pos, alt, n FROM v JOIN n USING (pos) WHERE alt = 'G'",
    "imputed_markers": "SELECT 'rs' || p_partkey AS snp, p_partkey * 10 AS pos FROM part WHERE p_size / 64 > 0.4 AND p_partkey % 8 <> 0",
    "essentiality_classes": "SELECT o_orderkey, CASE WHEN o_orderkey % 13 / 13 < 0.1 THEN 'underpowered' WHEN o_orderkey % 1000 >= 990 THEN 'essential' WHEN o_orderkey % 1000 <= 10 THEN 'dispensable' ELSE 'undecided' END AS class FROM orders",
    "renamed_distinct_columns": "SELECT c_custkey, c_acctbal AS balance, c_nationkey FROM customer",
    "likelihood_ratios": "WITH s AS (SELECT l_returnflag, count(*) AS n, var_pop(l_extendedprice) AS v, corr(l_extendedprice, l_quantity) AS a, corr(l_extendedprice, l_discount) AS b, corr(l_quantity, l_discount) AS c FROM lineitem GROUP BY 1), r AS (SELECT *, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS r2 FROM s), l AS (SELECT *, -n / 2 * (ln(2 * pi() * v) + 1) AS l0, -n / 2 * (ln(2 * pi() * v * (1 - r2)) + 1) AS l1 FROM r) SELECT l_returnflag, round(2 * (l1 - l0), 4) AS statistic, round(exp(l0 - l1), 9) AS p, round(ln(n) - 2 * l0, 3) AS bic_small, round(3 * ln(n) - 2 * l1, 3) AS bic_large FROM l",
    "hypermutation_ratios": f"""WITH t AS (SELECT doc_id, seq AS r, regexp_replace(regexp_replace(seq, 'GGT', 'AGT', 'g'), 'GCA', 'ACA', 'g') AS s FROM ({_DNA}) WHERE seq IS NOT NULL), p AS (SELECT doc_id, r, s, unnest(range(1, length(r) - 1)) AS i FROM t),
      x AS (SELECT doc_id, substr(r, i, 3) AS a, substr(s, i, 3) AS b FROM p WHERE substr(r, i, 1) = 'G'), y AS (SELECT doc_id, regexp_matches(a, 'G[AG][^C]') AS k, b = 'A' || substr(a, 2) AS h, b = a AS e FROM x),
      c AS (SELECT t.doc_id, coalesce(count_if(k AND h), 0)::BIGINT AS mutated, coalesce(count_if(k AND (h OR e)), 0)::BIGINT AS possible, coalesce(count_if(NOT k AND h), 0)::BIGINT AS control_mutated, coalesce(count_if(NOT k AND (h OR e)), 0)::BIGINT AS control_possible FROM t LEFT JOIN y USING (doc_id) GROUP BY 1),
      z AS (SELECT *, mutated::DOUBLE AS a, control_mutated::DOUBLE AS b, (possible - mutated)::DOUBLE AS c, (control_possible - control_mutated)::DOUBLE AS d FROM c)
      SELECT doc_id, mutated, possible, control_mutated, control_possible, CASE WHEN c > 0 AND d > 0 AND b > 0 THEN round(a / c / (b / d), 6) END AS odds_ratio, CASE WHEN a + c > 0 AND b > 0 THEN round(a / (a + c) / (b / (b + d)), 6) END AS rate_ratio,
        CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN round((a * d - b * c) / sqrt((a + b) * (c + d) * (a + c) * (b + d)), 6) END AS phi FROM z""",
    "ambiguous_codons": "WITH m(l, bs) AS (VALUES ('A', 'A'), ('C', 'C'), ('G', 'G'), ('T', 'T'), ('R', 'AG'), ('Y', 'CT'), ('S', 'CG'), ('W', 'AT'), ('K', 'GT'), ('M', 'AC'), ('B', 'CGT'), ('D', 'AGT'), ('H', 'ACT'), ('V', 'ACG'), ('N', 'ACGT')), b AS (SELECT l, strpos('TCAG', unnest(string_split(bs, ''))) - 1 AS n FROM m), p AS (SELECT p_partkey, upper(left(p_name, 3)) AS c FROM part WHERE regexp_full_match(upper(left(p_name, 3)), '[ACGTRYSWKMBDHVN]{3}')),"
    " a AS (SELECT DISTINCT p_partkey, c, substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(16 * x.n + 4 * y.n + z.n + 1 AS INT), 1) AS a FROM p JOIN b x ON x.l = c[1] JOIN b y ON y.l = c[2] JOIN b z ON z.l = c[3]) SELECT p_partkey, string_agg(a, '' ORDER BY a) AS possible, CASE WHEN count(*) = 1 THEN min(a) ELSE 'X' END AS amino, regexp_matches(any_value(c), '[^ACGT]') AS x FROM a GROUP BY 1",
    "broken_stick": "WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem) SELECT CAST(k AS INTEGER) AS component, round(CASE WHEN k = 0 THEN 1 + r ELSE 1 - r END, 8) AS eigenvalue, CAST(1.5 - k AS DOUBLE) AS expected, CASE WHEN k = 0 THEN 1 + r ELSE 1 - r END > 1.5 - k AS useful FROM r, range(2) t(k)",
    "family_alignments": f"SELECT id, seq AS residues, true AS even FROM ({_NAMES})",
}
