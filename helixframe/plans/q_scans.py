"""Queries: scans with interactions, region-set tests, the recode pipeline, gapped sequences, calls and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import columns, dist, sequence
from helixframe.operators import alignment, counts, frames, scans, sets
from helixframe.plans.q_formats import _line, _text, _written
from helixframe.plans.q_genotype import _G, dosages
from helixframe.plans.q_sequence import _NAMES, names
from helixframe.sources import formats
from helixframe.sources.tables import table


def _people(spark, d):
    """Dosages with two phenotypes, one of them missing for some, and a two-valued covariate."""
    i = F.col("ind")
    return dosages(spark, d).withColumns({"y1": (i * 37 % 101) / 10.0, "y2": F.when(i % 7 != 0, (i * 53 % 97) / 10.0), "c": (i % 2).cast("double"), "chr": F.col("marker") % 2, "pos": F.col("marker") * 100})


def marker_scan_interactions(spark, d):
    """Two phenotypes under two recodings on every marker, with a covariate and its product."""
    got = scans.marker_scan(_people(spark, d), "marker", "dosage", ["y1", "y2"], ["ADD", "DOM"], interaction="c")
    return got.select("phenotype", "model", "marker", "term", (F.round("beta", 5) + 0.0).alias("beta"), "n")


def _regions(spark, d):
    """A region a supplier, in sets by nation."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select((k % 2).alias("chr"), (k * 2000).alias("start"), (k * 2000 + 1500 + F.col("s_nationkey") * 100).alias("end"), F.concat(F.lit("set"), "s_nationkey").alias("region"))


def region_set_scan(spark, d):
    """Overlapping region sets against two phenotypes."""
    got = scans.region_set_tests(_people(spark, d), _regions(spark, d), "chr", "pos", "region", "marker", "ind", "dosage", ["y1", "y2"])
    return got.select("set", "phenotype", "n_markers", "n", *[F.round(c, 5).alias(c) for c in ("q", "burden_slope", "burden_r2")])


def recoded_genotypes(spark, d):
    """The filters of the recode pipeline in their order."""
    g = dosages(spark, d)
    markers = g.select("marker").distinct()
    people = g.select("ind").distinct().where("ind % 2 = 0")
    return scans.recode_pipeline(g, "marker", "ind", "dosage", 0.450003, None, markers.where("marker % 3 <> 0"), 0.495303, 0.071203, markers.where("marker % 10 = 1"), people).select("marker", "ind", F.round("dosage", 4).alias("dosage"))


def _spikes(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("sample"), (F.col("l_partkey") % 50).alias("spike")).agg(F.count("*").alias("n"))


def spike_dose_response(spark, d):
    doses = spark.range(50).select(F.col("id").alias("spike"), (F.col("id") + 1).alias("dose"))
    got = scans.dose_response(_spikes(spark, d), doses, "spike", "sample", "n", "dose")
    return got.select("sample", "n_spikes", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")])


def spike_fold_changes(spark, d):
    return scans.fold_changes(_spikes(spark, d), "spike", "sample", "n").select("spike", "a", "b", F.round("log2_ratio", 6).alias("log2_ratio"))


def regression_by_scale(spark, d):
    """The linear scale and the rank scale of one phenotype."""
    li = table(spark, d, "lineitem")
    linear = scans.fit(li, ["l_returnflag"], "l_extendedprice", ["l_quantity"], "linear").withColumn("scale", F.lit("linear"))
    rank = scans.fit(li, ["l_returnflag"], "l_extendedprice", ["l_quantity"], "rank").withColumn("scale", F.lit("rank"))
    return linear.unionByName(rank).select("scale", "l_returnflag", "term", F.round("beta", 4).alias("beta"), "n")


def confidence_ellipse(spark, d):
    return frames.in_ellipsoid(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 0.95).groupBy("inside").agg(F.count("*").alias("n"))


def _exons(spark, d):
    s = F.col("l_orderkey") * 3
    return table(spark, d, "lineitem").select(F.concat(F.lit("g"), "l_partkey").alias("gene"), F.concat(F.lit("t"), "l_suppkey").alias("transcript"), (F.col("l_partkey") % 5).alias("chr"), s.alias("start"), (s + F.col("l_quantity").cast("long")).alias("end"))


def gene_lengths(spark, d):
    return counts.gene_lengths(_exons(spark, d))


def longest_transcripts(spark, d):
    return counts.longest_transcript(_exons(spark, d))


def numeric_columns(spark, d):
    """Logits, logistic values and a steady log of summed exponentials."""
    o = table(spark, d, "orders").withColumn("p", (F.col("o_orderkey") * 48271 % 2147483647) / 2147483647.0)
    return o.where("p > 0").select("o_orderkey", F.round(columns.logit(F.col("p")), 6).alias("logit"), F.round(columns.logistic(F.col("p") * 10 - 5), 6).alias("logistic"), F.round(columns.logsumexp(F.array(F.col("p") * 1000, F.col("p") * 1000 - 1, F.lit(0.0))), 5).alias("lse"))


def formatted_numbers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", columns.fixed(F.col("o_totalprice"), 2).alias("fixed"), columns.scientific(F.col("o_orderkey") + 0.5, 6).alias("scientific"))


def two_level_coding(spark, d):
    """A column of two values as a boolean, and the 1/2 coding; a third value leaves a column as it is."""
    c = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.when(F.col("o_orderkey") % 2 == 0, "case").otherwise("control")).alias("s"))
    return frames.two_levels(c, "s").select("o_orderkey", F.col("s").alias("flag"), frames.plink_coding(F.col("s")).alias("code"))


def jump_bounds(spark, d):
    return sets.jump(table(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", F.col("o_orderkey") * 2 > 9001)


def gapped_index_map(spark, d):
    s = names(spark, d).select("id", F.regexp_replace("seq", "T", "-").alias("seq"))
    return alignment.index_map(s, "id", "seq").select("id", F.col("column").cast("long").alias("column"), F.col("residue").cast("long").alias("residue"))


def back_alignment(spark, d):
    """A gapped translation back to its codons."""
    s = names(spark, d).where("length(seq) >= 6")
    p = sequence.translate(F.col("seq"))
    gapped = F.concat(F.substring(p, 1, 1), F.lit("-"), p.substr(F.lit(2), F.length(p)), F.lit("-"))
    return s.select("id", alignment.back_aligned(gapped, F.col("seq")).alias("codons"))


def reference_sites(spark, d):
    got = alignment.reference_sites(names(spark, d), "id", "seq", F.lit("ACGTTGCATTACGGTA"), 20)
    return got.select(F.col("pos").cast("long").alias("pos"), "id", "differs")


def variant_calls(spark, d):
    letters = alignment.column_counts(names(spark, d).withColumn("g", F.lit(1)), ["g"], "seq").select(F.col("pos").cast("long").alias("pos"), "letter", "n")
    got = alignment.variant_calls(letters, ["pos"], "letter", "n", 0.1, 100)
    return got.select("pos", "letter", "n", "depth", F.round("share", 6).alias("share"), "major", "minority")


def distribution_tails(spark, d):
    """Tails that have closed forms."""
    v = F.col("value").cast("double")
    e = table(spark, d, "events").select("event_id", "value")
    tails = {"chi2": dist.chisq_upper(v, F.lit(2.0)), "chi4": dist.chisq_upper(v, F.lit(4.0)), "f": dist.f_upper(v, F.lit(2.0), F.lit(10.0)), "t": dist.t_upper(v, F.lit(2.0)), "poisson": dist.poisson_upper(F.lit(2.0), v)}
    return e.select("event_id", *[F.round(c, 8).alias(k) for k, c in tails.items()])


def normal_round_trip(spark, d):
    """The upper tail of the quantile of a probability."""
    o = table(spark, d, "orders").withColumn("p", (F.col("o_orderkey") * 48271 % 2147483647) / 2147483647.0).where("p > 0")
    return o.select("o_orderkey", F.round(1 - dist.normal_upper(dist.normal_quantile(F.col("p"))), 7).alias("p"))


def global_alignment_scores(spark, d):
    """With unit costs the score of a global alignment is the edit distance below zero."""
    p = table(spark, d, "part").select("p_partkey", alignment.align(F.col("p_name"), F.lower("p_type"), "global", None, 1.0, 1.0, 0.0, -1.0).alias("a"))
    return p.select("p_partkey", F.round(F.col("a.score"), 6).alias("score"))


def heritability_rows(spark, d):
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, _line("\t", F.concat(F.lit("V"), _text("c_custkey")), _text("c_acctbal"), "0.5")).otherwise(_line("\t", F.concat(F.lit("n"), _text("c_custkey")), _text("c_nationkey"))).alias("value"))
    return formats.heritability(spark, _written(c, "hsq", "Source\tVariance\tSE"))


def component_scores(spark, d):
    c = table(spark, d, "customer").select(_line("  ", _text("c_custkey"), (F.col("c_nationkey") / 4).cast("string"), _text("c_acctbal"), "Case"))
    return formats.principal_component_scores(spark, _written(c, "evec", "  #eigvals:  2.5  1.5")).select("individual", "population", "component", "score")


QUERIES = {f.__name__: f for f in (marker_scan_interactions, region_set_scan, recoded_genotypes, spike_dose_response, spike_fold_changes, regression_by_scale, confidence_ellipse, gene_lengths, longest_transcripts, numeric_columns, formatted_numbers, two_level_coding, jump_bounds, gapped_index_map, back_alignment, reference_sites, variant_calls, distribution_tails, normal_round_trip, global_alignment_scores, heritability_rows, component_scores)}

_PEOPLE = _G + ", h AS (SELECT marker, ind, dosage, ind % 2 AS c, 'y1' AS phenotype, CAST((ind * 37 % 101) / 10.0 AS DOUBLE) AS y FROM g UNION ALL SELECT marker, ind, dosage, ind % 2, 'y2', CASE WHEN ind % 7 <> 0 THEN CAST((ind * 53 % 97) / 10.0 AS DOUBLE) END FROM g)"
_SCAN = _PEOPLE + ", x AS (SELECT phenotype, 'ADD' AS model, marker, c, y, dosage AS x FROM h UNION ALL SELECT phenotype, 'DOM', marker, c, y, CASE WHEN dosage IS NOT NULL THEN CASE WHEN floor(dosage + 0.5) >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END FROM h), r AS (SELECT phenotype, model, marker, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n, regr_slope(y, x) FILTER (c = 0) AS s0, regr_slope(y, x) FILTER (c = 1) AS s1, regr_intercept(y, x) FILTER (c = 0) AS i0, regr_intercept(y, x) FILTER (c = 1) AS i1, coalesce(least(var_pop(CASE WHEN y IS NOT NULL THEN x END) FILTER (c = 0), var_pop(CASE WHEN y IS NOT NULL THEN x END) FILTER (c = 1)), 0) > 1e-12 AND count(*) FILTER (c = 0 AND x IS NOT NULL AND y IS NOT NULL) > 0 AND count(*) FILTER (c = 1 AND x IS NOT NULL AND y IS NOT NULL) > 0 AS sound FROM x GROUP BY 1, 2, 3)"
_EX = "SELECT 'g' || l_partkey AS gene, 't' || l_suppkey AS transcript, l_orderkey * 3 AS s, l_orderkey * 3 + CAST(l_quantity AS BIGINT) AS e FROM lineitem"
_PP = "SELECT o_orderkey, CAST((o_orderkey * 48271 % 2147483647) / 2147483647.0 AS DOUBLE) AS p FROM orders"
ORACLES = {
    "marker_scan_interactions": _SCAN + " " + " UNION ALL ".join(f"SELECT phenotype, model, marker, '{t}' AS term, CASE WHEN sound THEN round({b}, 5) + 0.0::DOUBLE END AS beta, n FROM r WHERE n > 0" for t, b in (("intercept", "i0"), ("dosage", "s0"), ("c", "i1 - i0"), ("interaction", "s1 - s0"))),
    "region_set_scan": _PEOPLE + """, kk AS (SELECT 'set' || s_nationkey AS "set", s_suppkey % 2 AS chr, s_suppkey * 2000 AS a, s_suppkey * 2000 + 1500 + s_nationkey * 100 AS b FROM supplier), z AS (SELECT DISTINCT kk."set", h.phenotype, h.marker, h.ind, h.dosage AS x, h.y FROM h JOIN kk ON h.marker % 2 = kk.chr AND h.marker * 100 >= a AND h.marker * 100 < b WHERE dosage IS NOT NULL AND y IS NOT NULL),
      p AS (SELECT "set", phenotype, ind, max(y) AS y, sum(x) AS b FROM z GROUP BY 1, 2, 3), s AS (SELECT "set", phenotype, count(*) AS n, var_pop(y) AS v, avg(y) AS m, regr_slope(y, b) AS burden_slope, regr_r2(y, b) AS burden_r2 FROM p GROUP BY 1, 2),
      u AS (SELECT "set", phenotype, marker, sum(x * y) AS xy, sum(x) AS sx FROM z GROUP BY 1, 2, 3) SELECT "set", phenotype, count(*) AS n_markers, any_value(n) AS n, round(sum(pow(xy - sx * m, 2) / v), 5) AS q, round(any_value(burden_slope), 5) AS burden_slope, round(any_value(burden_r2), 5) AS burden_r2 FROM u JOIN s USING ("set", phenotype) GROUP BY 1, 2""",
    "recoded_genotypes": _G + ", m AS (SELECT marker, least(avg(dosage) / 2, 1 - avg(dosage) / 2) AS maf, 1 - count(dosage) / CAST(count(*) AS DOUBLE) AS miss FROM g GROUP BY 1) SELECT marker, ind, round(dosage, 4) AS dosage FROM g JOIN m USING (marker) WHERE maf >= 0.450003 AND marker % 3 <> 0 AND ((maf <= 0.495303 AND miss <= 0.071203) OR marker % 10 = 1) AND ind % 2 = 0",
    "spike_dose_response": "WITH c AS (SELECT l_returnflag AS sample, l_partkey % 50 AS spike, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT sample, count(*) AS n_spikes, round(regr_slope(log2(n), log2(spike + 1)), 6) AS slope, round(regr_intercept(log2(n), log2(spike + 1)), 6) AS intercept, round(regr_r2(log2(n), log2(spike + 1)), 6) AS r2 FROM c GROUP BY 1",
    "spike_fold_changes": "WITH c AS (SELECT l_returnflag AS sample, l_partkey % 50 AS spike, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT x.spike, x.sample AS a, y.sample AS b, round(log2(y.n / CAST(x.n AS DOUBLE)), 6) AS log2_ratio FROM c x JOIN c y ON x.spike = y.spike AND x.sample < y.sample",
    "regression_by_scale": "WITH r AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS k FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice)), s AS (SELECT l_returnflag, count(*) AS n, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, regr_slope(k, x) AS c, regr_intercept(k, x) AS d FROM r GROUP BY 1) " + " UNION ALL ".join(f"SELECT '{k}' AS scale, l_returnflag, '{t}' AS term, round({v}, 4) AS beta, n FROM s" for k, t, v in (("linear", "l_quantity", "a"), ("linear", "intercept", "b"), ("rank", "l_quantity", "c"), ("rank", "intercept", "d"))),
    "confidence_ellipse": "WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) AS vx, var_samp(l_extendedprice) AS vy, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem) SELECT (pow(l_quantity - mx, 2) * vy - 2 * (l_quantity - mx) * (l_extendedprice - my) * c + pow(l_extendedprice - my, 2) * vx) / (vx * vy - c * c) <= -2.0 * ln(1 - 0.95) AS inside, count(*) AS n FROM lineitem, s GROUP BY 1",
    "gene_lengths": f"WITH e AS ({_EX}), m AS (SELECT gene, s, max(e) AS e FROM e GROUP BY 1, 2), w AS (SELECT *, max(e) OVER (PARTITION BY gene ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m) SELECT gene, CAST(sum(greatest(0, e - greatest(s, coalesce(b, s)))) AS BIGINT) AS length FROM w GROUP BY 1",
    "longest_transcripts": f"WITH t AS (SELECT gene, transcript, CAST(sum(e - s) AS BIGINT) AS length FROM ({_EX}) GROUP BY 1, 2) SELECT gene, transcript, length FROM t QUALIFY row_number() OVER (PARTITION BY gene ORDER BY length DESC, transcript) = 1",
    "numeric_columns": f"SELECT o_orderkey, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(5 - p * 10)), 6) AS logistic, round(greatest(p * 1000, 0) + ln(exp(p * 1000 - greatest(p * 1000, 0)) + exp(p * 1000 - 1 - greatest(p * 1000, 0)) + exp(0 - greatest(p * 1000, 0))), 5) AS lse FROM ({_PP}) WHERE p > 0",
    "formatted_numbers": "SELECT o_orderkey, printf('%.2f', o_totalprice) AS fixed, printf('%.6e', CAST(o_orderkey + 0.5 AS DOUBLE)) AS scientific FROM orders",
    "two_level_coding": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 2 <> 0 END AS flag, CASE WHEN o_orderkey % 9 <> 0 THEN CASE WHEN o_orderkey % 2 <> 0 THEN 2 ELSE 1 END END AS code FROM orders",
    "jump_bounds": "SELECT o_orderpriority, max(o_orderkey) FILTER (o_orderkey * 2 <= 9001) AS last_false, min(o_orderkey) FILTER (o_orderkey * 2 > 9001) AS first_true FROM orders GROUP BY 1",
    "gapped_index_map": f"WITH l AS (SELECT id, unnest(range(0, length(seq))) AS \"column\", unnest(string_split(replace(seq, 'T', '-'), '')) AS l FROM ({_NAMES})) SELECT id, \"column\", row_number() OVER (PARTITION BY id ORDER BY \"column\") - 1 AS residue FROM l WHERE l <> '-'",
    "back_alignment": f"SELECT id, substr(seq, 1, 3) || '---' || substr(seq, 4, 3 * (length(seq) // 3 - 1)) || '---' AS codons FROM ({_NAMES}) WHERE length(seq) >= 6",
    "reference_sites": f"WITH l AS (SELECT id, unnest(range(0, least(length(seq), 16))) AS pos, unnest(string_split(left(seq, 16), '')) AS l FROM ({_NAMES})), x AS (SELECT id, pos, l <> substr('ACGTTGCATTACGGTA', CAST(pos + 1 AS INT), 1) AS differs FROM l), s AS (SELECT pos, string_agg(id || CASE WHEN differs THEN '+' ELSE '-' END, ',' ORDER BY id) AS p, string_agg(id || CASE WHEN differs THEN '-' ELSE '+' END, ',' ORDER BY id) AS q FROM x GROUP BY 1 HAVING count_if(differs) >= 20 AND count_if(NOT differs) >= 20), f AS (SELECT min(pos) AS pos FROM s GROUP BY least(p, q)) SELECT pos, id, differs FROM x JOIN f USING (pos)",
    "variant_calls": f"WITH l AS (SELECT unnest(range(0, length(seq))) AS pos, unnest(string_split(seq, '')) AS letter FROM ({_NAMES})), c AS (SELECT pos, letter, count(*) AS n FROM l GROUP BY 1, 2), w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY pos) AS BIGINT) AS depth, row_number() OVER (PARTITION BY pos ORDER BY n DESC, letter) = 1 AS major FROM c) SELECT pos, letter, n, depth, round(n / CAST(depth AS DOUBLE), 6) AS share, major, NOT major AND n / CAST(depth AS DOUBLE) >= 0.1 AS minority FROM w WHERE depth >= 100",
    "distribution_tails": "SELECT event_id, round(exp(-value / 2), 8) AS chi2, round(exp(-value / 2) * (1 + value / 2), 8) AS chi4, round(pow(1 + value / 5, -5), 8) AS f, round(0.5 - value / (2 * sqrt(2 + value * value)), 8) AS t, round(1 - exp(-value) * (1 + value), 8) AS poisson FROM events",
    "normal_round_trip": f"SELECT o_orderkey, round(p, 7) AS p FROM ({_PP}) WHERE p > 0",
    "global_alignment_scores": "SELECT p_partkey, CAST(0 - levenshtein(p_name, lower(p_type)) AS DOUBLE) AS score FROM part",
    "heritability_rows": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'V' ELSE 'n' END || c_custkey AS source, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE c_nationkey END AS value, CASE WHEN c_custkey % 2 = 0 THEN CAST(0.5 AS DOUBLE) END AS se FROM customer",
    "component_scores": "SELECT CAST(c_custkey AS VARCHAR) AS individual, 'Case' AS population, 0 AS component, CAST(c_nationkey / 4 AS DOUBLE) AS score FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'Case', 1, c_acctbal FROM customer",
}
