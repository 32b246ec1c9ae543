"""Alignments: column statistics as aggregates; pairwise dynamic programming as vectorised functions over pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from helixframe.functions import sequence


def letters(df: DataFrame, by: Sequence[str], seq: str) -> DataFrame:
    """One row a letter: (.., pos from 0, letter)."""
    return df.select(*by, F.posexplode(F.split(F.col(seq), "")).alias("pos", "letter")).where("letter <> ''")


def column_counts(df: DataFrame, by: Sequence[str], seq: str, upper: bool = True) -> DataFrame:
    """Letter counts of every column: each Arrow batch is counted in numpy first, so what is shuffled is a row a place and letter and batch, not a letter."""
    rows = df.select(*by, F.col(seq).alias("_seq"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "_seq") + "pos int, letter string, n long"
    names, last = list(rows.columns[:-1]), len(rows.columns) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, first = np.zeros(batch.num_rows, np.int64), np.zeros(min(1, batch.num_rows), np.int64)
            if names and batch.num_rows:
                seen: dict = {}
                group = np.array([seen.setdefault(k, len(seen)) for k in zip(*[batch.column(i).to_pylist() for i in range(last)])])
                first = np.unique(group, return_index=True)[1]
            texts = [np.frombuffer((t.as_py() or "").encode("utf-32-le"), "<u4") for t in batch.column(last)]
            size = np.array([len(t) for t in texts], np.int64)
            if not size.sum():
                continue
            alphabet, code = np.unique(np.concatenate(texts), return_inverse=True)
            width = int(size.max())
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            cell, n = np.unique((np.repeat(group, size) * width + place) * len(alphabet) + code, return_counts=True)
            letter = alphabet[cell % len(alphabet)].astype("<u4").view("<U1")
            cell //= len(alphabet)
            keys = [batch.column(i).take(pa.array(first[cell // width])) for i in range(last)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array((cell % width).astype(np.int32)), pa.array(letter.tolist(), pa.string()), pa.array(n, pa.int64())], [*names, "pos", "letter", "n"])

    counted = rows.mapInArrow(count, schema)
    return counted.groupBy(*by, "pos", (F.upper("letter") if upper else F.col("letter")).alias("letter")).agg(F.sum("n").alias("n"))


def consensus(df: DataFrame, by: Sequence[str], seq: str, missing: str = "-", least_share: float = 0.0, no_call: str = "N") -> DataFrame:
    """Most frequent letter of every column, missing ones aside, ties to the lesser letter; ``no_call`` below ``least_share``."""
    counts = column_counts(df, by, seq).where(~F.col("letter").isin(*missing))
    best = counts.groupBy(*by, "pos").agg(F.min(F.struct((-F.col("n")).alias("m"), "letter", "n")).alias("b"), F.sum("n").alias("total"))
    letter = F.when(F.col("b.n") < least_share * F.col("total"), F.lit(no_call)).otherwise(F.col("b.letter"))
    best = best.select(*by, "pos", letter.alias("letter"))
    return best.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "").alias("consensus"))  # bounded by the alignment's width


def mask_columns(seq: Column, positions: Sequence[int], mask: str = "N") -> Column:
    """Letters at the given places (from 0) replaced."""
    at = F.array(*[F.lit(int(p)) for p in positions])
    return F.array_join(F.transform(F.split(seq, ""), lambda c, i: F.when(F.array_contains(at, i), F.lit(mask)).otherwise(c)), "")


def delete_columns(seq: Column, positions: Sequence[int]) -> Column:
    at = F.array(*[F.lit(int(p)) for p in positions])
    return F.array_join(F.filter(F.split(seq, ""), lambda c, i: ~F.array_contains(at, i)), "")


def extract_columns(seq: Column, positions: Sequence[int]) -> Column:
    return F.concat(*[seq.substr(int(p) + 1, 1) for p in positions])


def binary_indicators(df: DataFrame, individual: str, seq: str, least: int = 1) -> DataFrame:
    """(pos, letter, individual, 1) of every letter but each column's rarest (ties to the greater letter), with ``least`` carriers or more."""
    rows = letters(df, [individual], seq)
    n = rows.groupBy("pos", "letter").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("pos").orderBy("n", F.col("letter").desc())
    keep = n.withColumn("_r", F.row_number().over(rank)).where(f"_r > 1 AND n >= {int(least)}").select("pos", "letter")
    return rows.join(keep, ["pos", "letter"], "left_semi").select("pos", "letter", individual, F.lit(1).alias("value"))


def concatenate(parts: Sequence[DataFrame], key: str, seq: str, fill: str = "-") -> DataFrame:
    """Alignments side by side by key; where a key is missing, ``fill`` over that part's width."""
    stacked = None
    widths = []
    for i, part in enumerate(parts):
        one = part.select(key, F.col(seq).alias("_s")).withColumn("_i", F.lit(i))
        widths.append(part.agg(F.max(F.length(seq)).alias(f"_w{i}")))
        stacked = one if stacked is None else stacked.unionByName(one)
    rows = stacked.groupBy(key).agg(*[F.max(F.when(F.col("_i") == i, F.col("_s"))).alias(f"_p{i}") for i in range(len(parts))])
    for w in widths:
        rows = rows.crossJoin(F.broadcast(w))  # one row each
    return rows.select(key, F.concat(*[F.rpad(F.coalesce(f"_p{i}", F.lit("")), F.coalesce(f"_w{i}", F.lit(0)), fill) for i in range(len(parts))]).alias(seq))


def _dp(a: str, b: str, mode: str, match: dict | None, gap_open: float, gap_extend: float, same: float, differ: float) -> tuple[float, str, str]:
    """Affine-gap alignment (Gotoh). mode: global, local, fitting (b whole inside a) or overlap (end of a with start of b)."""
    n, m = len(a), len(b)
    low = -1e18
    score = lambda x, y: match[x, y] if match else (same if x == y else differ)
    d = np.full((n + 1, m + 1), low)
    up, left = d.copy(), d.copy()
    d[0, 0] = 0
    free_a = mode in ("local", "fitting", "overlap")
    free_b = mode == "local"
    for i in range(1, n + 1):
        up[i, 0] = -gap_open - gap_extend * (i - 1)
        if free_a:
            d[i, 0] = 0
    for j in range(1, m + 1):
        left[0, j] = -gap_open - gap_extend * (j - 1)
        if free_b:
            d[0, j] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            up[i, j] = max(up[i - 1, j] - gap_extend, d[i - 1, j] - gap_open, left[i - 1, j] - gap_open)
            left[i, j] = max(left[i, j - 1] - gap_extend, d[i, j - 1] - gap_open, up[i, j - 1] - gap_open)
            d[i, j] = max(d[i - 1, j - 1], up[i - 1, j - 1], left[i - 1, j - 1]) + score(a[i - 1], b[j - 1])
            if mode == "local":
                d[i, j] = max(d[i, j], 0)
    best = np.maximum(np.maximum(d, up), left)
    if mode == "global":
        i, j = n, m
    elif mode == "local":
        i, j = np.unravel_index(int(d.argmax()), d.shape)
    elif mode == "fitting":
        i, j = int(best[:, m].argmax()), m
    else:
        i, j = n, int(best[n].argmax())
    total = float(best[i, j])
    out_a, out_b = [], []
    state = int(np.argmax([d[i, j], up[i, j], left[i, j]]))
    while i > 0 or j > 0:
        if mode == "local" and state == 0 and d[i, j] == 0:
            break
        if free_a and mode != "local" and j == 0:
            break
        if state == 1 or j == 0:
            out_a.append(a[i - 1])
            out_b.append("-")
            options = [d[i - 1, j] - gap_open, up[i - 1, j] - gap_extend, left[i - 1, j] - gap_open]
            i -= 1
        elif state == 2 or i == 0:
            out_a.append("-")
            out_b.append(b[j - 1])
            options = [d[i, j - 1] - gap_open, up[i, j - 1] - gap_open, left[i, j - 1] - gap_extend]
            j -= 1
        else:
            out_a.append(a[i - 1])
            out_b.append(b[j - 1])
            i, j = i - 1, j - 1
            options = [d[i, j], up[i, j], left[i, j]]
        state = int(np.argmax(options))
    return total, "".join(reversed(out_a)), "".join(reversed(out_b))


_ALIGNED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


def align(a: Column, b: Column, mode: str = "global", matrix: dict[tuple[str, str], float] | None = None, gap_open: float = 1.0, gap_extend: float = 1.0, same: float = 1.0, differ: float = -1.0) -> Column:
    """struct(score, a, b) of two sequence columns; null where either is. The first gap letter costs ``gap_open``."""

    @pandas_udf(_ALIGNED)
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        got = [_dp(p, q, mode, matrix, gap_open, gap_extend, same, differ) if isinstance(p, str) and isinstance(q, str) else (None, None, None) for p, q in zip(x, y)]
        return pd.DataFrame(got, columns=["score", "a", "b"])

    return run(a, b)


def _lcs(a: str, b: str) -> str:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return "".join(out)


@pandas_udf(T.StringType())
def lcs_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """A longest common subsequence of two strings."""
    return pd.Series([_lcs(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)])


def index_map(df: DataFrame, key: str, seq: str, gap: str = "-") -> DataFrame:
    """(key, column, residue): the column of every residue of a gapped sequence, both from 0."""
    kept = df.select(key, F.filter(F.transform(F.split(seq, ""), lambda x, i: F.when((x != gap) & (x != ""), i)), lambda i: i.isNotNull()).alias("_at"))
    return kept.select(key, F.posexplode("_at").alias("residue", "column")).select(key, "column", "residue")


def _back_aligned(protein: str, dna: str, gap: str) -> str:
    residues = protein.replace(gap, "")
    frames = {s: dna[s:] if s >= 0 else "N" * -s + dna for s in (0, 1, -1, 2, -2)}
    letters = np.frombuffer(residues.encode("utf-32-le"), "<u4")

    def agree(shift: int) -> int:
        other = np.frombuffer(sequence.amino_letters(frames[shift]).encode("utf-32-le"), "<u4")
        n = min(len(letters), len(other))
        return int((letters[:n] == other[:n]).sum())

    chosen = frames[max(frames, key=agree)]  # the first of equals
    out, at = [], 0
    for x in protein:
        if x == gap:
            out.append(gap * 3)
        else:
            out.append(chosen[at : at + 3].ljust(3, "N"))
            at += 3
    return "".join(out)


def back_aligned(protein: Column, dna: Column, gap: str = "-") -> Column:
    """A gapped protein's codons: three gaps for each gap, the next codon of ``dna`` for each residue; in the reading frame
    (shifts of -2 to 2 letters) whose translation agrees with the residues at most places, the least shift at ties. Residues beyond the letters become ``NNN``; null for a null."""

    @arrow_udf(T.StringType())
    def aligned(proteins: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([None if p is None or t is None else _back_aligned(p, t, gap) for p, t in zip(proteins.to_pylist(), texts.to_pylist())], pa.string())

    return aligned(protein, dna)


def reference_sites(df: DataFrame, key: str, seq: str, reference: Column, least: int) -> DataFrame:
    """(pos, key, differs) of the columns where at least ``least`` sequences differ from the reference and as many agree; of columns with the same or the opposite pattern the first stays."""
    rows = df.select(key, F.posexplode(F.split(seq, "")).alias("pos", "_l"), F.split(reference, "").alias("_r")).where("_l <> ''")
    rows = rows.where(F.col("pos") < F.size("_r")).select(key, "pos", (F.col("_l") != F.get("_r", F.col("pos"))).alias("differs"))
    sites = rows.groupBy("pos").agg(F.count_if("differs").alias("_n"), F.count("*").alias("_all"), F.sum(F.xxhash64(F.col(key), "differs").cast("decimal(38,0)")).alias("_h"), F.sum(F.xxhash64(F.col(key), ~F.col("differs")).cast("decimal(38,0)")).alias("_g"))
    sites = sites.where((F.col("_n") >= least) & (F.col("_all") - F.col("_n") >= least))
    firsts = sites.groupBy(F.least("_h", "_g").alias("_k")).agg(F.min("pos").alias("pos"))
    return rows.join(firsts.select("pos"), "pos", "left_semi").select("pos", key, "differs")


def variant_calls(counts: DataFrame, by: Sequence[str], letter: str, n: str, least_share: float, least_depth: int) -> DataFrame:
    """Letter counts of each place to calls: share of the depth, ``major`` (the most frequent, ties to the lesser letter) and ``minority`` (another letter of ``least_share`` or more); places under ``least_depth`` are left out."""
    depth = counts.groupBy(*by).agg(F.sum(n).alias("depth"), F.min(F.struct((-F.col(n)).alias("m"), F.col(letter).alias("l"))).alias("_top")).where(F.col("depth") >= least_depth)
    got = counts.join(depth, list(by)).withColumn("share", F.col(n) / F.col("depth")).withColumn("major", F.col(letter) == F.col("_top.l"))
    return got.select(*by, letter, n, "depth", "share", "major", (~F.col("major") & (F.col("share") >= least_share)).alias("minority"))


def hypermutation(reference: Column, seq: Column, a_only: bool = False) -> Column:
    """struct(mutated, possible, control_mutated, control_possible) of aligned sequences of one length: places of G in the reference before A or G (or, ``a_only``, A alone) and then anything but C, and, as controls, before the
    other pairs of bases; possible where the sequence repeats the reference's three letters or has A for the G before the same two. Null for null or for unequal lengths."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("mutated", "possible", "control_mutated", "control_possible")])

    @arrow_udf(kind)
    def counted(refs: pa.Array, seqs: pa.Array) -> pa.Array:
        out = []
        for r, s in zip(refs.to_pylist(), seqs.to_pylist()):
            if r is None or s is None or len(r) != len(s):
                out.append(None)
                continue
            x, y = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (r, s))
            g, one, two = (x[k : len(x) - 2 + k] for k in range(3)) if len(x) > 2 else (x[:0],) * 3
            is_ = lambda v, letters: np.isin(v, [ord(c) for c in letters])
            context = (g == ord("G")) & is_(one, "A" if a_only else "AG") & (two != ord("C"))
            control = (g == ord("G")) & ((is_(one, "CT") & is_(two, "ACGT")) | (is_(one, "AG") & (two == ord("C"))))
            n = len(g)
            follow = (y[1 : n + 1] == one) & (y[2 : n + 2] == two)
            hit, same = follow & (y[:n] == ord("A")), follow & (y[:n] == g)
            out.append({"mutated": int((context & hit).sum()), "possible": int((context & (hit | same)).sum()), "control_mutated": int((control & hit).sum()), "control_possible": int((control & (hit | same)).sum())})
        return pa.array(out, pa.struct([(f.name, pa.int64()) for f in kind]))

    return counted(reference, seq)


def hypermutation_ratios(counts: Column) -> list[Column]:
    """odds_ratio, rate_ratio and phi of such counts; null where one is not defined."""
    a, b = counts["mutated"].cast("double"), counts["control_mutated"].cast("double")
    c, d = counts["possible"] - a, counts["control_possible"] - b
    phi = F.try_divide(a * d - b * c, F.sqrt((a + b) * (c + d) * (a + c) * (b + d)))
    return [F.try_divide(F.try_divide(a, c), F.try_divide(b, d)).alias("odds_ratio"), F.try_divide(F.try_divide(a, a + c), F.try_divide(b, b + d)).alias("rate_ratio"), phi.alias("phi")]
