"""Sequence columns: complement, translation, k-mers, distances, variant normal forms.

Built-in expressions, but for what looks at every letter of long sequences (translation, k-mer and pair counts): there Arrow
batches go through numpy, in time in proportion to the letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf

#: The standard genetic code, amino acids of the codons in the order T, C, A, G of each place.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: IUPAC nucleotide codes.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def codons(seq: Column) -> Column:
    """Whole triplets from the first letter on."""
    n = F.floor(F.length(seq) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: seq.substr(i * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def codon_to_amino(codon: Column) -> Column:
    """One letter; X where the triplet holds anything but ACGTU (either case), - for a gap triplet."""
    c = F.translate(F.upper(codon), "U", "T")
    code = F.conv(F.translate(c, "TCAG", "0123"), 4, 10).cast("int")
    return F.when(c.rlike("^[ACGT]{3}$"), F.lit(AMINO_ACIDS).substr(code + 1, F.lit(1))).when(c == "---", F.lit("-")).otherwise(F.lit("X"))


#: Per byte the digit of a base in the order T, C, A, G; 4 for a gap, 5 for anything else.
_DIGIT = np.full(256, 5, np.uint8)
for _letters, _d in (("TtUu", 0), ("Cc", 1), ("Aa", 2), ("Gg", 3), ("-", 4)):
    _DIGIT[np.frombuffer(_letters.encode(), np.uint8)] = _d
_ACIDS = np.frombuffer(AMINO_ACIDS.encode(), np.uint8)


def amino_letters(seq: str) -> str:
    """``codon_to_amino`` of a sequence's whole triplets."""
    digits = _DIGIT[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)[: len(seq) // 3 * 3]].reshape(-1, 3)
    code = digits[:, 0].astype(np.intp) * 16 + digits[:, 1] * 4 + digits[:, 2]
    bases = (digits < 4).all(axis=1)
    out = np.where((digits == 4).all(axis=1), ord("-"), ord("X")).astype(np.uint8)
    out[bases] = _ACIDS[code[bases]]
    return out.tobytes().decode("ascii")


@arrow_udf(T.StringType())
def translate(seqs: pa.Array) -> pa.Array:
    """Amino acids of the whole triplets from the first letter on; empty for null."""
    return pa.array([amino_letters(s.as_py() or "") for s in seqs], pa.string())


def _possible(codon: str) -> tuple[str, ...]:
    """Amino acids that a triplet of IUPAC letters may stand for, sorted; X alone for fewer than three letters, nothing for a letter that is none."""
    if len(codon) < 3:
        return ("X",)
    sets = [IUPAC.get("T" if c == "U" else c, "") for c in codon.upper()[:3]]
    return tuple(sorted({AMINO_ACIDS[16 * "TCAG".index(a) + 4 * "TCAG".index(b) + "TCAG".index(c)] for a in sets[0] for b in sets[1] for c in sets[2]}))


@arrow_udf(T.ArrayType(T.StringType()))
def possible_amino_acids(codons: pa.Array) -> pa.Array:
    """The amino acids that each triplet of IUPAC nucleotide letters may stand for, in order; null for null or for letters that are no nucleotide codes."""
    known: dict[str, list[str] | None] = {}
    for c in codons.unique():
        if (text := c.as_py()) is not None:
            known[text] = list(_possible(text)) or None
    return pa.array([known.get(c.as_py()) for c in codons], pa.list_(pa.string()))


def ambiguous_amino_acid(possible: Column) -> Column:
    """The one amino acid of a list of possible ones, X where there are several; null for null."""
    return F.when(F.size(possible) == 1, possible[0]).when(possible.isNotNull(), F.lit("X"))


def codon_matches(codon: Column, possible: Column, amino: Column) -> Column:
    """Whether a codon, with its possible amino acids, agrees with one: it is among them, or is X and the codon holds a letter other than A, C, G and T."""
    return F.array_contains(possible, amino) | ((amino == "X") & codon.rlike("[^ACGT]"))


def kmer_counts(seq: Column, k: int) -> Column:
    """array<struct(kmer, n)>: how often each substring of k letters stands in a sequence; empty below k letters or for null."""

    @arrow_udf(T.ArrayType(T.StructType([T.StructField("kmer", T.StringType()), T.StructField("n", T.LongType())])))
    def counted(seqs: pa.Array) -> pa.Array:
        words, counts, ends = [], [], [0]
        for s in seqs:
            letters = np.frombuffer((s.as_py() or "").encode("utf-32-le"), "<u4")
            if len(letters) >= k:
                alphabet, code = np.unique(letters, return_inverse=True)
                if len(alphabet) ** k < 1 << 62:  # a k-mer as one number
                    number = np.zeros(len(letters) - k + 1, np.int64)
                    for j in range(k):
                        number = number * len(alphabet) + code[j : j + len(number)]
                    size = len(alphabet) ** k
                    if size <= 4 * len(number):
                        n = np.bincount(number, minlength=size)
                        found = np.flatnonzero(n)
                        n = n[found]
                    else:
                        found, n = np.unique(number, return_counts=True)
                    places = found[:, None] // len(alphabet) ** np.arange(k - 1, -1, -1, dtype=np.int64) % len(alphabet)
                    rows = alphabet[places]
                else:
                    rows, n = np.unique(np.lib.stride_tricks.sliding_window_view(letters, k), axis=0, return_counts=True)
                words += np.ascontiguousarray(rows, "<u4").view(f"<U{k}").ravel().tolist()
                counts.append(n)
            ends.append(len(words))
        kinds = [pa.array(words, pa.string()), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(kinds, ["kmer", "n"]))

    return counted(seq)


def kmers(seq: Column, k: int) -> Column:
    """All substrings of k letters; empty below k letters or for null."""
    n = F.length(seq) - (k - 1)

    def runs(letters: Column) -> Column:
        part = lambda j: F.slice(letters, j, F.size(letters) - (k - 1))
        out = part(1)
        for j in range(2, k + 1):
            out = F.zip_with(out, part(j), lambda a, b: F.concat(a, b))
        return out

    # an array of one binds the letters, so that seq is worked out once and not for each place
    return F.when(n > 0, F.transform(F.array(F.split(seq, "")), runs)[0]).otherwise(F.array().cast("array<string>"))


def _sites(a: Column, b: Column, test) -> Column:
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    return F.size(F.filter(pairs, lambda p: test(p["x"], p["y"])))


def hamming(a: Column, b: Column) -> Column:
    """Places that differ over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, _sites(a.substr(F.lit(1), n), b.substr(F.lit(1), n), lambda x, y: x != y)).otherwise(0)


def p_distance(a: Column, b: Column) -> Column:
    """Share of differing places among those where both hold a letter (no gap); 0 without such places."""
    n = F.least(F.length(a), F.length(b))
    x, y = a.substr(F.lit(1), n), b.substr(F.lit(1), n)
    both = _sites(x, y, lambda p, q: (p != "-") & (q != "-"))
    return F.when(both > 0, _sites(x, y, lambda p, q: (p != "-") & (q != "-") & (p != q)) / both).otherwise(0.0)


def jukes_cantor(p: Column) -> Column:
    """-3/4 ln(1 - 4p/3); 0 where that is undefined."""
    inside = 1 - p * 4 / 3
    return F.when(inside > 0, 0.0 - 0.75 * F.log(inside)).otherwise(0.0)


def is_transition(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.greatest(a, b)).isin("AG", "CT")


def is_transversion(a: Column, b: Column) -> Column:
    return (a != b) & ~is_transition(a, b) & a.isin(*"ACGT") & b.isin(*"ACGT")


def is_snp(ref: Column, alt: Column) -> Column:
    return ref.isin(*"ACGT") & alt.isin(*"ACGT") & (ref != alt)


def minimal_representation(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(pos, ref, alt) without a shared end, then without a shared start, each keeping a letter; symbolic alleles stay."""
    room = F.least(F.length(ref), F.length(alt)) - 1
    longest = lambda same: F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(room, F.lit(0))), same)), F.lit(0))
    tail = longest(lambda n: ref.substr(F.length(ref) - n + 1, n) == alt.substr(F.length(alt) - n + 1, n))
    r, a = ref.substr(F.lit(1), F.length(ref) - tail), alt.substr(F.lit(1), F.length(alt) - tail)
    more = F.least(F.length(r), F.length(a)) - 1
    head = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(more, F.lit(0))), lambda n: r.substr(F.lit(1), n) == a.substr(F.lit(1), n))), F.lit(0))
    done = F.struct((pos + head).cast("long").alias("pos"), r.substr(head + 1, F.length(r)).alias("ref"), a.substr(head + 1, F.length(a)).alias("alt"))
    return F.when(ref.rlike("^[A-Za-z]+$") & alt.rlike("^[A-Za-z]+$"), done).otherwise(F.struct(pos.cast("long").alias("pos"), ref.alias("ref"), alt.alias("alt")))


def cigar_length(cigar: Column) -> Column:
    """Reference bases that a CIGAR covers: M, D, N, = and X."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))


def chromosome_number(name: Column) -> Column:
    """chr prefix dropped, X 23, Y 24, XY 25, M or MT 26; null for other names."""
    n = F.regexp_replace(name, "^chr", "")
    return F.when(n == "X", 23).when(n == "Y", 24).when(n == "XY", 25).when(n.isin("M", "MT"), 26).otherwise(n.try_cast("int"))


def orient_to(seq: Column, reference: Column) -> Column:
    """The sequence or its reverse complement, whichever has fewer edits to the reference (ties: as it is)."""
    rc = reverse_complement(seq)
    return F.when(F.levenshtein(rc, reference) < F.levenshtein(seq, reference), rc).otherwise(seq)


def remove_primer(seq: Column, primer: str, most: int) -> Column:
    """The sequence without a start within ``most`` edits of the primer."""
    n = len(primer)
    return F.when(F.levenshtein(F.substring(seq, 1, n), F.lit(primer)) <= most, seq.substr(F.lit(n + 1), F.length(seq))).otherwise(seq)


def splice_gaps(start: Column, cigar: Column) -> Column:
    """array<struct(start, end)> of the N runs of a CIGAR from a half-open start on."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1)
    size = lambda o: F.regexp_extract(o, r"^(\d+)", 1).cast("long")
    moves = lambda o: F.when(F.right(o, F.lit(1)).isin("M", "D", "N", "=", "X"), size(o)).otherwise(F.lit(0).cast("long"))
    empty = F.struct(start.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,op:string>>").alias("rows"))
    step = lambda n, o: F.struct((n["at"] + moves(o)).alias("at"), F.when(F.right(o, F.lit(1)) == "N", F.concat(n["rows"], F.array(F.struct(n["at"].alias("start"), (n["at"] + moves(o)).alias("end"), F.lit("N").alias("op"))))).otherwise(n["rows"]).alias("rows"))
    rows = F.aggregate(ops, empty, step)["rows"]
    return F.transform(F.filter(rows, lambda r: r["op"] == "N"), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))


def expand(code: Column) -> Column:
    """Bases that one IUPAC letter stands for, as an array; null for other letters."""
    table = F.create_map(*[F.lit(x) for k, v in IUPAC.items() for x in (k, v)])
    return F.split(F.try_element_at(table, F.upper(code)), "")
