"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch of t coordinates is filled in rounds: in round i every shingle is
hashed to one coordinate with a value that sorts behind those of earlier
rounds; after t rounds coordinate i - t takes the least of all shingles, so 2t rounds
fill every coordinate. Two sketches agree in a share of coordinates that is
sharply concentrated around the Jaccard similarity.

Documents of equal word sequences are one class. Classes meet in the buckets
of their bands. First every class is verified against one popular member of its
buckets; whoever is linked shares a component. Then, in buckets that still hold
several components, members outside the largest one are compared by whole sketches with
all members of other components, in blocks of bounded size, and the pairs that may be links are verified. All
links are confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from . import common
from .components import components

WORDS = 5
#: Coordinates of a sketch, rows of a band, and the chance that a pair at the threshold shares no band.
SIZE, ROWS, MISS = 512, 5, 1e-7
#: Classes in a block of a bucket; standard deviations below the expected agreement at which a pair is left out (2e-7 of links).
BLOCK, SIGMAS = 512, 5.2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def canonical(text: Column) -> Column:
    """The words joined by one space; equal for equal word sequences."""
    lower = F.translate(F.coalesce(text, F.lit("")), common.UPPER, common.LOWER)
    return F.btrim(F.regexp_replace(lower, "[\\x20\\x09-\\x0D]+", " "), F.lit(" "))


def shingle_set(text: str | None) -> set[tuple[bytes, ...]]:
    w = words_of(text)
    if len(w) < WORDS:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(WORDS))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, sorted."""
    w = words_of(text)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    if len(h) < WORDS:
        return _mix(np.array([sum((int(x) * 31 ** (i + 1) for i, x in enumerate(h)), len(h)) % 2**64], np.uint64)) if len(h) else h
    s = h[: len(h) - WORDS + 1].copy()
    for i in range(1, WORDS):
        s = s * _P + h[i : len(h) - WORDS + 1 + i]
    return np.unique(_mix(s))


def sketches(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """A row of ``size`` values for each set of hashes; empty sets give rows that agree with nothing useful."""
    out = np.full((len(sets), size), np.iinfo(np.uint64).max, np.uint64)
    counts = np.array([len(s) for s in sets])
    live = np.flatnonzero(counts)
    which = np.repeat(live, counts[live])
    every = np.concatenate([sets[i] for i in live]) if len(live) else np.zeros(0, np.uint64)
    flat = out.reshape(-1)
    for i in range(2 * size):
        if not len(every):
            break
        v = _mix(every + np.uint64((i + 1) * int(_P) % 2**64))
        at = (v >> np.uint64(32)) * np.uint64(size) >> np.uint64(32) if i < size else np.full(len(v), i - size, np.uint64)
        value = (np.uint64(i) << np.uint64(48)) | (_mix(v) >> np.uint64(16))
        np.minimum.at(flat, which * size + at.astype(np.int64), value)
        full = (out != np.iinfo(np.uint64).max).all(axis=1)
        if full[which].any():
            more = ~full[which]
            every, which = every[more], which[more]
    return _mix(out)


def bands_for(similarity: float) -> int:
    """Bands enough for MISS at a similarity; as many as the sketch has at most."""
    return min(SIZE // ROWS, math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))) if similarity < 1 else 1


def band_keys(sketch: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    part = sketch[:, : rows * bands].reshape(len(sketch), bands, rows)
    keys = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.ones((len(sketch), 1), np.uint64)
    for r in range(rows):
        keys = _mix(keys * _P + part[:, :, r])
    return keys.view(np.int64)


_SKETCHED = T.StructType([T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])


def _sketcher(bands: int):
    @arrow_udf(_SKETCHED)
    def sketched(texts: pa.Array) -> pa.Array:
        """Set size, band keys and the sketch by one byte a coordinate; no bands for an empty set."""
        sets = [shingle_hashes(t.as_py()) for t in texts]
        s = sketches(sets)
        keys = band_keys(s, bands) if len(s) else s
        short = (s & np.uint64(255)).astype(np.uint8)
        kind = pa.struct([("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
        out = pa.array([{"n": len(x), "bands": k if len(x) else [], "sketch": b.tobytes() if len(x) else b""} for x, k, b in zip(sets, keys, short)], kind)
        del sets, s, keys, short
        common.release()
        return out

    return sketched


def _verifier(percent: int):
    """True where 100 * intersection >= percent * union of the full shingle sets; sets of texts met lately are kept."""

    @arrow_udf(T.BooleanType())
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        lately: OrderedDict[str, set] = OrderedDict()

        def of(text: str) -> set:
            if text not in lately:
                lately[text] = shingle_set(text)
                if len(lately) > 4:
                    lately.popitem(last=False)
            return lately[text]

        out = []
        for x, y in zip(a, b):
            x, y = of(x.as_py()), of(y.as_py())
            both = len(x & y)
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        lately.clear()
        common.release()
        return pa.array(out, pa.bool_())

    return linked


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs that are links. The text of v joins last, next to rows sorted by v."""
    left = pairs.join(texts.select(F.col("key").alias("u"), F.col("text").alias("_a")), "u")
    both = left.join(texts.select(F.col("key").alias("v"), F.col("text").alias("_b")), "v")
    return both.withColumn("_ok", _verifier(percent)("_a", "_b")).where("_ok").select("u", "v")


def _cross_pairs(least: float):
    """Within each (band, i, j) group of rows, the pairs of different roots, one from block i and one from block j, whose sketches agree enough.

    A pair is reported by the first band that it shares alone.
    """

    def pairs_of(rows: list[tuple], band: int, i: int, j: int) -> tuple[list, list]:
        left, right = [r for r in rows if r[0] == i], [r for r in rows if r[0] == j]
        if not left or not right:
            return [], []
        a, b = (np.frombuffer(b"".join(r[4] for r in side), np.uint8).reshape(len(side), -1) for side in (left, right))
        roots: dict[bytes, int] = {}
        ra, rb = (np.array([roots.setdefault(r[2], len(roots)) for r in side]) for side in (left, right))
        na, nb = (np.array([r[3] for r in side]) for side in (left, right))
        ba, bb = (np.array([r[5] for r in side], np.int64) for side in (left, right))
        us, vs = [], []
        for k in range(len(left)):
            may = rb != ra[k]
            if i == j:
                may[: k + 1] = False
            may &= np.minimum(nb, na[k]) * 100 >= np.maximum(nb, na[k]) * np.int64(round(100 * least[1]))
            at = np.flatnonzero(may)
            at = at[(b[at] == a[k]).sum(axis=1) >= least[0]] if len(at) else at
            if len(at):
                same = bb[at] == ba[k]
                at = at[ba[k][same.argmax(axis=1)] == band]
            us += [left[k][1]] * len(at)
            vs += [right[x][1] for x in at]
        return us, vs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        us: list = []
        vs: list = []
        for batch in batches:
            for band, i, j, block, key, root, n, sketch, bands in zip(*(c.to_pylist() for c in batch.columns)):
                if (band, i, j) != group:
                    if len(rows) > 1:
                        more = pairs_of(rows, *group)
                        us += more[0]
                        vs += more[1]
                    group, rows = (band, i, j), []
                rows.append((block, key, root, n, sketch, bands))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in zip(us, vs)], pa.binary()), pa.array([max(x) for x in zip(us, vs)], pa.binary())], ["u", "v"])
                us, vs = [], []
        if len(rows) > 1:
            us, vs = pairs_of(rows, *group)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in zip(us, vs)], pa.binary()), pa.array([max(x) for x in zip(us, vs)], pa.binary())], ["u", "v"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, key (of its word sequence), n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their
    5-word shingle sets; fewer words are one shingle, none (or a null text) give an empty set that is
    linked with nothing. component_id is the least id reachable, kept whether it is the row's own. Rows of one id are each
    kept or not by that id; a null id never leads a component with other
    ids. A component of null ids alone is null, and the rows of its least key
    are kept. Rows of an empty set are kept. Other columns are ignored; no documents give no rows.
    """
    spark = docs.sparkSession
    common.tune(spark)
    parts = common.partitions(spark)
    words = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), common.text_key(canonical(F.col(text_col))).alias("key"))
    rows = words.select("doc_id", "key", _sketcher(bands_for(percent / 100))("text").alias("s")).select("doc_id", "key", "s.n", "s.bands", "s.sketch")
    rows = common.materialize(rows, "sketches")
    classes = rows.where("n > 0").select("key", "n", "bands").dropDuplicates(["key"])

    # buckets of two classes or more. What buckets are joined to is a table of its own, so that Spark can split a hot bucket's rows
    members = classes.select(F.explode("bands").alias("band"), "key", "n")
    shared = common.materialize(members.groupBy("band").agg(F.count("*").alias("many")).where("many > 1"), "shared")
    members = common.materialize(members.join(shared, "band"), "buckets")

    # one verified link a class, to the most popular member that it shares most buckets with
    popular = members.groupBy("key").agg(F.sum("many").alias("fame"))
    ranked = members.select("band", "key", "n").join(popular, "key")
    centre = common.materialize(ranked.groupBy("band").agg(F.max(F.struct("fame", "key", "n")).alias("c")), "centres")
    close = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    tried = members.select("band", "key", "n").join(centre, "band").where((F.col("key") != F.col("c.key")) & close(F.col("n"), F.col("c.n")))
    tried = tried.groupBy("key", F.col("c.key").alias("v")).agg(F.count("*").alias("bands"), F.max("c.fame").alias("fame"))
    tried = tried.groupBy("key").agg(F.max(F.struct("bands", "fame", "v")).alias("best")).select(F.col("key").alias("u"), F.col("best.v").alias("v"))
    tried = common.materialize(tried, "tried")

    # the texts of all classes that share a bucket, once; copies collapse before the shuffle
    met = members.select("key").distinct()
    texts = common.materialize(words.select("key", "text").dropDuplicates(["key"]).join(met, "key", "left_semi"), "texts")
    links = common.materialize(_verified(tried, texts, percent), "links")
    found = common.materialize(components(links), "components")

    # buckets that still hold several components: members of different ones, compared in blocks
    root = F.coalesce("root", "key").alias("root")
    rooted = members.join(found.withColumnRenamed("node", "key"), "key", "left").select("band", "key", "n", "many", root)
    # (a bucket's largest component is dealt into blocks that meet the other members only, so it is not repeated for each of its own blocks)
    sizes = rooted.groupBy("band", "root").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("size", "root")).alias("big"), F.sum("size").alias("all")).where("all > big.size")
    few, many = (F.ceil(n / BLOCK).cast("int") for n in (F.col("all") - F.col("big.size"), F.col("big.size")))
    mixed = common.materialize(mixed.select("band", F.col("big.root").alias("major"), few.alias("few"), many.alias("blocks")), "mixed")
    rest = rooted.join(mixed, "band").withColumn("is_major", F.col("root") == F.col("major")).withColumn("h", F.xxhash64("key"))
    rest = rest.withColumn("block", F.expr("CAST(if(is_major, few + pmod(h, blocks), pmod(h, few)) AS INT)"))
    sketch = rows.where("n > 0").select("key", "sketch", "bands").dropDuplicates(["key"]).join(rest.select("key").distinct(), "key", "left_semi")
    rest = rest.join(sketch, "key").withColumn("other", F.expr("explode(sequence(0, if(is_major, few, few + blocks) - 1))"))
    rest = rest.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "root", "n", "sketch", "bands")
    share = percent / 100
    least = SIZE * share - SIGMAS * (SIZE * share * (1 - share)) ** 0.5
    rest = rest.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    pairs = rest.mapInArrow(_cross_pairs((least, share)), "u binary, v binary").distinct()
    done = tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    more = common.materialize(_verified(pairs.join(done, ["u", "v"], "left_anti"), texts, percent), "links")
    # the components of components
    lead = found.select(F.col("node").alias("n"), "root")
    for end in ("u", "v"):
        more = more.join(lead, more[end] == lead["n"], "left").withColumn(end, F.coalesce("root", end)).select("u", "v")
    joined = components(more).select(F.col("node").alias("r"), F.col("root").alias("top"))
    found = found.join(joined, F.col("root") == F.col("r"), "left").select("node", F.coalesce("top", "root").alias("root"))
    lone = joined.join(found, F.col("r") == F.col("node"), "left_anti").select(F.col("r").alias("node"), F.col("top").alias("root"))
    found = common.materialize(found.unionByName(lone), "components")

    out = rows.select("doc_id", "key", F.col("n").alias("n_shingles")).join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    # as a table, so that Spark can split the rows of a large component in the join
    heads = common.materialize(out.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("head")), "heads")
    out = out.join(heads, "root", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("head"))
    lone = (F.col("n_shingles") == 0) | (F.col("head").isNull() & (F.col("key") == F.col("root")))
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, lone).alias("kept"))
