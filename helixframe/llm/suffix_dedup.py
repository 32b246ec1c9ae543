"""Removal of byte strings that start anywhere else, by suffix arrays over shards.

1. Equal texts become one row with a count; a text that occurs twice repeats itself whole.
2. Anchors are positions whose 16-byte hash is least in some window of
   WINDOW positions, so two equal strings of ``length`` bytes have an anchor at the same
   offset below WINDOW. An anchor is keyed by the ``length - WINDOW + 1`` bytes from it on, which
   both strings hold. Keys met once cannot belong to a repeat.
3. An anchor's context is every byte that such strings around it can cover.
   Contexts met twice (by a cryptographic digest of 128 bits) repeat whole. The others, one of each kind for each
   key, meet in shards: a suffix array over their 40-byte blocks orders them by what follows the anchor, an order of
   what precedes it stands beside, and strings that begin d bytes before the anchor are equal where the common
   prefixes of neighbours reach far enough in both orders. Bytes decide; no hash does.
4. A key with more kinds of contexts than a shard takes is split by the bytes next to its own: strings that begin
   a to b bytes before the anchor share a longer core, so for each of FAN such ranges the narrowed contexts meet
   under that core, equal ones collapse, and the parts go to shards or are split again. A range of one
   string ends it.
5. Covered bytes are merged and cut out per text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from . import common
from .suffix_array import suffix_array

#: Positions of a window, of which the least one is an anchor, and bytes hashed at each.
WINDOW, GRAM = 200, 16
#: Contexts of one shard (about) and bytes of a symbol of its suffix array; ranges into which a key with more contexts is split.
SHARD, SYMBOL, FAN = 3000, 40, 4
_P, _TOP = np.uint64(0x9E3779B97F4A7C15), np.iinfo(np.uint64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over [i, i + w) for every i with a whole window, by running picks within blocks of w."""
    n = len(x) - w + 1
    pad = -len(x) % w
    fill = _TOP if pick is np.minimum else np.uint64(0)
    blocks = np.concatenate([x, np.full(pad, fill, np.uint64)]).reshape(-1, w)
    after = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    before = pick.accumulate(blocks, axis=1).reshape(-1)
    return pick(after[:n], before[w - 1 : w - 1 + n])


def anchors(texts: list[bytes], window: int, gram: int = GRAM) -> list[np.ndarray]:
    """Per text the positions whose gram hash is least (ties all count) in some window of ``window`` positions. Windows that reach over a text's end only add positions."""
    whole = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if len(whole) < gram:
        return [np.zeros(0, np.int64) for _ in texts]
    h = whole.astype(np.uint64) + np.uint64(1)
    power, k = int(_P), 1
    while k < gram:  # gram is a power of two: hashes of twice the bytes from two neighbours
        h = h[:-k] * np.uint64(power) + h[k:]
        power = power * power % 2**64
        k *= 2
    h = np.minimum(_mix(h), _TOP - np.uint64(1))
    for e in ends[:-1]:
        h[max(0, e - gram + 1) : e] = _TOP
    if len(h) < window:
        found = np.arange(len(h))
    else:
        least = _sliding(h, window, np.minimum)
        edge = np.zeros(window - 1, np.uint64)
        found = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), window, np.maximum) == h)
    found = found[h[found] != _TOP]
    cuts = np.searchsorted(found, ends)
    starts = np.concatenate([[0], ends[:-1]])
    return [found[a:b] - s for a, b, s in zip(np.concatenate([[0], cuts[:-1]]), cuts, starts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _anchored(length: int, window: int):
    kind = T.StructType([T.StructField("pos", T.ArrayType(T.IntegerType())), T.StructField("g", T.ArrayType(T.LongType()))])

    @arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        raw = [t.as_py() for t in texts]
        reach = length - window + 1
        pos, keys = [], []
        for text, at in zip(raw, anchors(raw, window)):
            at = at[at + reach <= len(text)].tolist()
            pos.append(at)
            keys.append([_signed(xxhash.xxh3_64_intdigest(text[a : a + reach])) for a in at])
        return pa.StructArray.from_arrays([pa.array(pos, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))], ["pos", "g"])

    return run


_CONTEXT = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("g", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("size", T.IntegerType())]))


def _contexts(length: int, window: int):
    """Hash and size of the context [pos - window + 1, pos + length) of each position, as far as the text goes."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("g", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("size", pa.int32())]))

    @arrow_udf(_CONTEXT)
    def run(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for t, w in zip(texts, wanted):
            text, row = t.as_py(), []
            for x in w.as_py():
                p = x["pos"]
                a = max(0, p - window + 1)
                part = text[a : p + length]
                h = int.from_bytes(hashlib.blake2b(part + (p - a).to_bytes(4, "little"), digest_size=16).digest(), "little")
                row.append({"pos": p, "g": x["g"], "h1": _signed(h >> 64), "h2": _signed(h & (1 << 64) - 1), "size": len(part)})
            out.append(row)
        return pa.array(out, kind)

    return run


def shared_strings(left: list[bytes], right: list[bytes], group: list[int], length: int, window: int) -> list[tuple[int, int, int]]:
    """(row, from, to): strings of ``length`` bytes that begin from..to (inclusive) bytes before the anchor of a row and occur in another row of its group.

    left: up to window - 1 bytes before each anchor; right: up to ``length`` from it on; group: a number that rises, equal for one key.
    """
    n = len(right)
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    blocks = -(-length // SYMBOL)
    after = np.zeros((n, blocks * SYMBOL), np.uint8)
    for i, x in enumerate(right):
        after[i, : len(x)] = np.frombuffer(x, np.uint8)
    before = np.zeros((n, max(1, window - 1)), np.uint8)
    for i, x in enumerate(left):
        before[i, : len(x)] = np.frombuffer(x[::-1], np.uint8)
    # a symbol is a block's rank; its filled size stands last, so that padding cannot pass for bytes
    filled = np.clip(size_r[:, None] - SYMBOL * np.arange(blocks)[None, :], 0, SYMBOL).astype(np.uint8) + 1
    cells = np.ascontiguousarray(np.concatenate([after.reshape(n, blocks, SYMBOL), filled[:, :, None]], axis=2)).reshape(n * blocks, SYMBOL + 1)
    _, rank = np.unique(cells.view(f"S{SYMBOL + 1}").reshape(-1), return_inverse=True)
    groups = np.array(group)
    text = np.concatenate([groups[:, None] - groups[0] + 1, rank.reshape(n, blocks) + 1 + int(groups[-1] - groups[0] + 1), np.zeros((n, 1), np.int64)], axis=1)
    width = blocks + 2
    order = np.array([p // width for p in suffix_array(text.reshape(-1).tolist()) if p % width == 0])
    # common prefixes of neighbours
    after, before, groups = after[order], np.ascontiguousarray(before[order]), groups[order]
    size_l, size_r = size_l[order], size_r[order]
    same = after[1:, :length] == after[:-1, :length]
    common_ = np.where(same.all(axis=1), length, same.argmin(axis=1))
    common_ = np.minimum(common_, np.minimum(size_r[1:], size_r[:-1]))
    common_[groups[1:] != groups[:-1]] = -1
    # the same for what precedes the anchor, read backwards
    back = np.argsort(before.view(f"S{before.shape[1]}").reshape(-1), kind="stable")
    same = before[back[1:]] == before[back[:-1]]
    ahead = np.where(same.all(axis=1), before.shape[1], same.argmin(axis=1))
    hit = np.zeros((window, n), bool)
    left_run = np.zeros(n, np.int64)
    for d in range(window):
        at = np.flatnonzero((size_l >= d) & (size_r >= length - d))
        if len(at) < 2:
            continue
        run = np.concatenate([[0], np.cumsum(common_ < length - d)])  # equal for rows whose prefixes of length - d agree
        left_run[back] = np.concatenate([[0], np.cumsum(ahead < d)])  # equal for rows that agree in the d bytes before
        _, again, many = np.unique(left_run[at] * n + run[at], return_inverse=True, return_counts=True)
        hit[d, at] = many[again] > 1
    out = []
    for i in np.flatnonzero(hit.any(axis=0)):
        d = np.flatnonzero(hit[:, i])
        for part in np.split(d, np.flatnonzero(np.diff(d) > 1) + 1):
            out.append((int(order[i]), int(part[0]), int(part[-1])))
    return out


def _sharded(length: int, window: int):
    """Rows (g, t1, t2, pos, left, right) in order of g to covered spans (t1, t2, lo, hi)."""

    def covered(rows: list[tuple]) -> list[tuple]:
        number: dict[int, int] = {}
        group = [number.setdefault(r[0], len(number)) for r in rows]
        found = shared_strings([r[4] for r in rows], [r[5] for r in rows], group, length, window)
        return [(rows[i][1], rows[i][2], rows[i][3] - last, rows[i][3] - first + length) for i, first, last in found]

    def batch_of(spans: list[tuple]) -> pa.RecordBatch:
        t1, t2, lo, hi = zip(*spans)
        return pa.RecordBatch.from_arrays([pa.array(t1, pa.int64()), pa.array(t2, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["t1", "t2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(rows) >= SHARD and row[0] != rows[-1][0]:
                    if spans := covered(rows):
                        yield batch_of(spans)
                    rows = []
                rows.append(row)
        if len(rows) > 1 and (spans := covered(rows)):
            yield batch_of(spans)

    return run


def _narrowed(rows: DataFrame, length: int) -> DataFrame:
    """Contexts (g, lo, hi, t1, t2, pos, left, right) of strings that begin lo..hi - 1 bytes before their anchor, narrowed to each of FAN parts of that range and keyed by the bytes that all strings of the part share."""
    parts = rows.withColumn("step", F.expr(f"CAST(ceil((hi - lo) / {FAN}) AS INT)")).withColumn("a", F.expr("explode(sequence(lo, hi - 1, step))")).withColumn("b", F.expr("least(a + step, hi)"))
    parts = parts.where(f"octet_length(left) >= a AND octet_length(right) > {length} - b")
    core = F.expr(f"concat(substring(left, octet_length(left) - a + 1, a), substring(right, 1, {length} - b + 1))")
    near = F.expr("substring(left, greatest(octet_length(left) - b + 1, 0) + 1, b)").alias("left")
    parts = parts.select(F.xxhash64(core, "a", "b").alias("g"), F.col("a").alias("lo"), F.col("b").alias("hi"), "t1", "t2", "pos", near, F.expr(f"substring(right, 1, {length} - a)").alias("right"))
    return parts.where(f"octet_length(left) + octet_length(right) >= {length}")


def _split(hot: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts of hot keys to (spans that repeat whole, contexts by keys that fit shards), both in several tables."""
    spans, few = [], []
    while hot.take(1):
        rows = common.materialize(_narrowed(hot, length), "narrowed")
        same = ["g", "lo", "hi", "left", "right"]
        kinds = common.materialize(rows.groupBy(*same).agg(F.count("*").alias("many"), F.min(F.struct("t1", "t2", "pos")).alias("at")), "narrowed-kinds")
        twice = common.materialize(kinds.where("many > 1").select(*same), "narrowed-twice")
        whole = rows.join(twice, same, "left_semi")
        spans.append(whole.select("t1", "t2", F.expr("pos - octet_length(left)").alias("lo"), F.expr("pos + octet_length(right)").alias("hi")))
        open_ = kinds.groupBy("g").agg(F.count("*").alias("kinds"), F.min("many").alias("least")).where("kinds > 1 AND least = 1").select("g", "kinds")
        given = kinds.join(common.materialize(open_, "narrowed-keys"), "g").select("g", "lo", "hi", "at.*", "left", "right", "kinds")
        few.append(given.where(F.col("kinds") <= SHARD))
        hot = common.materialize(given.where((F.col("kinds") > SHARD) & (F.col("hi") - F.col("lo") > 1)), "hot")
    return spans, few


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans [lo, hi)."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


_SPANS = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))


@arrow_udf(_SPANS)
def _merged(spans: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    return pa.array([[{"lo": a, "hi": b} for a, b in merged([(x["lo"], x["hi"]) for x in s.as_py() or ()])] for s in spans], kind)


@arrow_udf(T.BinaryType())
def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text's bytes without its spans."""
    out = []
    for t, s in zip(texts, spans):
        text, at, kept = t.as_py() or b"", 0, []
        for x in s.as_py() or ():
            kept.append(text[at : x["lo"]])
            at = x["hi"]
        out.append(b"".join(kept) + text[at:])
    return pa.array(out, pa.binary())


def text_id(text: Column) -> tuple[Column, Column]:
    """A text's id, 88 bits of its SHA-256 as (t1, t2): short enough to travel with every anchor."""
    sha = F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256)
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long").alias("t1"), F.conv(F.substring(sha, 17, 7), 16, 10).cast("int").alias("t2")


def repeated_spans(docs: DataFrame, length: int = 400, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(t1, t2, text, copies, spans): every distinct text as bytes with the maximal runs of its bytes to remove."""
    spark = docs.sparkSession
    common.tune(spark)
    window = min(window, length // 2)
    parts = common.partitions(spark)
    raw = docs.select(*text_id(F.col(text_col)), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    texts = raw.groupBy("t1", "t2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    # bucketed by its key: later joins move only what they bring to the texts
    name = f"helixframe_texts_{uuid.uuid4().hex}"
    path = f"{common.shared_dir(spark)}/helixframe/{name}"
    common.written("table", name)
    common.written("folder", path)
    texts.write.bucketBy(parts, "t1", "t2").option("path", path).saveAsTable(name)
    texts = spark.table(name)

    ids = ["t1", "t2"]
    long_ = texts.where(F.octet_length("text") >= length)
    marks = common.materialize(long_.select(*ids, _anchored(length, window)("text").alias("a")).select(*ids, "a.pos", "a.g"), "anchors")
    every = marks.select(*ids, F.explode(F.arrays_zip("pos", "g")).alias("x")).select(*ids, F.col("x.pos").alias("pos"), F.col("x.g").alias("g"))
    again = common.materialize(every.groupBy("g").agg(F.count("*").alias("many")).where("many > 1").select("g"), "repeated-keys")  # as a table, so that Spark can split a hot key's rows in the join
    wanted = every.join(again, "g", "left_semi").groupBy(*ids).agg(F.collect_list(F.struct("pos", "g")).alias("wanted"))
    seen = long_.join(wanted, ids).select(*ids, F.explode(_contexts(length, window)("text", "wanted")).alias("c")).select(*ids, "c.*")
    seen = common.materialize(seen, "contexts")

    kinds = seen.groupBy("g", "h1", "h2", "size").agg(F.count("*").alias("many"), F.min(F.struct("t1", "t2", "pos")).alias("at"))
    kinds = common.materialize(kinds, "kinds")
    whole = seen.join(kinds.where(F.col("many") > 1).where(F.col("size") >= length).select("g", "h1", "h2", "size"), ["g", "h1", "h2", "size"], "left_semi")
    lo = F.greatest(F.lit(0), F.col("pos") - (window - 1))
    spans = whole.select(*ids, lo.alias("lo"), (lo + F.col("size")).alias("hi"))

    # keys with several kinds of contexts of which some are alone
    open_ = kinds.groupBy("g").agg(F.count("*").alias("kinds"), F.min("many").alias("least")).where("kinds > 1 AND least = 1").select("g", "kinds")
    asked = kinds.join(open_, "g").select("at.*", "g", "kinds")
    per_text = asked.groupBy(*ids).agg(F.collect_list(F.struct("pos", "g", "kinds")).alias("asked"))
    given = long_.join(per_text, ids).select(*ids, "text", F.explode("asked").alias("x"))
    from_ = F.greatest(F.lit(0), F.col("x.pos") - (window - 1))
    given = given.select(F.col("x.g").alias("g"), *ids, F.col("x.pos").alias("pos"), F.substring("text", from_ + 1, F.col("x.pos") - from_).alias("left"), F.substring("text", F.col("x.pos") + 1, F.lit(length)).alias("right"), F.col("x.kinds").alias("kinds"))
    given = common.materialize(given, "open-contexts")
    over = given.where(F.col("kinds") > SHARD).withColumns({"lo": F.lit(0), "hi": F.lit(window)})
    more, parts_of = _split(over, length)
    for x in more:
        spans = spans.unionByName(x)
    few = given.where(F.col("kinds") <= SHARD).drop("kinds")
    for x in parts_of:
        few = few.unionByName(x.select(*few.columns))
    few = few.repartition(parts, "g").sortWithinPartitions("g")
    spans = spans.unionByName(few.mapInArrow(_sharded(length, window), "t1 long, t2 int, lo int, hi int"))

    runs = spans.groupBy(*ids).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # a few for each of a text's anchors
    whole_text = F.array(F.struct(F.lit(0).alias("lo"), F.octet_length("text").alias("hi")))
    found = texts.join(runs, ids, "left")
    chosen = F.when((F.col("copies") > 1) & (F.octet_length("text") >= length), whole_text).otherwise(F.coalesce("spans", F.array().cast(_SPANS)))
    return found.select(*ids, "text", "copies", chosen.alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, spans (maximal removed runs), kept (bytes left over).

    A byte goes if some string of ``length`` bytes over it also starts anywhere
    else, in this text or another row's; judged on the input. Null texts count as
    empty, shorter ones keep all. Rows of the same text, repeated rows too, count as
    different places. Ids are only carried along; other columns are ignored. No documents give no rows.
    """
    found = repeated_spans(docs, length, text_col)
    found = found.withColumn("spans", _merged("spans"))
    found = found.select("t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), "spans", cut("text", "spans").alias("kept"))
    return docs.select(F.col(id_col).alias("doc_id"), *text_id(F.col(text_col))).join(found, ["t1", "t2"]).select("doc_id", "n_bytes", "spans", "kept")
