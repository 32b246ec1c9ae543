"""Language-model scoring: a gated recurrent network trained over all training documents on Spark.

Words are counted over all training documents; the most frequent become symbols of the network
(``recurrent_net``), all others belong to tail classes by a rule on their last letters. Within a tail class a
word's probability comes from the corpus counts, so the vocabulary has no bound: the network's part
needs symbols alone, and what rare words add to a score is a sum over their counts, met by a join.

Training is one pass over all training documents in rounds: in each the tasks start from the same
parameters, train on their share of the round's documents by truncated backpropagation, and the mean of what they
reach, weighted by tokens, starts the next. Only counts of symbols and the parameters (their number is fixed) pass the driver.
A task's work and memory depend on its partition; a document is one lane, however long it is.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common
from .recurrent_net import END, Adam, Net, Shape

#: Words whose counts every task looks up in memory, at most; all rarer ones meet their counts in a join.
LOOKUP_WORDS = 100_000
#: Passes of averaging, of a part of the documents each; the rate of descent in each.
RATES = (0.02, 0.015, 0.01, 0.005)
#: Tokens that a task lays out on lanes at a time, and words that it counts before it hands the counts on.
BUFFER_TOKENS, BUFFER_WORDS = 3_000_000, 2_000_000
#: Tokens that a training task sees in a round, about, where partitions are smaller: each task pays for its longest document, whose steps nothing shares.
TASK_TOKENS = 1_000_000
LETTERS = 2


@dataclass
class Corpus:
    """What the training documents gave: tokens and distinct tokens (the end is one), documents, counts by word as a table, the most frequent words with their counts, and rows and tokens of each tail class."""

    tokens: int
    distinct: int
    documents: int
    counts: DataFrame
    frequent: list[tuple[bytes, int]]
    tail_words: list[int]
    tail_tokens: list[int]
    shape: Shape = field(default_factory=lambda: Shape(512, 32, 16, 12))

    @property
    def log_norm(self) -> float:
        return math.log10(self.tokens + self.distinct + 1)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of UTF-8 texts (binary; null: empty) end to end, A-Z lower-cased, and how many each text has: Arrow's ASCII functions know no other letters and no other white space than space and \\t to \\r."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).fill_null(b"").view(pa.string())))
    words, ends = found.flatten(), np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())])
    kept = pc.greater(pc.binary_length(words), 0)  # white space at either end of a text has nothing beside it
    number = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])[ends]
    return words.filter(kept).view(pa.binary()), np.diff(number)


def tail_class(word: bytes, tails: int) -> int:
    return zlib.crc32(word[-LETTERS:]) % tails


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over the column ``text`` (binary): counted in each task first, a bounded number of words at a time."""

    def counted(held: list[pa.Array]) -> pa.RecordBatch:
        words, counts = pa.chunked_array(held, pa.binary()).value_counts().flatten()
        return pa.RecordBatch.from_arrays([words, counts], ["word", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(words_of(batch.column(0))[0])
            size += len(held[-1])
            if size >= BUFFER_WORDS:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)
        del held
        common.release()

    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def gather(training: DataFrame, shape: Shape | None = None) -> Corpus:
    """Count all words of the column ``text`` (binary) of training documents."""
    spark = training.sparkSession
    counts = common.bucketed(count_words(training.select("text")), "words", "word")
    documents = training.count()
    frequent = [(bytes(r["word"]), r["c"]) for r in counts.orderBy(F.desc("c"), "word").limit(LOOKUP_WORDS).collect()]
    made = Corpus(0, 0, documents, counts, frequent, [], [], *([shape] if shape else []))
    s = made.shape
    symbols = spark.createDataFrame([(w,) for w, _ in frequent[: s.words - 1]], "word binary")
    rest = counts.join(F.broadcast(symbols), "word", "left_anti")
    at = F.crc32(F.substring("word", -LETTERS, LETTERS)) % s.tails
    by = {r["t"]: r for r in rest.groupBy(at.cast("int").alias("t")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}
    made.tail_words = [by[t]["n"] if t in by else 0 for t in range(s.tails)]
    made.tail_tokens = [by[t]["c"] if t in by else 0 for t in range(s.tails)]
    head = frequent[: s.words - 1]
    made.tokens = documents + sum(c for _, c in head) + sum(made.tail_tokens)
    made.distinct = int(documents > 0) + len(head) + sum(made.tail_words)
    return made


def symbols(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """Rows (row, held_out and what else there is, without ``text``) with ``ids`` (symbols as 16-bit numbers, the end last), ``n_tokens``, ``n_known`` and
    ``known_log`` (over words of the lookup list and the end: how many, and the sum of log10(count + 1)), ``tail_log`` (its part from words of tail classes, less the classes' norms) and ``rare`` (words off the list with how often each stands)."""
    s = corpus.shape
    listed = [w for w, _ in corpus.frequent]
    symbol = np.array([i + 1 if i < s.words - 1 else s.words + tail_class(w, s.tails) for i, w in enumerate(listed)] + [END], np.uint16)
    logs = np.log10(np.array([c for _, c in corpus.frequent] + [0], float) + 1)  # a place more, for words off the list
    norm = np.concatenate([np.zeros(s.words), [math.log10(n + w + 1) for n, w in zip(corpus.tail_tokens, corpus.tail_words)]])
    sent = docs.sparkSession.sparkContext.broadcast((listed, symbol, logs, norm, corpus.documents))
    others = [f.name for f in docs.schema if f.name != "text"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text") + "ids binary, n_tokens long, n_known long, known_log double, tail_log double, rare array<struct<word: binary, k: long>>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, symbol, logs, norm, documents = sent.value
        listed = pa.array(listed, pa.binary())
        end_log, end_known = math.log10(documents + 1), int(documents > 0)
        for batch in batches:
            words, sizes = words_of(batch.column(batch.schema.get_field_index("text")))
            coded = words.dictionary_encode()
            at, distinct = coded.indices.to_numpy(), coded.dictionary
            # of each distinct word: its place on the list, its symbol, what it adds to known_log and tail_log
            place = pc.index_in(distinct, value_set=listed).fill_null(-1).to_numpy()
            off = place < 0
            number = symbol[place]
            number[off] = [s.words + tail_class(w, s.tails) for w in distinct.filter(pa.array(off)).to_pylist()]
            known, tail = logs[place], np.where(number >= s.words, logs[place], 0) - norm[number]
            n = len(sizes)
            doc, ends = np.repeat(np.arange(n), sizes), np.cumsum(sizes + 1)
            ids = np.full(len(at) + n, END, "<u2")
            ids[np.arange(len(at)) + doc] = number[at]
            sums = lambda v: np.bincount(doc, v[at], n)  # noqa: E731, B023
            pairs, times = np.unique((doc * len(off) + at)[off[at]], return_counts=True)
            rare_doc, rare_word = np.divmod(pairs, max(1, len(off)))
            rare = pa.StructArray.from_arrays([distinct.take(pa.array(rare_word)), pa.array(times, pa.int64())], ["word", "k"])
            offsets = lambda x: pa.array(np.concatenate([[0], x]), pa.int32())
            got = [
                pa.Array.from_buffers(pa.binary(), n, [None, offsets(2 * ends).buffers()[1], pa.py_buffer(ids)]),
                pa.array(sizes + 1, pa.int64()),
                pa.array(sums(~off).astype(np.int64) + end_known),
                pa.array(sums(known) + end_log),
                pa.array(sums(tail)),
                pa.ListArray.from_arrays(offsets(np.searchsorted(rare_doc, np.arange(n), side="right")), rare),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in others], *got], [*others, "ids", "n_tokens", "n_known", "known_log", "tail_log", "rare"])
        common.release()

    return docs.mapInArrow(encode, schema)


def _buffers(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches with their documents' symbols, BUFFER_TOKENS at a time."""
    held, docs, size = [], [], 0
    for batch in batches:
        held.append(batch)
        for ids in batch.column(column):
            docs.append(np.frombuffer(ids.as_py(), "<u2"))
            size += len(docs[-1])
        if size >= BUFFER_TOKENS:
            yield held, docs
            held, docs, size = [], [], 0
    if docs:
        yield held, docs


def train(coded: DataFrame, corpus: Corpus, seed: int = 1) -> np.ndarray:
    """The network's parameters after one pass over ``ids`` of all rows, a round of averaging each part."""
    spark, shape = coded.sparkSession, corpus.shape
    counts = np.zeros(shape.symbols)
    counts[END] = corpus.documents
    counts[1 : 1 + len(corpus.frequent[: shape.words - 1])] = [c for _, c in corpus.frequent[: shape.words - 1]]
    counts[shape.words :] = corpus.tail_tokens
    flat = shape.start(counts, seed)
    tasks = -(-corpus.tokens // (len(RATES) * TASK_TOKENS))  # follows the input
    for k, rate in enumerate(RATES):
        sent = spark.sparkContext.broadcast(flat)

        def descend(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            net, adam, seen = Net(shape, sent.value.copy()), Adam(shape.size, rate), 0
            for _, docs in _buffers(batches):
                seen += net.train(docs, adam)
            if seen:
                moved = (net.flat - sent.value).astype(float) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape.size + 1), pa.int32()), pa.array(np.append(moved, seen), pa.float64())], ["at", "v"])
            common.release()

        part = coded.where(F.pmod(F.xxhash64("row"), F.lit(len(RATES))) == k).select("ids").coalesce(max(1, tasks))
        sums = part.mapInArrow(descend, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # a row a parameter
        if sums:
            total = np.zeros(shape.size + 1)
            total[[r["at"] for r in sums]] = [r["v"] for r in sums]
            flat = flat + (total[:-1] / total[-1]).astype(np.float32)
        sent.unpersist()
    return flat


def score(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text", shape: Shape | None = None) -> DataFrame:
    """Every row's (id, held_out, n_tokens, n_known, train_tokens, base_score, score), the network learning from rows where the SQL condition ``held_out`` does not hold.

    n_known counts tokens that occur in training; base_score is the log10 probability under word counts (one added), score that of the network,
    each token given all before it in its document. A null text counts as empty and is the end token
    alone; rows that repeat an id are scored each; a condition that is null counts as not held out. Without training documents all counts are
    zero and the network keeps its first parameters.
    """
    spark = docs.sparkSession
    common.tune(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    corpus = gather(rows.where(~F.col("held_out")), shape)
    coded = common.materialize(symbols(rows.withColumn("row", F.monotonically_increasing_id()), corpus), "symbols")
    flat = train(coded.where(~F.col("held_out")), corpus)
    sent = spark.sparkContext.broadcast(flat)
    made = corpus.shape

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(made, sent.value)
        for held, found in _buffers(batches, 1):
            got = net.log_probabilities(found) / math.log(10)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0) for b in held]), pa.array(got, pa.float64())], ["row", "p"])
        common.release()

    p = coded.select("row", "ids").mapInArrow(predict, "row long, p double")
    # words off the lookup list: their counts by a join; none of them is frequent, so no key is hot
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k").join(corpus.counts, "word", "left")
    sums = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k"))).alias("r_known"), F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("r_log"))
    met = coded.drop("ids", "rare").join(p, "row").join(sums, "row", "left")
    r_known, r_log = F.coalesce("r_known", F.lit(0)), F.coalesce("r_log", F.lit(0.0))
    return met.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + r_known).cast("long").alias("n_known"), F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") + r_log - F.col("n_tokens") * F.lit(corpus.log_norm)).alias("base_score"), (F.col("p") + F.col("tail_log") + r_log).alias("score"),
    )
