"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Word counts cover all training rows and stand in a stored table. The most frequent words are the model's own; they are cut by
frequency into classes, and all others share one class more. A token's probability is its class's, given the words before it,
times its own within the class. Both are softmaxes over biases, the smoothed unigram shares, and hashed features: the last
word, the last two, and two skips (the word before the last, and the one before that). Without weights the model is the
unigram base. Training is by distributed gradient updates: each round takes another part of the training rows (the first one,
where all expectations are the unigram base's, counts only), tasks sum the features' gradients with numpy over batches, Spark adds them up by blocks of the table, and each cell moves by its gradient over its
scale. All training rows are used once. A task sends the sums of all the table rows that it meets, so training tasks are no more than have a token for each
``cells_a_token`` cells: what is sent grows with the corpus, not with its number of partitions. Tables and own words grow with the counted vocabulary, as far as ``sized`` says. Words of the rest class are told apart by their smoothed counts.

Scoring is one pass; counts of the ``exact`` most frequent words are known there (a table bounded by that parameter), rarer
words of each row are joined with the stored counts, so no frequent key is joined.

Words are told apart by 64-bit hashes. Defined results: a null text counts as empty: one token, the end; rows with a null id
are training rows; repeated rows count each and score the same; without training rows all base scores and scores are 0.0;
very long texts are scored whole; doc_id keeps its type; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetia.llm import tokens
from kinetia.llm.common import crc_mod, stored, table, typed

END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)  # of the end of a text, and of what is before it
FEATURES = 4
HELD = 1_000_000  #: distinct words that a counting task holds
PASSED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rare array<struct<word: long, n: int>>"


@dataclass(frozen=True)
class Params:
    classes: int = 32
    in_class: int = 32  #: words
    exact: int = 131_072  #: words whose counts are known to each scoring task
    class_bits: int = 14
    word_bits: int = 15
    vocabulary: int = 1 << 18  #: distinct words that these sizes are for; see sized()
    most_bits: int = 2  #: that tables of larger vocabularies have more; each task holds the tables
    rounds: int = 3  #: of training, each over its own part of the rows
    damping: float = 8.0
    step: float = 1.0
    batch: int = 16_384  #: tokens, while training; a quarter of it while scoring
    cells_a_token: int = 2  #: table cells that a training task sends for each of its tokens, about
    smoothing: float = 0.1


def sized(params: Params, distinct: int) -> Params:
    """params for a training corpus of so many distinct words: tables have twice the rows for each doubling of the vocabulary, and
    four times the own words (twice the classes, of twice the words) from the first and again from the third, up to most_bits doublings."""
    bits = min(params.most_bits, max(0, math.ceil(math.log2(max(1, distinct) / params.vocabulary))))
    return replace(params, classes=params.classes << (bits + 1) // 2, in_class=params.in_class << (bits + 1) // 2, class_bits=params.class_bits + bits, word_bits=params.word_bits + bits)


def sequence(w: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a chunk's tokens, each text's end included, their texts, and where each text begins."""
    n = len(w.first) - 1
    begin = w.first + np.arange(n + 1)
    h = np.full(int(begin[-1]), END)
    h[np.arange(len(w)) + w.doc] = w.hash
    return h, np.repeat(np.arange(n), np.diff(begin)), begin


def features(h: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """FEATURES hashes of each token's context."""
    place = np.arange(len(h)) - begin[doc]
    last = []
    for k in (1, 2, 3):
        x = np.full(len(h), START)
        x[k:] = np.where(place[k:] >= k, h[:-k], START)
        last.append(x)
    one, two, three = last
    k = [np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xDA942042E4DD58B5)]
    return np.stack([tokens.mix(one * k[0]), tokens.mix(one * k[1] + two), tokens.mix(two * k[2]), tokens.mix(three * k[3])])


@dataclass
class Model:
    params: Params
    words: np.ndarray  #: hashes of the most frequent words, in order
    counts: np.ndarray  #: theirs
    total: int  #: training tokens
    distinct: int
    by_class: np.ndarray  #: weights: hashed feature x class, the rest class last
    in_class: np.ndarray  #: weights: hashed (feature, class) x word of the class

    def __post_init__(self):
        p = self.params
        self.own = min(len(self.words), p.classes * p.in_class)
        self.mass = self.total + p.smoothing * (self.distinct + 1)
        share = np.zeros(p.classes * p.in_class)
        share[: self.own] = self.counts[: self.own] + p.smoothing
        self.rest = max(p.smoothing, self.mass - share.sum())
        share = share.reshape(p.classes, p.in_class)
        with np.errstate(divide="ignore"):
            classes = np.append(share.sum(1), self.rest)
            self.class_share = (classes / classes.sum()).astype(np.float32)
            self.word_share = (share / np.maximum(share.sum(1, keepdims=True), 1e-30)).astype(np.float32)
            self.class_bias = np.log(np.maximum(self.class_share, 1e-30))
            self.word_bias = np.log(np.maximum(self.word_share, 1e-30))

    def __getstate__(self) -> dict:
        """Weights are sent in 16 bits."""
        return {**self.__dict__, "by_class": self.by_class.astype(np.float16), "in_class": self.in_class.astype(np.float16)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.by_class, self.in_class = self.by_class.astype(np.float32), self.in_class.astype(np.float32)

    def slots(self) -> tokens.Slots:
        if not hasattr(self, "_slots"):
            self._slots = tokens.Slots(self.words)
        return self._slots

    def rows(self, f: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
        """Table rows of features, or of features within classes."""
        if c is None:
            return (f >> np.uint64(64 - self.params.class_bits)).astype(np.uint32)
        return ((f ^ ((c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - self.params.word_bits)).astype(np.uint32)


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares, and the logarithm of what they were divided by."""
    e = np.exp(np.minimum(z, 60, out=z))  # weights move by steps of one, so far less occurs
    sums = e.sum(1, keepdims=True)
    e /= sums
    return e, np.log(sums)[:, 0]


def _batch(m: Model, f: np.ndarray, number: np.ndarray, learn):
    """Log probabilities, base e, of a batch of tokens; of rest words, that of their class. learn: is given (table, rows, gradients)."""
    p = m.params
    own = number < m.own
    own &= number >= 0
    target = np.where(own, number // p.in_class, p.classes)
    at = m.rows(f)
    z = m.class_bias + m.by_class[at[0]]
    for x in at[1:]:
        z += m.by_class[x]
    every = np.arange(len(number))
    picked = z[every, target]
    share, norm = _softmax(z)
    out = (picked - norm).astype(np.float64)
    if learn:
        np.negative(share, out=share)
        share[every, target] += 1
        for x in at:
            learn(0, x, share)
    i = np.nonzero(own)[0]
    if len(i):
        c, word = target[i], number[i] % p.in_class
        at = m.rows(f[:, i], c)
        z = m.word_bias[c] + m.in_class[at[0]]
        for x in at[1:]:
            z += m.in_class[x]
        picked = z[np.arange(len(i)), word]
        share, norm = _softmax(z)
        out[i] += picked - norm
        if learn:
            np.negative(share, out=share)
            share[np.arange(len(i)), word] += 1
            for x in at:
                learn(1, x, share)
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all tokens of docs' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            new = np.nonzero(np.append(True, h[1:] != h[:-1]))[0]
            return h[new], np.add.reduceat(n, new)

        def out(h, n):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

        for b, data, bounds in tokens.chunks(batches):
            w = tokens.words(data, bounds)
            parts.append(tuple(x if k == 0 else x.astype(np.int64) for k, x in enumerate(np.unique(w.hash, return_counts=True))))
            parts.append((np.array([END]), np.array([len(b)], np.int64)))
            if sum(len(p[0]) for p in parts) > HELD:
                parts = [merged()]
                if len(parts[0][0]) > HELD // 2:
                    yield out(*parts[0])
                    parts = []
        if parts:
            yield out(*merged())

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(m: Model, f: np.ndarray, number: np.ndarray, sums: list[np.ndarray], seen: list[np.ndarray], by_class: np.ndarray) -> None:
    """Counts what is seen; by_class: how often each row of the second table is met with each class."""
    p = m.params
    own = (number >= 0) & (number < m.own)
    target = np.where(own, number // p.in_class, p.classes)
    i = np.nonzero(own)[0]
    c, word = target[i], number[i] % p.in_class
    one = np.ones(len(number), np.float32)
    for x in f:
        at = m.rows(x).astype(np.int64)
        np.add.at(sums[0].reshape(-1), at * (p.classes + 1) + target, one)
        np.add.at(seen[0], at, one)
        at = m.rows(x[i], c).astype(np.int64)
        np.add.at(sums[1].reshape(-1), at * p.in_class + word, one[: len(i)])
        np.add.at(by_class.reshape(-1), at * p.classes + c, one[: len(i)])


def _expected(m: Model, sums: list[np.ndarray], seen: list[np.ndarray], by_class: np.ndarray) -> None:
    """Takes from what was seen the shares of the base: gradients of a model without weights."""
    seen[1] += by_class.sum(1)
    for k in range(0, len(by_class), 4096):
        sums[0][k : k + 4096] -= seen[0][k : k + 4096, None] * m.class_share
        sums[1][k : k + 4096] -= by_class[k : k + 4096] @ m.word_share


def _gradients(m, params: Params, first: bool):
    """Gradients of touched table rows: (block, rows, n, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = m.value
        sums = [np.zeros_like(model.by_class), np.zeros_like(model.in_class)]
        seen = [np.zeros(len(s), np.float32) for s in sums]
        by_class = np.zeros((len(sums[1]), params.classes), np.float32) if first else None

        def learn(k: int, at: np.ndarray, g: np.ndarray) -> None:
            width, at = g.shape[1], at.astype(np.int64)
            np.add.at(sums[k].reshape(-1), (at[:, None] * width + np.arange(width)).ravel(), g.ravel().view(np.float32))  # by single cells of numpy's own float32 (not a pickled one), which it adds many times faster than rows
            np.add.at(seen[k], at, np.float32(1))

        for _, data, bounds in tokens.chunks(batches):
            h, doc, begin = sequence(tokens.words(data, bounds))
            f, number = features(h, doc, begin), model.slots().find(h)
            if first:
                _counted(model, f, number, sums, seen, by_class)
                continue
            for a in range(0, len(h), params.batch):
                _batch(model, f[:, a : a + params.batch], number[a : a + params.batch], learn)
        if first:
            _expected(model, sums, seen, by_class)
        for k in (0, 1):
            for block in range(64):
                lo, hi = len(sums[k]) * block // 64, len(sums[k]) * (block + 1) // 64
                at = lo + np.nonzero(seen[k][lo:hi])[0]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([64 * k + block], pa.int32()), *(pa.array([x.tobytes()]) for x in (at.astype("<i4"), seen[k][at], sums[k][at]))], names=["block", "rows", "n", "sums"])

    return run


def _unpacked(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, in order, how often they were seen, and their sums."""
    at, n, g = (np.concatenate([np.frombuffer(x, kind) for x in f[name]]) for name, kind in (("rows", "<i4"), ("n", np.float32), ("sums", np.float32)))
    order = np.argsort(at, kind="stable")
    new = np.nonzero(np.append(True, np.diff(at[order]) != 0))[0]
    return at[order][new], np.add.reduceat(n[order], new), np.add.reduceat(g.reshape(len(at), -1)[order], new, axis=0)


def _add(f: pd.DataFrame) -> pd.DataFrame:
    """One row of several rows' gradients of a block."""
    return pd.DataFrame({"block": f["block"].iloc[:1], **{name: [x.tobytes()] for name, x in zip(("rows", "n", "sums"), _unpacked(f))}})


def fit(docs: DataFrame, counts: DataFrame, params: Params = Params()) -> Model:
    """docs: training rows; counts: their stored count_words."""
    spark = docs.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(params.exact).toArrow()  # bounded by that parameter
    words, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(np.float64)
    params = sized(params, int(total["v"]))
    tables = [np.zeros((1 << params.class_bits, params.classes + 1), np.float32), np.zeros((1 << params.word_bits, params.in_class), np.float32)]
    model = Model(params, words, n, int(total["n"]), int(total["v"]), *tables)
    schema = "block int, rows binary, n binary, sums binary"
    tasks = max(1, model.total * params.cells_a_token // (params.rounds * sum(t.size for t in tables)))
    for k in range(params.rounds if model.total else 0):
        sent = spark.sparkContext.broadcast(model)
        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(params.rounds)) == k).select("text").coalesce(tasks)
        summed = part.mapInArrow(_gradients(sent, params, k == 0), schema)
        if tasks > 32:  # a block is added up in two steps, by 32 tasks' sums
            summed = summed.withColumn("salt", F.spark_partition_id() % (tasks // 32 + 1)).groupBy("block", "salt").applyInPandas(_add, schema)
        summed = summed.repartition(16, "block").groupBy("block").applyInPandas(_add, schema)
        for r in summed.toLocalIterator():  # 128 blocks of bounded size, one partition's at a time
            t, share = (tables[0], model.class_share) if r["block"] < 64 else (tables[1], np.float32(1 / params.in_class))
            at, seen = np.frombuffer(r["rows"], "<i4"), np.frombuffer(r["n"], np.float32)
            g = np.frombuffer(r["sums"], np.float32).reshape(len(at), -1)
            # by the larger of what was seen and, about, expected: no cell moves by more than a step, one that is seen a few times by less
            t[at] += params.step * np.clip(g / (seen[:, None] * share + np.maximum(g, 0) + params.damping), -1, 1)
        model = Model(params, words, n, model.total, model.distinct, *tables)
        sent.destroy()
    return model


def _passes(m, params: Params):
    """PASSED: each row's sums over frequent words, the model's over all, and its rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = m.value
        log_counts, size = np.log10(model.counts + params.smoothing), max(1, params.batch // 4)
        for b, data, bounds in tokens.chunks(batches):
            h, doc, begin = sequence(tokens.words(data, bounds))
            f, number = features(h, doc, begin), model.slots().find(h)
            logs = np.concatenate([_batch(model, f[:, a : a + size], number[a : a + size], None) for a in range(0, len(h), size)]) / np.log(10)
            found = number >= 0
            base = np.where(found, log_counts[np.maximum(number, 0)] if len(log_counts) else 0.0, 0.0)
            in_rest = (number < 0) | (number >= model.own)
            logs += np.where(in_rest, base - np.log10(model.rest), 0.0)
            n = len(b)
            total = lambda x: np.bincount(doc, x, n)
            i = np.nonzero(~found)[0]
            i = i[np.lexsort((h[i], doc[i]))]
            new = np.nonzero(np.append(True, (h[i][1:] != h[i][:-1]) | (doc[i][1:] != doc[i][:-1])))[0] if len(i) else i
            times = np.diff(np.append(new, len(i))).astype(np.int32)
            offsets = np.searchsorted(doc[i][new], np.arange(n + 1)).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(h[i][new].view(np.int64)), pa.array(times)], names=["word", "n"]))
            lengths = np.diff(begin)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), b.column("held_out"), pa.array(lengths.astype(np.int64)), pa.array(total(found).astype(np.int64)), pa.array(total(base) - lengths * np.log10(model.mass)), pa.array(total(logs)), rare],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare"],
            )

    return run


def score(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    held = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out"), "text")
    train = held.where("not held_out")
    counts = stored(count_words(train), "lm-counts")
    model = fit(train, counts, params)
    sent = spark.sparkContext.broadcast(model)
    numbered = held.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    passed = stored(numbered.mapInArrow(_passes(sent, params), typed(PASSED, docs, "doc_id")), "lm-passed")
    rare = passed.select("row", F.explode("rare").alias("x")).select("row", "x.word", F.col("x.n").alias("times"))
    least = float(model.counts[-1]) if len(model.counts) == params.exact else -1.0
    others = counts.where(F.col("n") <= least)  # no word that is in rare is more frequent
    joined = rare.join(others, "word", "left")
    known = F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0))
    more = joined.groupBy("row").agg(known.alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(params.smoothing))).alias("logs"))
    logs = F.coalesce("logs", F.lit(0.0))
    return passed.drop("rare").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
