"""Quality classifier: a support vector machine over n-gram indicators scaled by naive Bayes log-count ratios.

Indicators: words and word pairs, the words' shapes and shape pairs (runs of capitals, small letters and digits, and the
marks themselves), whether a word repeats the last one or the one before, and binned sizes, all hashed. An indicator's value is the log ratio
of its smoothed shares among the documents of either label, over the root of the document's indicators. The linear
hinge loss is minimised by dual coordinate descent on a bounded sample of labelled rows; scoring is numpy over Arrow batches.

Defined results: a null text counts as empty and gets the score of its few indicators; very long texts are scored whole;
repeated rows get the same score, and a doc_id in several rows of docs is learned from once (see ``labelled``); ties of the
sample's hash are all taken or left; doc_id keeps its type; an empty table gives no rows; with one label only, or none, every score is that label's share, or 0.5. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetia.llm import labelled, tokens
from kinetia.llm.common import stored, table, typed

SCORED = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Params:
    sample_rows: int = 12_000  #: labelled rows that the model is fitted on, at most
    sample_codes: int = 20_000_000  #: indicators of these rows, at most: of longer rows fewer are taken
    bits: int = 18
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 12
    steepness: float = 3.0  #: of the logistic curve from margins to scores


def indicators(data: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, indicator) pairs of a chunk of texts, each once, ordered."""
    w = tokens.words(data, bounds)
    n = len(bounds) - 1
    parts = [(np.arange(n), np.zeros(n, np.uint64), 1)]
    if len(w):
        last = np.append(w.doc[1:] != w.doc[:-1], True)
        shape = tokens.shapes(w)
        parts += [(w.doc, w.hash, 2), (w.doc[~last], tokens.grams(w.hash, 2)[~last], 3), (w.doc, shape, 4), (w.doc[~last], tokens.grams(shape, 2)[~last], 5)]
        for k in (1, 2):
            same = np.nonzero((w.hash[k:] == w.hash[:-k]) & (w.doc[k:] == w.doc[:-k]))[0]
            parts.append((w.doc[same], np.full(len(same), k, np.uint64), 6))
        counts = np.diff(w.first)
        size = np.bincount(w.doc, (w.ends - w.starts), n) / np.maximum(counts, 1)
        again = np.bincount(w.doc[1:], (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]), n) / np.maximum(counts, 1)
        key = np.unique(w.doc.astype(np.uint64) << np.uint64(40) | w.hash >> np.uint64(24))
        kinds = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(counts, 1)
        for j, x in enumerate((np.log2(counts + 1), size, again * 10, kinds * 10)):
            parts.append((np.arange(n), np.floor(x).astype(np.uint64), 7 + j))
    doc = np.concatenate([p[0] for p in parts]).astype(np.uint64)
    code = np.concatenate([tokens.mix(p[1] + np.uint64(p[2] * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for p in parts]) >> np.uint64(64 - bits)
    both = np.unique(doc << np.uint64(bits) | code)
    return (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int32)


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, bounds in tokens.chunks(batches):
            doc, code = indicators(data, bounds, bits)
            at = np.searchsorted(doc, np.arange(len(b) + 1))
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("place"), pa.array(np.diff(at)), pa.array([code[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())], names=["label", "place", "n", "codes"])

    return run


@dataclass
class Model:
    weights: np.ndarray  #: by indicator, log ratio included
    bias: float
    flat: float | None = None  #: the score of all, where there is nothing to learn


def learn(docs: DataFrame, labels: DataFrame, params: Params = Params(), label: str = "quality") -> Model:
    sample = labelled.sample(docs, labels, label, params.sample_rows).select("label", F.xxhash64("doc_id").alias("place"), "text")
    held = stored(sample.mapInArrow(_features(params.bits), "label int, place long, n long, codes binary"), "classifier-sample")
    # a window over a few numbers of at most sample_rows rows
    upto = held.select("place", "n", F.sum("n").over(Window.orderBy("place", "label", "n")).alias("total"))
    last = upto.where((F.col("total") <= params.sample_codes) | (F.col("total") == F.col("n"))).agg(F.max("place")).first()[0]
    rows = held.where(F.col("place") <= last).select("label", "codes").collect() if last is not None else []
    rows = sorted((r["label"], bytes(r["codes"])) for r in rows)
    y = np.array([r[0] for r in rows])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << params.bits, np.float32), 0.0, float(y[0]) if len(y) else 0.5)
    codes = [np.frombuffer(r[1], np.int32) for r in rows]
    size = 1 << params.bits
    shares = []
    for k in (1, 0):
        n = np.bincount(np.concatenate([c for c, v in zip(codes, y) if v == k]), minlength=size) + params.smoothing
        shares.append(n / n.sum())
    ratio = np.log(shares[0] / shares[1]).astype(np.float32)
    values = [ratio[c] / np.float32(np.sqrt(len(c))) for c in codes]
    sign, square = np.where(y == 1, 1.0, -1.0), np.array([float(v @ v) + 1 for v in values])
    # rarer labels cost more, by the root of their share
    cost = params.cost * np.where(y == 1, np.sqrt(0.5 / max(1e-9, y.mean())), np.sqrt(0.5 / max(1e-9, 1 - y.mean())))
    w, bias = descend(codes, values, sign, square, cost, size, params.epochs)
    return Model(w * ratio, bias)


def descend(codes: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, square: np.ndarray, cost: np.ndarray, size: int, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the least squared norm (bias included) plus cost-weighed hinge losses, by dual coordinate descent: a row's
    multiplier moves to its optimum between 0 and its cost, rows in an order drawn anew for each epoch. square: rows' squared norms, 1 for the bias included."""
    w, bias, alpha = np.zeros(size, np.float32), 0.0, np.zeros(len(sign))
    order = np.random.default_rng(22)
    for _ in range(epochs):
        for i in order.permutation(len(sign)):
            c, v = codes[i], values[i]
            g = sign[i] * (float(w[c] @ v) + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[c] += np.float32(step) * v
                bias += step
                alpha[i] = new
    return w, bias


def _score(model: Model, params: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, bounds in tokens.chunks(batches):
            doc, code = indicators(data, bounds, params.bits)
            margin = np.bincount(doc, model.weights[code], len(b)) / np.sqrt(np.bincount(doc, minlength=len(b))) + model.bias
            score = 1 / (1 + np.exp(-np.clip(params.steepness * margin, -500, 500)))
            if model.flat is not None:
                score = np.full(len(b), model.flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, params: Params = Params(), label: str = "quality") -> DataFrame:
    """SCORED. Labels are learned from rows that aren't held out only."""
    model = learn(docs, labels, params, label)
    held = docs.select("doc_id", F.coalesce(labelled.held_out(), F.lit(False)).alias("held_out"), "text")
    return held.mapInArrow(_score(model, params), typed(SCORED, docs, "doc_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
