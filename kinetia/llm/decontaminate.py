"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are the stated query set, taken in blocks; a block is searched in one pass over the documents. Its words are
the vocabulary; inverse document frequencies are counted over all documents. Items are cut into passages about as long as
those of documents, the best of which decides. A block's passages are dealt to groups of no more than ``rank``, and a
randomised SVD of a group's TF-IDF passages (range finder with power steps), one Spark task's work, gives its latent space.
So a space has a dimension for each of its passages and keeps them whole, however many there are; thresholds are scaled by
what it keeps. Documents are cut into overlapping passages of whole texts, folded into each space and searched
by cosine; words outside a group's vocabulary count in a passage's norm, so a passage whose known words are too light can't
reach the threshold and is passed over without loss. These spaces keep the items' cosines as they are.

A second space is truly latent: the first ``topics`` right singular vectors of the TF-IDF passages of the documents themselves, over hashed words
and by a distributed randomised SVD (tasks sum A'(AQ) over their passages, sums are added by Spark, the driver orthogonalises one matrix of fixed size). There,
words that the documents use in like places are near each other, so a passage that exchanges an item's telling words for such ones is
near it, where the first spaces see it far. It is counted and fitted on every passage of every row, and every one is searched in it. Each hit of either is verified on the words around it: the longest common
subsequence with the whole item and, for looser hits, with the item's last words, its answer.

Defined results: null and wordless texts, on either side, match nothing; items of fewer than ``short`` words must occur as
they are; very long texts and items are cut into passages and verified whole; repeated rows and items are matched each, ties
included; an item with a null id keeps it; ids keep their types; empty tables give no rows, and no item leaves all rows;
extra columns are ignored by ``matches`` and kept by ``clean``; rows with a null doc_id are judged like others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinetia.llm import tokens
from kinetia.llm.common import forget, free, sized, stored, table, typed

MATCH = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


@dataclass(frozen=True)
class Params:
    block: int = 4096  #: items, and passages of them, searched in one pass over the documents
    rank: int = 192  #: latent dimensions, and so the passages of items that share a space
    stride: int = 20  #: words; passages are two strides long
    cosine: float = 0.45  #: of a passage that holds nothing else; less for items shorter than a passage
    sure: float = 0.75  #: share of an item's words, in order, that settles a match
    likely: float = 0.6  #: share that does so with the answer
    answer: float = 0.8  #: share of the answer's words
    topics: int = 48  #: dimensions of the documents' latent space; 0: none
    bits: int = 14  #: of its hashed words
    alike: float = 0.85  #: cosine in it, of what it keeps of passage and item
    short: int = 8  #: words; items of fewer must occur as they are, since a paraphrase of so few words says nothing


@dataclass
class Group:
    """At most params.rank passages of items, with a latent space that keeps each of them whole."""

    items: np.ndarray  #: of each passage, the block's number of its item
    begin: np.ndarray  #: its first word in that
    words: np.ndarray  #: sorted numbers in the block's vocabulary
    least: np.ndarray  #: each passage's threshold
    basis: np.ndarray | None = None  #: words x rank, rows times idf
    latent: np.ndarray | None = None  #: passages x rank, unit length


@dataclass
class Block:
    ids: list
    words: list[np.ndarray]  #: of each item, hashes
    vocabulary: np.ndarray  #: sorted hashes
    idf: np.ndarray | None = None
    other: float = 0.0  #: idf of words outside the vocabulary
    groups: list[Group] = field(default_factory=list)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each hash, -1 for others."""
        if not len(self.vocabulary):
            return np.full(len(h), -1, np.int64)
        if not hasattr(self, "_slots"):
            self._slots = tokens.Slots(self.vocabulary)
        return self._slots.find(h)


def cuts(n: int, words: int) -> list[tuple[int, int]]:
    """First and last place, the latter excluded, of the passages of an item of n words: even parts, about as long as a document's passage."""
    parts = max(1, (2 * n + words) // (2 * words))
    return [(n * k // parts, n * (k + 1) // parts) for k in range(parts)]


def item_blocks(items: DataFrame, params: Params) -> Iterator[Block]:
    """Blocks of at most params.block items with words, and with one item more than so many passages at most."""
    held = items.select("item_id", "text").where("text is not null")
    n = held.count()
    parts = max(1, math.ceil(n / params.block))
    if parts > 1:
        numbered = held.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
        within = Window.partitionBy("part").orderBy("item_id", "text")
        held = stored(numbered.withColumn("part", F.col("part") + parts * F.floor((F.row_number().over(within) - 1) / params.block)), "benchmark")
        keys = sorted(r["part"] for r in held.select("part").distinct().collect())
    for part in keys if parts > 1 else [None]:
        rows = (held if part is None else held.where(F.col("part") == part)).collect()
        found = [(r["item_id"], tokens.hashes(r["text"], tokens.MARKS)) for r in sorted(rows, key=lambda r: (r["item_id"] is None, str(r["item_id"]), r["text"]))]
        found = [x for x in found if len(x[1])]
        passages = np.cumsum([len(cuts(len(w), 2 * params.stride)) for _, w in found])
        for k in np.unique((passages - 1) // params.block):
            ids, words = zip(*(x for x, n in zip(found, passages) if (n - 1) // params.block == k))
            yield Block(list(ids), list(words), np.unique(np.concatenate(words)))


def count_documents(docs: DataFrame, block: Block) -> tuple[int, np.ndarray]:
    """Documents, and how many hold each word of the vocabulary."""
    size = len(block.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for b, data, bounds in tokens.chunks(batches, most=600_000):
            w = tokens.words(data, bounds, space=tokens.MARKS)
            v = block.numbers(w.hash)
            known = np.nonzero(v >= 0)[0]
            cell = np.sort(w.doc[known] * size + v[known])
            total[:size] += np.bincount(cell[np.diff(cell, prepend=-1) > 0] % size, minlength=size)
            total[size] += len(b)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a word
    out = np.zeros(size + 1, np.int64)
    for r in rows:
        out[r["word"]] = r["n"]
    return int(out[size]), out[:size]


def _latent(frames: Iterator[pd.DataFrame], params: Params) -> Iterator[pd.DataFrame]:
    """Of each group: basis and latent passages, from a randomised SVD of its TF-IDF matrix A. Its passages are no more than its rank, so all of them stay whole."""
    for f in frames:
        for group, words, first, idf in zip(f["group"], f["words"], f["first"], f["idf"]):
            v, first, idf = np.frombuffer(words, "<i4"), np.frombuffer(first, "<i4"), np.frombuffer(idf, np.float64)
            a = np.zeros((len(first) - 1, len(idf)))
            np.add.at(a, (np.repeat(np.arange(len(a)), np.diff(first)), v), idf[v])
            a /= np.linalg.norm(a, axis=1, keepdims=True)
            rank = min(params.rank, *a.shape)
            q = np.random.default_rng(21).standard_normal((len(idf), min(rank + 10, len(idf))))
            for _ in range(2):
                q, _ = np.linalg.qr(a.T @ (a @ q))
            values, vectors = np.linalg.eigh((a @ q).T @ (a @ q))
            basis = q @ vectors[:, np.argsort(values)[::-1][:rank]]
            yield pd.DataFrame({"group": [group], "basis": [(basis * idf[:, None]).astype(np.float32).tobytes()], "latent": [(a @ basis).astype(np.float32).tobytes()]})


def fit(docs: DataFrame, block: Block, params: Params) -> Block:
    """block with document frequencies and its latent spaces, each a task's."""
    n, df = count_documents(docs, block)
    block.idf = np.log((n + 1) / (df + 0.5)).clip(0.05)
    block.other = float(np.median(block.idf))
    passages = [(k, a, b) for k, w in enumerate(block.words) for a, b in cuts(len(w), 2 * params.stride)]
    parts = math.ceil(len(passages) / params.rank)
    rows = []
    for part in range(parts):
        own = passages[part::parts]
        numbers = [block.numbers(block.words[k][a:b]) for k, a, b in own]
        words, v = np.unique(np.concatenate(numbers), return_inverse=True)
        first = np.cumsum([0, *map(len, numbers)])
        least = [params.cosine * min(1.0, math.sqrt((b - a) / (2 * params.stride))) for _, a, b in own]
        block.groups.append(Group(*(np.array([x[j] for x in own]) for j in (0, 1)), words, np.array(least, np.float32)))
        rows.append((part, v.astype("<i4").tobytes(), first.astype("<i4").tobytes(), block.idf[words].tobytes()))
    df = docs.sparkSession.createDataFrame(rows, "group int, words binary, first binary, idf binary").repartition(min(8, parts), "group")
    for r in df.mapInPandas(lambda frames: _latent(frames, params), "group int, basis binary, latent binary").toLocalIterator():
        g = block.groups[r["group"]]
        g.basis, latent = np.frombuffer(r["basis"], np.float32).reshape(len(g.words), -1), np.frombuffer(r["latent"], np.float32).reshape(len(g.items), -1)
        kept = np.linalg.norm(latent, axis=1)  # 1 but for rounding
        g.latent, g.least = latent / np.maximum(kept, 1e-9)[:, None], g.least * np.minimum(kept, 1)
    return block


def sums(rows: np.ndarray, at: np.ndarray, first: np.ndarray, most: int = 32, wide: int = 2048) -> np.ndarray:
    """The sum of rows[at] over each stretch of at, none of them empty, which begin at the places first: of so many stretches at a time the j-th entries
    together, which stay in the processor's cache. Longer stretches than most are summed in parts, and the parts' sums likewise."""
    sizes = np.diff(np.append(first, len(at)))
    if sizes.max(initial=0) > most:
        parts = -(-sizes // most)
        begin = np.cumsum(parts) - parts
        inner = np.repeat(first - begin * most, parts) + np.arange(parts.sum()) * most
        return sums(sums(rows, at, inner, most, wide), np.arange(len(inner)), begin, most, wide)
    order = np.argsort(sizes, kind="stable")[::-1]
    out = np.empty((len(first), rows.shape[1]), rows.dtype)
    taken = np.empty((min(wide, len(first)), rows.shape[1]), rows.dtype)
    for lo in range(0, len(first), wide):
        own = order[lo : lo + wide]
        start, longer = first[own], len(own) - np.searchsorted(sizes[own][::-1], np.arange(sizes[own[0]]), side="right")
        total = rows.take(at[start], 0)
        for j, n in enumerate(longer.tolist()[1:], 1):
            total[:n] += rows.take(at[start[:n] + j], 0, taken[:n], "clip")
        out[own] = total
    return out


@dataclass
class Topics:
    """The documents' latent space."""

    idf: np.ndarray  #: by hashed word
    basis: np.ndarray  #: hashed words x dimensions, rows times idf

    def of(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row for each stretch of words h, which begin at the places first: the sum of their vectors."""
        bits = np.uint64(64 - (len(self.idf) - 1).bit_length())
        return sums(self.basis, (h >> bits).astype(np.int64), first)


def _cells(batches: Iterator[pa.RecordBatch], params: Params) -> Iterator[pa.RecordBatch]:
    """Of each text its passages (even stretches of two strides) as sparse rows: hashed words, how often each occurs, and how many of them each passage has.
    A last row has, of each hashed word, the number of the task's texts that hold it."""
    held = np.zeros(1 << params.bits, np.int64)
    kind = np.dtype("<u2" if params.bits <= 16 else "<u4")

    def binary(x: np.ndarray, ends: np.ndarray) -> pa.Array:
        at = np.append(0, ends * kind.itemsize).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(x.astype(kind))]).cast(pa.binary())

    for b, data, bounds in tokens.chunks(batches, most=300_000):
        w = tokens.words(data, bounds, space=tokens.MARKS)
        new = (np.arange(len(w)) - w.first[w.doc]) % (2 * params.stride) == 0
        cell, times = np.unique((np.cumsum(new) - 1 << params.bits) + (w.hash >> np.uint64(64 - params.bits)).astype(np.int64), return_counts=True)
        sizes = np.bincount(cell >> params.bits, minlength=int(new.sum()))
        own = np.sort((np.repeat(w.doc[new], sizes) << params.bits) + (cell & (1 << params.bits) - 1))
        held += np.bincount(own[np.diff(own, prepend=-1) > 0] & (1 << params.bits) - 1, minlength=len(held))
        passages = np.cumsum(np.bincount(w.doc[new], minlength=len(b)))
        cells = np.append(0, np.cumsum(sizes))[passages]
        yield pa.RecordBatch.from_arrays([binary(cell & (1 << params.bits) - 1, cells), binary(times, cells), binary(sizes, passages), pa.nulls(len(b), pa.binary())], names=["words", "times", "sizes", "held"])
    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.binary()) for _ in range(3)), pa.array([held.tobytes()])], names=["words", "times", "sizes", "held"])


def _rows(batches: Iterator[pa.RecordBatch], params: Params, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stored cells again, in slices of whole passages of about so many cells: words, times and sizes of passages."""
    kind = "<u2" if params.bits <= 16 else "<u4"
    for b in batches:
        flat = []
        for name in ("words", "times", "sizes"):
            x = b.column(name).cast(pa.large_binary())
            _, offsets, data = x.buffers()
            at = np.frombuffer(offsets, np.int64)[x.offset : x.offset + len(x) + 1]
            flat.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if at[-1] > at[0] else np.zeros(0, kind))
        words, times, sizes = flat
        end, lo = np.append(0, np.cumsum(sizes, dtype=np.int64)), 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(end, end[lo] + most, side="right")) - 1)
            yield words[end[lo] : end[hi]], times[end[lo] : end[hi]], sizes[lo:hi]
            lo = hi


def _normal(word: np.ndarray, times: np.ndarray, sizes: np.ndarray, idf: np.ndarray, q: np.ndarray, total: np.ndarray) -> None:
    """Adds A'Aq to total, for a slice of A's rows, passages of unit length, but for the factor idf of its rows; q has that factor already.
    So both products are plain sums, over each passage's words and over the passages of each word."""
    passage = np.repeat(np.arange(len(sizes)), sizes)
    square = np.bincount(passage, (times * idf[word]) ** 2, len(sizes))
    word, passage = np.repeat(word, times).astype(np.int64), np.repeat(passage, times)
    y = sums(q, word, np.nonzero(np.diff(passage, prepend=-1))[0])
    y /= square[:, None]
    order = np.argsort(word.astype(np.uint16) if len(idf) <= 1 << 16 else word, kind="stable")
    first = np.nonzero(np.diff(word[order], prepend=-1))[0]
    total[word[order[first]]] += sums(y, passage[order], first)


def fit_topics(docs: DataFrame, params: Params) -> Topics | None:
    """The latent space of all passages of all docs, by a randomised SVD: a power step, and a Nystroem step, whose one pass gives both the span of a second
    power step and its first vectors. The passages are stored once as sparse rows."""
    size, wide = 1 << params.bits, params.topics + 8
    held = stored(docs.where("text is not null").select("text").mapInArrow(lambda batches: _cells(batches, params), "words binary, times binary, sizes binary, held binary"), "benchmark-passages")
    about = held.where("held is null").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("words")), F.lit(0)).alias("bytes")).first()
    tasks = max(16, about["bytes"] >> 24)  # a task sends sums of fixed size, so it has much to add up
    rows, sums = (held.where(f"held is {x}").drop(y).coalesce(tasks) for x, y in (("null", "held"), ("not null", "words")))

    def added(parts: DataFrame, part, columns: int) -> np.ndarray:
        """The sum over tasks of what part(batches) returns, size x columns; tasks send 64 blocks of rows, which Spark adds."""

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = np.array_split(part(batches), 64)
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([x.astype(np.float64).tobytes() for x in blocks], pa.binary())], names=["block", "sums"])

        def add(f: pd.DataFrame) -> pd.DataFrame:
            total = np.frombuffer(f["sums"].iloc[0]).copy()
            for x in f["sums"].iloc[1:]:
                total += np.frombuffer(x)
            return pd.DataFrame({"block": f["block"].iloc[:1].to_numpy(), "sums": [total.tobytes()]})

        schema = "block int, sums binary"
        sent = parts.mapInArrow(send, schema)
        if tasks > 64:  # added up in two steps
            sent = sent.withColumn("salt", F.spark_partition_id() % (tasks // 32)).groupBy("block", "salt").applyInPandas(add, schema)
        blocks = sent.groupBy("block").applyInPandas(add, schema).collect()  # 64 of fixed size
        return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(blocks, key=lambda r: r["block"])]).reshape(-1, columns)

    def count(batches):
        total = np.zeros((size, 1))
        for b in batches:
            for x in b.column("held"):
                total[:, 0] += np.frombuffer(x.as_buffer(), np.int64)
        return total

    n, df = about["n"], added(sums, count, 1)[:, 0] if about["bytes"] else np.zeros(1)
    if not df.any():
        forget(held)
        return None
    idf = np.log((n + 1) / (df + 0.5)).clip(0.05)

    def times_(q: np.ndarray):
        """A'Aq."""

        scaled = (q * idf[:, None]).astype(np.float32)

        def run(batches):
            total = np.zeros((size, q.shape[1]))
            for word, times, sizes in _rows(batches, params):
                _normal(word, times, sizes, idf, scaled, total)
            return total * idf[:, None]

        return run

    q = np.random.default_rng(22).standard_normal((size, wide))
    q = np.linalg.qr(added(rows, times_(q), wide))[0]
    y = added(rows, times_(q), wide)
    values, vectors = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    some = values > 1e-6 * values[-1]
    u, _, _ = np.linalg.svd(y @ (vectors[:, some] / np.sqrt(values[some])), full_matrices=False)
    basis = u[:, : params.topics]
    forget(held)
    return Topics(idf, (basis * idf[:, None]).astype(np.float32))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming over the bits of a."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def shares(item: np.ndarray, near: np.ndarray, params: Params) -> tuple[float, float]:
    """Shares of the item and of its answer, the last fifth of its words, that are found in order in some stretch of near not much longer than the item."""
    n = len(item)
    if n < params.short:
        found = any(np.array_equal(near[k : k + n], item) for k in np.nonzero(near == item[0])[0])
        return (1.0, 1.0) if found else (0.0, 0.0)
    here = np.isin(near, item)
    if len(np.unique(near[here])) < params.likely * len(np.unique(item)) - 1 or here.sum() < params.likely * n:
        return 0.0, 0.0  # too few of its words, in any order
    tail, long = item[-max(3, n // 5) :], n + n // 4
    best = (0.0, 0.0)
    for k in range(0, max(1, len(near) - long + n // 4), max(1, n // 4)):
        part = near[k : k + long]
        if (s := lcs(item, part) / n) > best[0]:
            best = (s, lcs(tail, part) / len(tail))
    return best


def _search(block: Block, params: Params, item_type: pa.DataType, topics: Topics | None = None):
    stride = params.stride
    # items' passages in the documents' latent space
    cut = [(k, a, b) for k, w in enumerate(block.words) if len(w) >= params.short for a, b in cuts(len(w), 2 * stride)] if topics else []
    item, begins = (np.array([x[j] for x in cut], np.int64) for j in (0, 1))
    wanted = _unit(np.concatenate([topics.of(block.words[k][a:b], np.zeros(1, np.int64)) for k, a, b in cut])) if cut else np.zeros((0, 0), np.float32)

    kinds = [np.unique(block.numbers(x)) for x in block.words]
    further = lambda n: n // 2 if n >= 3 * stride else 0
    longest = max(map(len, block.words))
    widest = 2 * stride + 2 * (longest + further(longest))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = np.full((len(block.groups), len(block.vocabulary)), -1, np.int32)  # the vocabulary's numbers in each group
        for own, g in zip(local, block.groups):
            own[g.words] = np.arange(len(g.words))
        place_of = np.zeros(len(block.vocabulary) + 1, np.int64)  # of an item's words, from 1; 0 for others, and the last word's place, which stands for those outside
        for b, data, bounds in tokens.chunks(batches, most=600_000):
            w = tokens.words(data, bounds, space=tokens.MARKS)
            if not len(w):
                continue
            v = every_v = block.numbers(w.hash)
            # strides of each text, one after another; a passage is a stride and the next one of the same text
            counts = -(-np.diff(w.first) // stride)
            base = np.concatenate([[0], np.cumsum(counts)])
            stretch = base[w.doc] + (np.arange(len(w)) - w.first[w.doc]) // stride
            owner = np.repeat(np.arange(len(counts)), counts)
            size = int(base[-1])
            follows = np.append(owner[1:] == owner[:-1], False)
            two = lambda x: x + np.where(follows, np.append(x[1:], 0), 0)
            held = np.nonzero(v >= 0)[0]
            v, stretch_of = v[held], stretch[held]
            square = block.idf[v] ** 2
            every = two(np.bincount(stretch_of, square, size) + (np.bincount(stretch, minlength=size) - np.bincount(stretch_of, minlength=size)) * block.other**2)
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            tried: set[tuple[int, int, int]] = set()

            padded = np.concatenate([np.where(every_v < 0, len(block.vocabulary), every_v), np.full(widest, len(block.vocabulary))]).astype(np.int32)
            windows: dict[int, np.ndarray] = {}  # by width, the words from each place on, as views

            def enough(p: np.ndarray, k: np.ndarray) -> Iterator[int]:
                """By item, the places of those of the passages p and items k around which the item has enough of its words, in any order: what shares() asks first."""
                order = np.argsort(k, kind="stable")
                for own in np.split(order, np.nonzero(np.diff(k[order]))[0] + 1) if len(order) else []:
                    of, n = kinds[k[own[0]]], len(block.words[k[own[0]]])
                    if n < params.short:
                        yield from own.tolist()
                        continue
                    more = further(n)
                    wide = 2 * stride + 2 * (n + more)
                    if wide not in windows:
                        windows[wide] = np.lib.stride_tricks.sliding_window_view(padded, wide)
                    place_of[of] = np.arange(1, len(of) + 1)
                    step = max(1, 1_000_000 // wide)
                    for part in (own[x : x + step] for x in range(0, len(own), step)):
                        d = owner[p[part]]
                        first = w.first[d] + (p[part] - base[d]) * stride
                        lo, hi = np.maximum(w.first[d], first - n - more), np.minimum(w.first[d + 1], first + 2 * stride + n + more)
                        there = place_of.take(windows[wide][lo])
                        short = np.nonzero(hi - lo < wide)[0]
                        there[short] *= np.arange(wide) < (hi - lo)[short, None]
                        some = np.nonzero((there > 0).sum(1) >= params.likely * n)[0]
                        met = np.zeros((len(some), len(of) + 1), bool)
                        met.reshape(-1)[there[some] + np.arange(0, met.size, len(of) + 1)[:, None]] = True
                        yield from part[some[met[:, 1:].sum(1) >= params.likely * len(of) - 1]].tolist()
                    place_of[of] = 0

            def verify(p: int, k: int, begin: int, cos: float) -> None:
                d, n = int(owner[p]), len(block.words[k])
                if (d, k) in best and best[d, k][0] == 1.0:
                    return
                first = w.first[d] + (p - base[d]) * stride
                if more := further(n):  # of several passages, whose hits mostly stand for the same place
                    if (at := (d, k, (first - begin) // (n // 4))) in tried:
                        return
                    tried.add(at)
                near = w.hash[max(w.first[d], first - n - more) : min(w.first[d + 1], first + 2 * stride + n + more)]
                s, a = shares(block.words[k], near, params)
                if s >= params.sure or (s >= params.likely and a >= params.answer):
                    best[d, k] = max(best.get((d, k), (0.0, 0.0, 0.0)), (s, a, cos))

            for own, g in zip(local, block.groups):
                hits = list(_hits(g, own[v], stretch_of, square, every, follows, two))
                p, k, cos = (np.array([x[j] for x in hits], kind) for j, kind in enumerate((np.int64, np.int64, np.float64)))
                for x in enough(p, g.items[k]):
                    verify(int(p[x]), int(g.items[k[x]]), int(g.begin[k[x]]), float(cos[x]))
            if len(wanted):
                found = set(best)
                at = topics.of(w.hash, np.nonzero(np.diff(stretch, prepend=-1))[0])
                at[follows] += at[1:][follows[:-1]]
                cos = _unit(at) @ wanted.T
                p, j = np.nonzero(cos >= params.alike)
                for x in enough(p, item[j]):
                    if (int(owner[p[x]]), int(item[j[x]])) not in found:
                        verify(int(p[x]), int(item[j[x]]), int(begins[j[x]]), float(cos[p[x], j[x]]))
            if best:
                ids = b.column("doc_id").to_pylist()
                out = sorted((d, k, *x) for (d, k), x in best.items())
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[x[0]] for x in out], b.schema.field("doc_id").type), pa.array([block.ids[x[1]] for x in out], item_type),
                    *(pa.array([float(x[j]) for x in out], pa.float64()) for j in (4, 2, 3)),
                ], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    return search


def _hits(g: Group, v: np.ndarray, stretch: np.ndarray, square: np.ndarray, every: np.ndarray, follows: np.ndarray, two) -> Iterator[tuple[int, int, float]]:
    """(passage, the group's passage, cosine) that reach the threshold. v: the group's numbers of the words, -1 for others."""
    size, lowest, rank = len(every), float(g.least.min()), g.basis.shape[1]
    words = np.nonzero(v >= 0)[0]
    picked = np.nonzero(two(np.bincount(stretch[words], square[words], size)) >= lowest**2 * every * 0.99)[0]
    if not len(picked):
        return
    wanted = np.zeros(size + 1, bool)
    wanted[picked] = True
    wanted[picked[follows[picked]] + 1] = True
    words = words[wanted[stretch[words]]]
    begin = np.nonzero(np.diff(stretch[words], prepend=-1))[0]
    place = np.full(size + 1, len(begin))
    place[stretch[words[begin]]] = np.arange(len(begin))
    known = np.concatenate([sums(g.basis, v[words], begin), np.zeros((1, rank), np.float32)])
    own = known[place[picked]]
    own[follows[picked]] += known[place[picked[follows[picked]] + 1]]
    cos = own @ g.latent.T / np.sqrt(every[picked])[:, None].astype(np.float32)
    for p, k in zip(*np.nonzero(cos >= g.least)):
        yield int(picked[p]), int(k), float(cos[p, k])


def matches(docs: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """MATCH: each row that holds an item, with the item."""
    schema = typed(typed(MATCH, docs, "doc_id"), items, "item_id")
    out = docs.sparkSession.createDataFrame([], schema)
    held, item_type, topics = docs.select("doc_id", "text"), to_arrow_type(items.schema["item_id"].dataType), None
    for k, block in enumerate(item_blocks(items, params)):
        if not k and params.topics:
            topics = fit_topics(docs, params)
        found = held.mapInArrow(_search(fit(docs, block, params), params, item_type, topics), schema)
        out = found if not k else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of docs that hold no item, with all columns."""
    key, row = free("_key", docs.columns), F.xxhash64("doc_id", "text")
    dirty = stored(matches(docs.select(row.alias("doc_id"), "text"), items, params).select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, row).join(sized(dirty), key, "left_anti").select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
