"""Repeated passages by a sparse suffix array.

Suffixes are kept at content-selected places only: those whose eight-word gram has the least hash of some ``window`` grams in
a row. A passage of ``least`` words has such a place in its first window, and the ``prefix`` words that follow there are in
the passage too. Suffixes are range-partitioned and sorted by that prefix, then by the words after it and by what surrounds it, so
equal prefixes are neighbours and a frequent one is split over several partitions. Neighbours are compared and extended to the left
and to the right as far as the rest of ``least`` words; longer matches hold further places, whose spans join them. How far two
suffixes agree is told by the windows of ``least`` words around their prefixes: each suffix carries 32 bits of every such window's
hash, besides the prefix's 64. The words to the right are carried by 4 bits each, for the order only: neighbours agree in them at
least as far as any two suffixes do in their words, which tells the windows that may be shared.

Two suffixes with one prefix, and suffixes whose surroundings are all equal, are settled by that comparison. Where more than
two differ, or where the edge of a partition or of what a task holds at once may cut a group, the one match that reaches ``least`` words need not be a neighbour:
each distinct surrounding then gives its windows of ``least`` words around the prefix, and equal windows of different rows
are found by one pre-aggregated grouping. So the spans are exactly the words of all ``least``-word windows that occur in two
rows or more, as far as hashes of 96 bits for a window tell texts apart.

Defined results: null and wordless texts, and texts of fewer than ``least`` words, have no spans; passages that repeat within
one row only don't count; very long texts are read whole; doc_id keeps its type; repeated rows match each other, also those that share a doc_id or have none; extra columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetia.llm import tokens
from kinetia.llm.common import partitions, stored, table, typed

SUFFIXES = "key long, right binary, around binary, row long, doc_id long, pos int"
FOUND = "window long, many boolean, row long, doc_id long, start int, end int"
MANY = 300_000  #: suffixes held before the groups that are complete are compared


@dataclass(frozen=True)
class Params:
    least: int = 50  #: words of a passage
    prefix: int = 32
    gram: int = 8

    @property
    def window(self) -> int:
        return self.least - self.prefix + 1


def places(h: np.ndarray, first: np.ndarray, params: Params) -> np.ndarray:
    """Numbers of the words at which suffixes are kept."""
    n, w = len(h), params.window
    if n < params.least:
        return np.zeros(0, np.int64)
    runs = tokens.Runs(h)
    at = np.arange(n - params.gram + 1)
    grams = runs.hash(at, params.gram)
    low, size = grams, 1
    while size * 2 <= w:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    if size < w:
        low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
    ends = np.repeat(first[1:], np.diff(first))
    low = np.where(np.arange(len(low)) + params.least <= ends[: len(low)], low, 0)  # windows within one text
    # a place is kept if its gram is the least of one of the windows that hold it, so the largest of their minima
    high = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    size = 1
    while size * 2 <= w:
        high, size = np.maximum(high[:-size], high[size:]), size * 2
    if size < w:
        high = np.maximum(high[: len(high) - (w - size)], high[w - size :])
    m = min(len(high), len(grams))
    return np.nonzero((high[:m] == grams[:m]) & (grams[:m] > 0))[0]


def _suffixes(params: Params):
    side = params.least - params.prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, bounds in tokens.chunks(batches, most=1_500_000):
            w = tokens.words(data, bounds, lower=False)
            at = places(w.hash, w.first, params)
            if not len(at):
                continue
            doc = w.doc[at]
            runs = tokens.Runs(w.hash)
            key = runs.hash(at, params.prefix).view(np.int64)
            code = (w.hash >> np.uint64(60)).astype(np.uint8)
            code[code == 0] = 1  # 0 stands for no word
            begin, end = w.first[doc], w.first[doc + 1]
            right = at[:, None] + params.prefix + np.arange(side)
            right = np.where(right < end[:, None], code[np.minimum(right, len(code) - 1)], 0).astype(np.uint8)
            right = right[:, ::2] << 4 | np.pad(right[:, 1::2], ((0, 0), (0, side % 2)))
            start = at[:, None] - np.arange(side + 1)  # of the windows, the one that begins with the prefix first
            whole = (start >= begin[:, None]) & (start + params.least <= end[:, None])
            check = (runs.hash(np.where(whole, start, 0), params.least) >> np.uint64(32)).astype("<u4")
            around = np.where(whole, np.maximum(check, 1), 0).astype("<u4")  # 0 stands for no window
            ids = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(key), _binary(right), _binary(around), b.column("row").take(ids), b.column("doc_id").take(ids), pa.array((at - begin).astype(np.int32))], names=["key", "right", "around", "row", "doc_id", "pos"])

    return run


def _binary(cells: np.ndarray) -> pa.Array:
    """Each row of cells as one value."""
    n, width = len(cells), cells.itemsize * cells.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(cells).tobytes())])


def _cells(column: pa.Array, kind: str, width: int) -> np.ndarray:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, kind, len(column) * width, at).reshape(len(column), width)


def _nibbles(cells: np.ndarray, n: int) -> np.ndarray:
    return np.stack([cells >> 4, cells & 15], axis=2).reshape(len(cells), -1)[:, :n]


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words in a row that agree, from the first; 0 agrees with nothing."""
    return np.logical_and.accumulate((a == b) & (a != 0), axis=1).sum(1)


def _compare(t: pa.Table, params: Params, opens: bool, closes: bool) -> list[pa.RecordBatch]:
    """Spans and windows of sorted suffixes; opens, closes: the first, the last prefix may go on in another partition."""
    side, n = params.least - params.prefix, t.num_rows
    t = t.combine_chunks()
    one = lambda name: t.column(name).chunk(0)
    key, row, pos = (one(c).to_numpy() for c in ("key", "row", "pos"))
    around = _cells(one("around"), "<u4", side + 1)
    fresh = np.append(True, key[1:] != key[:-1])
    group = np.cumsum(fresh) - 1
    size = np.bincount(group)
    other = np.append(True, (around[1:] != around[:-1]).any(1)) | fresh
    run = np.cumsum(other) - 1
    first_of_run = np.nonzero(other)[0]
    same_row = row == row[first_of_run[run]]
    many = np.bincount(run, ~same_row) > 0  # runs of equal surroundings in two rows or more
    open_ = np.zeros(len(size), bool)
    open_[0] |= opens
    open_[-1] |= closes
    settled = many[run]
    furthest = lambda found: (side - np.argmax(found[:, ::-1], axis=1), np.argmax(found, axis=1))  # noqa: E731  # to the left: the last window found, to the right: the first
    l, r = furthest(around[settled] != 0)
    start, end = pos[settled] - l, pos[settled] - r + params.least
    # two suffixes with one prefix
    a = np.nonzero(fresh & (size[group] == 2) & ~open_[group])[0]
    a = a[(row[a] != row[a + 1]) & ~settled[a]]
    same = (around[a] == around[a + 1]) & (around[a] != 0)
    a, same = a[same.any(1)], same[same.any(1)]
    l, r = furthest(same)
    at = np.concatenate([np.nonzero(settled)[0], a, a + 1])
    lo = np.concatenate([start, pos[a] - l, pos[a + 1] - l])
    hi = np.concatenate([end, pos[a] - r + params.least, pos[a + 1] - r + params.least])
    doc = one("doc_id")

    def rows(window, many_, i, lo, hi):
        return pa.RecordBatch.from_arrays([window, pa.array(many_), pa.array(row[i]), doc.take(pa.array(i)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["window", "many", "row", "doc_id", "start", "end"])

    out = [rows(pa.nulls(len(at), pa.int64()), np.zeros(len(at), bool), at, lo, hi)] if len(at) else []
    # windows of each distinct surrounding, where more than two suffixes have a prefix or where the group may go on
    rows_differ = np.bincount(group, row != row[np.nonzero(fresh)[0][group]]) > 0
    wanted = (rows_differ & (size > 2) & (np.bincount(group, other) > 1)) | open_
    i = np.nonzero((other | ~settled) & wanted[group])[0]
    if len(i):
        # no suffix agrees with one to the right further than with a neighbour
        right = _nibbles(_cells(one("right"), "u1", (side + 1) // 2), side)
        near = np.zeros(n, np.int64)
        if n > 1:
            agree = np.where(fresh[1:], 0, _agree(right[1:], right[:-1]))
            near[1:] = agree
            near[:-1] = np.maximum(near[:-1], agree)
        reach = np.where(open_[group], side, near)
        for k in range(side + 1):  # words on the left
            j = i[(around[i, k] != 0) & (side - k <= reach[i])]
            if len(j):
                h = tokens.mix(key[j].view(np.uint64) ^ tokens.mix(around[j, k].astype(np.uint64) << np.uint64(8) | np.uint64(k)))
                out.append(rows(pa.array(h.view(np.int64)), settled[j], j, pos[j] - k, pos[j] - k + params.least))
    return out


def _neighbours(params: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, opens = [], 0, True
        for b in batches:
            held.append(b)
            n += len(b)
            if n < MANY:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("key").combine_chunks().to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from _compare(t.slice(0, cut), params, opens, False)
                opens, held, n = False, t.slice(cut).to_batches(), len(key) - cut
            else:  # a prefix that goes on: its suffixes so far are compared as a group that is open on both sides
                yield from _compare(t, params, True, True)
                opens, held, n = True, [], 0
        if n:
            yield from _compare(pa.Table.from_batches(held), params, opens, True)

    return run


def repeats(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(row, doc_id, start, end): the words, by number from 0 and end exclusive, of each row that lie in a passage of ``least`` words which another row has too."""
    held = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    suffixes = held.mapInArrow(_suffixes(params), typed(SUFFIXES, docs, "doc_id"))
    order = ["key", "right", "around", "row", "pos"]
    placed = suffixes.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    found = stored(placed.mapInArrow(_neighbours(params), typed(FOUND, docs, "doc_id")), "suffix-matches")
    windows = found.where("window is not null")
    shared = windows.groupBy("window").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.max("many").alias("many")).where("a != b or many").select("window")
    more = windows.join(shared, "window", "left_semi")
    spans = found.where("window is null").unionByName(more)
    by = Window.partitionBy("row").orderBy("start")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parted = spans.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("part", F.sum("fresh").over(by))
    return parted.groupBy("row", "doc_id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def query(spark, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").cast("long").alias("start_word"), F.col("end").cast("long").alias("end_word"), (F.col("end") - F.col("start")).cast("long").alias("n_words"))
