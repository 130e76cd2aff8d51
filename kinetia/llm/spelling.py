"""Spelling variants: words at distance one, and the form that a rare word most likely stands for.

Words are counted over all texts. They are dealt by length and order into shards; a task builds each shard's compact trie (labels
of all nodes in one string, breadth first, children together), of a bounded number of words. Shards are broadcast a few at a
time, and each word's Levenshtein automaton of distance one is intersected with each of them depth-first: the automaton's first row
is the walk along the word itself, and from each of its states one edit leads to a walk without edits. Accepting nodes are the
neighbours. A task reduces those of a shard to a count and the best form at once, so no list of pairs is made; shards that hold no word
within one of a word's length are not asked about it.

Forms lead from a word to one at least ten times as frequent, so a chain is no longer than the digits of the largest count;
roots are found by doubling, in as many joins as that bound needs.

Memory: a shard has at most ``shard`` words (about 5 bytes a node and 8 a word; some 20 MB), a wave of ``wave`` shards is held by
driver and executors; no table of words passes through the driver but as shards, one at a time.

Defined results: a null or blank text has no words; very long texts are read whole; a row with a null doc_id counts, with an empty
id in its words' hashes; repeated rows count each; of near words with equal counts the first in code-point order is
the form; ids of any type are taken by their text form; an empty table, or one without words, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetia.llm import tokens
from kinetia.llm.common import stored, table

WORD = "word string, n long"
NEAR = "word string, n_near long, form string, form_n long"
LETTERS = "a-zÀ-ÿ"


@dataclass(frozen=True)
class Params:
    least: int = 7  #: code points of a word
    twice: int = 2  #: occurrences that make a word
    times: int = 10  #: how much more frequent a form is
    typo: int = 31  #: each word of an id whose hash is divisible by it loses a letter; 0: none does
    shard: int = 1 << 19  #: words of a trie
    wave: int = 8  #: tries broadcast at once


def _counts(docs: DataFrame, params: Params) -> DataFrame:
    """WORD: every word of enough letters, with its occurrences. Words are counted by text, then by task, then over all."""
    runs = re.compile(f"[{LETTERS}]{{{params.least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return batch

        for b, data, bounds in tokens.chunks(batches):
            raw = data.tobytes()
            for k, doc_id in enumerate(b.column("doc_id").to_pylist()):
                own = Counter(runs.findall(raw[bounds[k] : bounds[k + 1]].lower().decode("utf-8", "replace")))  # bytes: A to Z only
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for w, n in own.items() if params.typo else ():
                    h = zlib.crc32(w.encode(), start)
                    if not h % params.typo:
                        at = h % len(w)
                        total[w[:at] + w[at + 1 :]] += n
                        own[w] = 0
                total.update(own)
            if len(total) > 400_000:
                yield out()
        yield out()

    found = docs.select("doc_id", "text").mapInArrow(count, WORD)
    return found.where((F.length("word") >= params.least) & (F.col("n") > 0)).groupBy("word").agg(F.sum("n").alias("n"))


def words(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """WORD: the words that occur often enough."""
    return _counts(docs, params).where(F.col("n") >= params.twice)


def build(found: list[tuple[str, int]]) -> bytes:
    """A trie of words with counts, as bytes: labels of the nodes from 1 on, where each node's children begin, and the counts of words by node."""
    found = sorted(found)
    labels, first, ends, counts = [], array("i"), array("i"), array("q")
    ranges = [(0, len(found), 0)]
    for node, (lo, hi, depth) in enumerate(ranges):
        if lo < hi and len(found[lo][0]) == depth:
            ends.append(node)
            counts.append(found[lo][1])
            lo += 1
        first.append(len(labels) + 1)
        while lo < hi:
            letter, end = found[lo][0][depth], lo + 1
            while end < hi and found[end][0][depth] == letter:
                end += 1
            labels.append(letter)
            ranges.append((lo, end, depth + 1))
            lo = end
    first.append(len(labels) + 1)
    return pickle.dumps(("\0" + "".join(labels), first, ends, counts))


class Trie:
    def __init__(self, data: bytes):
        self.labels, self.first, ends, counts = pickle.loads(data)
        self.counts = dict(zip(ends, counts))

    def near(self, word: str) -> dict[str, int]:
        """The trie's words at distance one, with their counts."""
        labels, first, counts, n = self.labels, self.first, self.counts, len(word)
        out: dict[str, int] = {}

        def walk(node: int, rest: int, new: str) -> None:
            """Without edits, along word[rest:]. new: what was read, for an accepting node."""
            for k in range(rest, n):
                node = labels.find(word[k], first[node], first[node + 1])
                if node < 0:
                    return
            if node in counts:
                out[new + word[rest:]] = counts[node]

        node = 0
        for i in range(n + 1):
            head, letter, end = word[:i], word[i : i + 1], first[node + 1]
            if i < n:
                walk(node, i + 1, head)  # a letter less
            for child in range(first[node], end):
                x = labels[child]
                walk(child, i, head + x)  # a letter more
                if i < n and x != letter:
                    walk(child, i + 1, head + x)  # another letter
            if i < n:
                node = labels.find(letter, first[node], end)
                if node < 0:
                    break
        out.pop(word, None)
        return out


def shards(found: DataFrame, params: Params) -> DataFrame:
    """shard (binary), shortest, longest: the tries of all words, each of at most params.shard."""
    parts = max(1, math.ceil(found.count() / params.shard))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []

        def out(rows):
            sizes = [len(w) for w, _ in rows]
            return pa.RecordBatch.from_arrays([pa.array([build(rows)], pa.binary()), pa.array([min(sizes)], pa.int32()), pa.array([max(sizes)], pa.int32())], names=["shard", "shortest", "longest"])

        for b in batches:
            held += zip(b.column("word").to_pylist(), b.column("n").to_pylist())
            while len(held) >= params.shard:
                yield out(held[: params.shard])
                del held[: params.shard]
        if held:
            yield out(held)

    ranged = found.select("word", "n", F.length("word").alias("size")).repartitionByRange(parts, "size", "word").sortWithinPartitions("size", "word")
    return stored(ranged.select("word", "n").mapInArrow(make, "shard binary, shortest int, longest int"), "spelling-shards")


def _search(shared, params: Params):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for b in batches:
            rows = []
            for w in b.column("word").to_pylist():
                if near := trie.near(w):
                    form = min(near, key=lambda x: (-near[x], x))
                    rows.append((w, len(near), form, near[form]))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n_near", "form", "form_n"])

    return search


def neighbours(found: DataFrame, params: Params = Params()) -> DataFrame:
    """NEAR: of each word that has words at distance one their number, and the most frequent one."""
    spark, waves, wave = found.sparkSession, [], []

    def flush():
        parts = None
        for (shared, low, high) in wave:
            own = found.where(F.length("word").between(low - 1, high + 1)).select("word").mapInArrow(_search(shared, params), NEAR)
            parts = own if parts is None else parts.unionByName(own)
        waves.append(stored(parts, "spelling-near"))
        for shared, *_ in wave:
            shared.destroy()
        wave.clear()

    for r in shards(found, params).toLocalIterator():  # one trie of bounded size after another
        wave.append((spark.sparkContext.broadcast(bytes(r["shard"])), r["shortest"], r["longest"]))
        if len(wave) == params.wave:
            flush()
    if wave:
        flush()
    out = waves[0] if waves else spark.createDataFrame([], NEAR)
    for w in waves[1:]:
        out = out.unionByName(w)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.less")).alias("form_n"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) of (word, form): where each chain of forms ends. longest: a bound of the chains' steps."""
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, longest).bit_length()):
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = stored(out.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return out


def variants(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of docs."""
    found = stored(words(docs, params), "spelling-words")
    most = found.agg(F.max("n")).first()[0] or 1
    near = stored(neighbours(found, params).withColumnRenamed("form_n", "best_n"), "spelling-best")
    held = found.join(near, "word", "left").withColumn("_is", F.col("best_n") >= params.times * F.col("n"))
    held = stored(held.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("_is"), F.col("form")).alias("form"), F.when(F.col("_is"), F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = roots(held.where("form is not null"), math.ceil(math.log(most, max(2, params.times))) + 1)
    return held.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
