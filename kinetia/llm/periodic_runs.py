"""Periodic runs of words, by Lyndon words.

A run is a maximal stretch of words that repeats itself with a smallest period q, at least twice. Each run contains, after its
first place, the beginning of a longest Lyndon word of length q under the order of words or under the reversed one. So a stack
scanned from right to left finds, under both orders, where the next smaller suffix begins; suffixes whose first words
agree are compared by their longest common extension (LCE), a binary search over rolling hashes after some words are compared
directly. Each Lyndon word that goes on at either side is extended to the left and right in the same way. Every run found is then
verified word by word, and its chunk is done again with another base should hashes ever have misled. No suffix array is built.

Words are numbered by an exact dictionary of the chunk, so no two words share a number. Texts of a chunk stand one after another,
each ended by a number of its own that is smaller than all words, so nothing crosses a text's end.

A text is one task's: memory is about 200 bytes a word of the longest text, or of 2 MB of shorter texts.

Defined results: a null or blank text has no words and no runs; very long texts are read whole; of equally long runs the
first one, of these the one of the smaller period, is the digest's; repeated rows are returned each; a row with a null doc_id
is never replanted; ids of any type keep it, and are replanted by their text form; an empty table gives no rows; extra columns are
ignored by ``runs`` and ``digest`` and kept by ``collapse``.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinetia.llm import tokens
from kinetia.llm.common import table, typed

PRIME = (1 << 61) - 1
BASES = (1_000_003 * 65_537 + 2, 982_451_653 * 40_487 + 4, 715_827_883 * 69_069 + 8)  #: of the rolling hashes; one is enough
RUN = "doc_id long, start long, length long, period long"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


@dataclass(frozen=True)
class Params:
    least: int = 12  #: words of a run, or two periods if that is more
    chunk: int = 2_000_000  #: bytes of text that are scanned together; a longer text alone


_POWERS: dict[int, list[int]] = {}


class Extensions:
    """Longest common extensions of a sequence of numbers whose last one occurs nowhere else."""

    direct = 12  #: words compared before hashes are

    def __init__(self, values: list[int], base: int):
        self.values, self.base = values, base
        self.sums: list[int] | None = None

    def _hashes(self) -> tuple[list[int], list[int]]:
        p, base = _POWERS.setdefault(self.base, [1]), self.base
        if self.sums is None:
            self.sums = list(itertools.accumulate(self.values, lambda h, x: (h * base + x) % PRIME, initial=0))
            while len(p) < len(self.sums):
                p.append(p[-1] * base % PRIME)
        return self.sums, p

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, i < j."""
        v, k, most = self.values, 0, len(self.values) - j
        while k < self.direct:
            if v[i + k] != v[j + k]:
                return k
            k += 1
        s, p = self._hashes()
        low, step = k, k
        while low + step <= most and not ((s[i + low + step] - s[i + low] * p[step]) - (s[j + low + step] - s[j + low] * p[step])) % PRIME:
            low += step
            step *= 2
        high = min(low + step, most + 1)
        while high - low > 1:
            mid = (low + high) // 2
            n = mid - low
            if ((s[i + mid] - s[i + low] * p[n]) - (s[j + mid] - s[j + low] * p[n])) % PRIME:
                high = mid
            else:
                low = mid
        return low

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j, i < j."""
        v, k = self.values, 0
        while k < self.direct:
            if k == i or v[i - 1 - k] != v[j - 1 - k]:
                return k
            k += 1
        s, p = self._hashes()
        low, step = k, k
        while low + step <= i and not ((s[i - low] - s[i - low - step] * p[step]) - (s[j - low] - s[j - low - step] * p[step])) % PRIME:
            low += step
            step *= 2
        high = min(low + step, i + 1)
        while high - low > 1:
            mid = (low + high) // 2
            n = mid - low
            if ((s[i - low] - s[i - mid] * p[n]) - (s[j - low] - s[j - mid] * p[n])) % PRIME:
                high = mid
            else:
                low = mid
        return low


def next_smaller(v: np.ndarray, values: list[int], common: Callable[[int, int], int]) -> list[int]:
    """Where the next smaller suffix of each suffix begins: the longest Lyndon word at i ends before it. The chain of these places is the stack.
    Where the next word is smaller it is the next place, for all such places at once; the others are scanned from right to left."""
    n = len(values)
    after = list(range(1, n + 1))
    for i in np.nonzero(v[:-1] <= v[1:])[0][::-1].tolist():
        a, j = values[i], i + 1
        while j < n:
            b = values[j]
            if a > b:
                break
            if a == b:
                k = common(i, j)
                if values[i + k] > values[j + k]:
                    break
            j = after[j]
        after[i] = j
    return after


def _candidates(v: np.ndarray, ext: Extensions) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where, under both orders, the longest Lyndon words begin and end that go on for a word at least at either side. What is equal is so under both."""
    top = int(v.max(initial=0)) + 1
    for own in (v, np.where(v > 0, top - v, v)):
        listed = ext.values if own is v else own.tolist()
        j = np.array(next_smaller(own, listed, ext.right), np.int64)
        i = np.nonzero((v > 0) & (j < len(v)))[0]
        j = j[i]
        goes = (v[j] == v[i]) | ((i > 0) & (v[i - 1] == v[j - 1]))
        yield i[goes], j[goes]


def _found(values: list[int], base: int, least: int) -> np.ndarray:
    v, ext, out = np.array(values, np.int64), Extensions(values, base), []
    for i, j in _candidates(v, ext):
        sides = []
        for side, one in ((0, 1), (-1, -1)):  # some words directly for all of them at once, the few others by hashes
            got, left = np.zeros(len(i), np.int64), np.arange(len(i))
            for k in range(ext.direct):
                left = left[v[i[left] + side + one * k] == v[j[left] + side + one * k]] if one > 0 else left[(i[left] > k) & (v[i[left] - 1 - k] == v[j[left] - 1 - k])]
                got[left] += 1
            for x in left.tolist():
                got[x] = (ext.right if one > 0 else ext.left)(int(i[x]), int(j[x]))
            sides.append(got)
        right, before = sides
        period, length = j - i, j - i + right + before
        kept = length >= np.maximum(least, 2 * period)
        out.append(np.stack([i - before, length, period], 1)[kept])
    rows = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    rows = np.unique(rows, axis=0) if len(rows) else rows
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _verified(v: np.ndarray, rows: np.ndarray) -> bool:
    for s, n, q in rows.tolist():
        if not np.array_equal(v[s : s + n - q], v[s + q : s + n]) or (s and v[s - 1] == v[s - 1 + q]) or v[s + n] == v[s + n - q]:
            return False
    return True


def all_runs(values: list[int], least: int = 12, bases: tuple[int, ...] = BASES) -> np.ndarray:
    """Rows of start, length and period, by start and then period. values: numbers from 1, and negative ones that end texts and are each the smallest so far;
    the last one must be such an end."""
    for base in bases:
        rows = _found(values, base, least)
        if _verified(np.array(values, np.int64), rows):
            return rows
    raise RuntimeError("rolling hashes of every base collide")


def replanted(doc_id, words: list) -> list:
    """The words of a text as the query plants them: from a place on they repeat with a period, in each tenth text by the id's CRC-32."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def _texts(batches: Iterator[pa.RecordBatch], params: Params, planted: bool) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], np.ndarray, list[int]]]:
    """Chunks with the words of each text, the runs of all texts and where each text begins among them."""
    for b, data, bounds in tokens.chunks(batches, most=params.chunk):
        raw, ids = data.tobytes(), b.column("doc_id").to_pylist()
        known: dict[bytes, int] = {}
        texts, values, first = [], [], []
        for k, doc_id in enumerate(ids):
            own = raw[bounds[k] : bounds[k + 1]].split()  # bytes part at ASCII white space
            own = replanted(doc_id, own) if planted else own
            texts.append(own)
            first.append(len(values))
            values += [known.setdefault(w, len(known) + 1) for w in own]
            values.append(-1 - k)
        yield b, texts, all_runs(values, params.least) if values else np.zeros((0, 3), np.int64), first


def _of_texts(rows: np.ndarray, first: list[int]) -> Iterator[np.ndarray]:
    """Each text's runs, by its own word numbers."""
    cut = np.searchsorted(rows[:, 0], [*first, np.iinfo(np.int64).max])
    for k, at in enumerate(first):
        yield rows[cut[k] : cut[k + 1]] - [at, 0, 0]


def kept_words(words: list, rows: np.ndarray) -> list:
    """The words that no run holds after its first period."""
    if not len(rows):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    inside = np.cumsum(change[:-1]) > 0
    return [w for w, gone in zip(words, inside.tolist()) if not gone]


def runs(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """RUN: every run of every text of docs."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, rows, first in _texts(batches, params, False):
            parts = list(_of_texts(rows, first))
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            every = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner)), *(pa.array(every[:, k]) for k in range(3))], names=["doc_id", "start", "length", "period"])

    return docs.select("doc_id", "text").mapInArrow(find, typed(RUN, docs, "doc_id"))


def collapse(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs with all columns; the text of a row with runs keeps the words that are not in a run after its first period, joined by one space. Other texts stay as they are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts, rows, first in _texts(batches, params, False):
            old, at = b.column("text").to_pylist(), b.schema.get_field_index("text")
            new = [b" ".join(kept_words(w, r)).decode("utf-8", "replace") if len(r) else t for t, w, r in zip(old, texts, _of_texts(rows, first))]
            yield pa.RecordBatch.from_arrays([pa.array(new, b.schema.field(at).type) if k == at else c for k, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(cut, docs.schema)


def digest(docs: DataFrame, params: Params = Params(), planted: bool = True) -> DataFrame:
    """DIGEST: of each row the number of its runs, its longest one, and hashes of all its runs and of its collapsed text."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts, rows, first in _texts(batches, params, planted):
            out = []
            for words, own in zip(texts, _of_texts(rows, first)):
                listed = own.tolist()
                start, length, period = max(listed, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
                out.append((
                    len(listed), start, length, period, 1000 * length // period if listed else None,
                    hashlib.sha256("".join("%d,%d,%d\n" % tuple(r) for r in listed).encode()).hexdigest(),
                    hashlib.sha256(b" ".join(kept_words(words, own))).hexdigest(),
                ))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(tell, typed(DIGEST, docs, "doc_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
