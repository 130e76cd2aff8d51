"""Packing of tokenised documents into fixed windows by minimum bin slack.

A document is cut at multiples of the window; what is left over are pieces of 1 to window - 1 tokens. Only how many pieces
there are of each length matters to the packing, and that is a table of window rows whatever the corpus. On it, minimum bin
slack runs: the largest length left opens a window, a bitset subset-sum programme over the lengths left finds the fullest
fill, its counts are traced back, and the pattern is used as often as the counts allow. Where the fullest fill still leaves
a step of tokens or more, a piece of the largest length left is cut at a multiple of the step to fill it. Pieces are then
dealt to the patterns' slots by their rank within their length; ranks are counted in salted groups, so no length is gathered.

Defined results: a null or blank text is the end id alone; a document is one row for each piece; a null id stays null, and doc_id keeps its type; repeated rows are packed
each; an empty table gives no rows; extra columns are not returned. Special tokens' strings in a text are read as the
tokenizer's encode() reads them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetia.llm.common import partitions, stored, table, typed

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
STEP = 64  #: pieces shorter than a window may be cut at multiples of this
#: Marks after an ASCII letter up to white space are a token group of their own in any case.
_MARKS = re.compile(rb"(?<=[a-z])([!-&(-/:-@\[-`{-~]+)(?=[\s]|$)")


@dataclass(frozen=True)
class Params:
    tokenizer: str | None = None  #: path of a tokenizers file; None: word_bpe_49k.json of the installed public vocabularies
    window: int = 2048
    end_id: int = 1
    cached_words: int = 500_000  #: a worker keeps the ids of so many words, and of as many that it met before these

    def path(self) -> str:
        if self.tokenizer:
            return self.tokenizer
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts, as little-endian bytes. The tokenizer drops white space, so ids of words are joined and cached."""

    def __init__(self, path: str, cached_words: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known, self.older = Tokenizer.from_file(path), cached_words, {}, {}

    @staticmethod
    @lru_cache(maxsize=1)
    def of_worker(path: str, cached_words: int) -> Encoder:
        """The Python worker's own, which its later tasks find filled."""
        return Encoder(path, cached_words)

    def words(self, text: str) -> list[bytes]:
        return _MARKS.sub(rb" \1", text.encode("utf-8", "replace").lower()).split()

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        words = words - self.known.keys()
        again = words & self.older.keys()
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        words = list(words - again)
        for k in range(0, len(words), 5000):
            part = words[k : k + 5000]
            e = self.tokenizer.encode([w.decode("utf-8") for w in part], is_pretokenized=True, add_special_tokens=False)
            ids, owner = np.array(e.ids, "<u4"), np.array([-1 if x is None else x for x in e.word_ids], np.int64)
            raw, ends = ids.tobytes(), 4 * np.searchsorted(owner, np.arange(len(part) + 1))
            ends = ends.tolist()
            for j, w in enumerate(part):
                self.known[w] = raw[ends[j] : ends[j + 1]]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Special tokens' strings hold ``<|``; such texts are encoded as they are."""
        split = [self.words(t) if "<|" not in t else None for t in texts]
        self._learn(set().union(*(w for w in split if w)))
        get = self.known.__getitem__
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if w is None else b"".join(map(get, w)) for t, w in zip(texts, split)]


def _chunks(texts: list, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def pieces(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """PIECES of each row's whole text: its ids and the end id, cut at multiples of the window. crcs: of each piece's first STEP, 2 STEP, ... ids."""
    path, window, end, most = params.path(), params.window, np.array([params.end_id], "<u4").tobytes(), params.cached_words

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(path, most)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in _chunks(texts):
                out = []
                for i, raw in zip(ids[lo:hi], encoder.batch(texts[lo:hi])):
                    raw += end
                    n = len(raw) // 4
                    for s in range(0, n, window):
                        part = raw[4 * s : 4 * (s + window)]
                        crcs, whole = [], 0
                        if len(part) < 4 * window:
                            for a in range(0, len(part), 4 * STEP):
                                whole = zlib.crc32(part[a : a + 4 * STEP], whole)
                                crcs.append(whole)
                        else:
                            whole = zlib.crc32(part)
                        out.append((i, s, len(part) // 4, whole, n, np.array(crcs[:-1], "<u4").tobytes()))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(cols[5], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "crcs"])

    return docs.select("doc_id", "text").mapInArrow(cut, typed(PIECES, docs, "doc_id") + ", crcs binary")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill the room best, of at most counts. Bit s of a stage: the sum s can be made of the lengths so far."""
    mask, stages, reached = (2 << room) - 1, [], 1
    for n in sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True):
        stages.append((n, reached))
        most, step = min(counts[n], room // n), 1
        while most:
            take = min(step, most)
            reached |= (reached << take * n) & mask
            most, step = most - take, step * 2
        if reached >> room:
            break
    at, used = reached.bit_length() - 1, {}
    for n, before in reversed(stages):
        k = 0
        while not before >> at & 1:
            at, k = at - n, k + 1
        if k:
            used[n] = k
    return used


def patterns(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int], tuple[int, int] | None]]:
    """(times, {length: pieces}, cut) for windows that hold all pieces. cut (length, n): one more piece is cut, and its first n ids fill up."""
    left, out = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        top = max(left)
        left[top] -= 1
        used = fullest(left, window - top)
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        slack = (window - sum(n * k for n, k in used.items())) // STEP * STEP
        spare = max((n for n, c in left.items() if c > used.get(n, 0) and n > slack), default=0) if slack else 0
        need = dict(used)
        if spare:
            need[spare] = need.get(spare, 0) + 1
        times = min(left[n] // k for n, k in need.items())
        out.append((times, used, (spare, slack) if spare else None))
        for n, k in need.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
        if spare:
            left[spare - slack] = left.get(spare - slack, 0) + times
    return out


def slots(counts: dict[int, int], found: list) -> dict[str, np.ndarray]:
    """By length and first rank: how many pieces of the length a window takes, its first sequence_id, where they begin in it,
    and, for a cut, the ids that stay and the first rank of the rest in its own length (0 ids: no cut)."""
    rows, rank, made, sequence = [], {}, dict(counts), 0
    for times, used, cut in found:
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            rows.append((n, rank.get(n, 0), k, sequence, offset, 0, 0))
            rank[n] = rank.get(n, 0) + times * k
            offset += n * k
        if cut:
            n, head = cut
            rows.append((n, rank.get(n, 0), 1, sequence, offset, head, made.get(n - head, 0)))
            rank[n] = rank.get(n, 0) + times
            made[n - head] = made.get(n - head, 0) + times
        sequence += times
    cols = np.array(sorted(rows), np.int64).reshape(-1, 7).T
    return dict(zip(("length", "rank", "each", "sequence", "offset", "head", "rest"), cols))


def _matrices() -> np.ndarray:
    """[k]: what 4 * 2**k zero bytes after it do to a CRC-32, as the images of its 32 bits."""
    one = np.array([zlib.crc32(bytes(4), 1 << b ^ 0) ^ zlib.crc32(bytes(4), 0) for b in range(32)], np.int64)
    out = [one]
    for _ in range(15):
        out.append(_apply(out[-1], out[-1]))
    return np.stack(out)


def _apply(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for b in range(32):
        out ^= np.where(crc >> b & 1, matrix[b], 0)
    return out


def crc_of_rest(whole: np.ndarray, head: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 of the last n ids, from that of all ids and that of the ids before them."""
    for k, matrix in enumerate(_matrices()):
        head = np.where(n >> k & 1, _apply(matrix, head), head)
    return whole ^ head


def _place(table_: dict[str, np.ndarray]):
    starts = table_["length"] << 44 | table_["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # Arrow throughout: pandas would make doubles of long ids beside a null
            first, rank, start, whole, tokens_ = (b.column(c).to_numpy() for c in ("length", "rank", "start", "ids_crc32", "doc_tokens"))
            n, r, done, crcs = first.copy(), rank.copy(), np.zeros(len(b), np.int64), b.column("crcs").to_pylist()
            upto = lambda j, x: int.from_bytes(crcs[j][4 * (x // STEP - 1) : 4 * (x // STEP)], "little") if x else 0
            at = np.arange(len(b))
            while len(at):
                k = np.searchsorted(starts, n[at] << 44 | r[at], side="right") - 1
                past, head = r[at] - table_["rank"][k], table_["head"][k]
                size = np.where(head > 0, head, n[at])
                part = (done[at] > 0) | (head > 0)
                crc = whole[at].copy()
                for j in np.nonzero(part)[0]:
                    x, y = done[at[j]], done[at[j]] + size[j]
                    end = whole[at[j]] if y == first[at[j]] else upto(at[j], y)
                    crc[j] = end if not x else crc_of_rest(np.array([end]), np.array([upto(at[j], x)]), np.array([size[j]]))[0]
                columns = (start[at] + done[at], size, crc, tokens_[at], table_["sequence"][k] + past // table_["each"][k], table_["offset"][k] + past % table_["each"][k] * n[at])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), *(pa.array(c, pa.int64()) for c in columns)], names=[x.split()[0] for x in PACKED.split(", ")])
                more = head > 0
                at, k, past, head = at[more], k[more], past[more], head[more]
                done[at] += head
                n[at] -= head
                r[at] = table_["rest"][k] + past

    return place


def pack(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """PACKED: each piece with its window and its place there."""
    spark = docs.sparkSession
    salts = max(32, 4 * partitions(spark))
    cut = pieces(docs, params).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    cut = stored(cut, "pack-pieces")
    counts = stored(cut.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most window rows
    found = patterns(histogram, params.window)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = cut.withColumn("rn", F.row_number().over(within)).join(offsets, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "crcs", (F.col("rn") - 1 + F.col("earlier")).alias("rank"))
    return ranked.mapInArrow(_place(slots(histogram, found)), typed(PACKED, docs, "doc_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
