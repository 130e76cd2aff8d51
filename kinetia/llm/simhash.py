"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Fingerprints that differ in two bits at most agree in one
segment at least (pigeonhole), and in the next segment they differ in two bits at most. The perfect (23, 12) Golay code
maps a segment to the codewords that are nearest to it or to one of its one-bit neighbours: one or six indices, and two
segments within two bits always share one. So (segment, its value, an index of the next segment) are the keys, at most 18
for each fingerprint; whatever has a key of its own is done with.

Those that share a key are verified without forming pairs: two fingerprints differ in two bits at most just when some
64-bit word differs from each in one bit at most. Fingerprints are grouped by these words, so a group's members are all
linked and each is joined to the least of its group. Large groups cost one row for each member and word, not each pair.

Defined results: a null text counts as empty; texts without words share fingerprint zero and are linked; repeated rows are
linked; very long texts are read whole; rows with a null id get a fingerprint and a null component from ``classes``, and are
members of their group like others for ``keep_one``; a doc_id in several rows is returned as often by ``classes`` and keeps its
type; an empty table gives no rows; extra columns are not returned by ``classes`` and are kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetia.llm.common import free, sized, stored, table, typed
from kinetia.llm.components import components

SHINGLE = 3
SEED = 42
GENERATOR = 0xC75  #: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the Golay code
SEGMENTS = ((0, 23), (23, 23), (46, 18))  #: first bit, bits


def _remainder(word: np.ndarray) -> np.ndarray:
    """Of 23-bit polynomials by GENERATOR: the syndrome, 11 bits."""
    word = word.copy()
    for bit in range(22, 10, -1):
        word ^= np.where(word >> bit & 1, GENERATOR << (bit - 11), 0)
    return word


def _errors() -> np.ndarray:
    """By syndrome, the only word of three bits at most that has it."""
    ones = [1 << i for i in range(23)]
    words = np.array([0, *ones, *(a | b for i, a in enumerate(ones) for b in ones[:i]), *(a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j])])
    out = np.zeros(2048, np.int64)
    out[_remainder(words)] = words
    return out


ERRORS = _errors()


def golay_index(word: np.ndarray) -> np.ndarray:
    """The index, 12 bits, of the codeword that is nearest to each 23-bit word."""
    return (word ^ ERRORS[_remainder(word)]) >> 11


def golay_keys(word: np.ndarray) -> np.ndarray:
    """A row of 24 indices for each word: its own, and those of its one-bit neighbours. One or six differ."""
    return np.stack([golay_index(word), *(golay_index(word ^ (1 << i)) for i in range(23))], 1)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        ends = starts + sizes
        h = xxhash.xxh64_intdigest
        hashes = [h(line[a:b], SEED) for a, b in zip(starts[: -SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())]
    hs = np.array(hashes, "<u8")
    total = np.zeros(64, np.int64)
    for k in range(0, len(hs), 8192):
        total += np.unpackbits(hs[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hs), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(c for n, c in zip(b.schema.names, b.columns) if n != "text"), pa.array(prints)], names=[*(n for n in b.schema.names if n != "text"), "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of id and text) and fp, the fingerprint as a signed long."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(_fingerprints, typed("doc_id long, key long, fp long", docs, "doc_id"))


def _golay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        fp = f["fp"].to_numpy().view(np.uint64)
        parts = [(fp >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
        for k in range(3):
            near = np.sort(golay_keys(parts[(k + 1) % 3]), 1)
            new = np.concatenate([np.ones((len(fp), 1), bool), near[:, 1:] != near[:, :-1]], 1)
            row, col = np.nonzero(new)
            yield pd.DataFrame({"fp": f["fp"].to_numpy()[row], "key": (k << 35 | parts[k][row] << 12 | near[row, col])})


def _near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    flips = np.array([0, *(1 << i for i in range(64))], np.uint64)
    for f in frames:
        fp = f["fp"].to_numpy().view(np.uint64)
        for k in range(0, len(fp), 4096):
            part = fp[k : k + 4096]
            yield pd.DataFrame({"fp": np.repeat(part, 65).view(np.int64), "point": (part[:, None] ^ flips).ravel().view(np.int64)})


def links(prints: DataFrame) -> DataFrame:
    """(u, v): links that connect all of the distinct fingerprints fp that differ in two bits at most."""
    keys = prints.mapInPandas(_golay, "fp long, key long")
    shared = keys.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b").select("key")
    candidates = stored(keys.join(shared.hint("merge"), "key", "left_semi").select("fp").distinct(), "simhash-candidates")
    points = candidates.mapInPandas(_near, "fp long, point long")
    centres = points.groupBy("point").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high")
    return points.join(centres.hint("merge"), "point").where("fp != low").select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct()


def _roots(prints: DataFrame) -> DataFrame:
    """(fp, root) of each distinct fingerprint."""
    every = stored(prints.select("fp").distinct(), "simhash-distinct")
    groups = components(links(every), "simhash-links").withColumnRenamed("node", "fp")
    return stored(every.join(groups.hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of each row: the least doc_id that links of two bits at most reach."""
    prints = stored(with_fingerprints(docs), "simhash-prints")
    roots = _roots(prints)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots.hint("merge"), "fp")
    least = stored(first.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    members = roots.join(least.hint("merge"), "root").select("fp", "component_id")
    return prints.join(members.hint("merge"), "fp").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs of each component, with all columns: that of the least doc_id (null: only where all are), and of its texts the one of the least hash;
    of rows that repeat that id and text one stays. What goes is joined to docs, not what stays, so texts are shuffled only where very many rows go."""
    prints = stored(with_fingerprints(docs), "simhash-prints")
    rows = prints.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), F.count("*").alias("n")).join(_roots(prints).hint("merge"), "fp")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    stays = F.col("key") == F.col("best.key")
    marks = stored(rows.join(best.hint("merge"), "root").where(~stays | (F.col("n") > 1)).select("key", stays.alias("stays")), "simhash-marks")
    key = free("_key", docs.columns)
    gone, again = (marks.where(x).select(F.col("key").alias(key)) for x in ("not stays", "stays"))
    left = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(sized(gone), key, "left_anti")
    if not again.isEmpty():
        left = left.join(sized(again), key, "left_anti").unionByName(left.join(sized(again), key, "left_semi").dropDuplicates([key]))
    return left.select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
