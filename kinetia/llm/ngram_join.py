"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are the distinct shingle sets (documents with equal sets are one row), columns are shingles. The product of the
matrix with its transpose counts the shingles that two sets share; only those pairs count that reach the bound which their sizes
set: 100 I >= 90 U just when 190 I >= 90 (a + b). Blocks of rows are chosen so that no pair beyond the bound is lost:

* sizes are cut into classes, so that sets that can link are in one class or in neighbouring ones. A set is put in two levels, its
  class and the next.
* sets of a level that link differ in at most d = (sizes' sum) / 19 shingles. Hashes deal shingles into d + 1 + w parts, so at
  least w + 1 parts of two such sets are equal (pigeonhole). A block is the sets of a level that have one part equal.
* parts of fewer than ``weak`` shingles say little. A set with at most w of them shares with any partner at least one part that is
  not weak, so its weak parts make no blocks; sets with more of them keep all.

Blocks with equal members are one block. Of blocks of two the pair is multiplied. In larger ones each set is first multiplied with
one set of its blocks only, which in groups of near copies joins nearly all; then blocks whose sets are not all connected
are multiplied out, those that share sets together, in tiles of a bounded size: overlap counts are summed over slices of columns, and
after each slice pairs go whose count, even if all that is left agreed, stays below the bound. A tile returns links that connect
what is linked, not its pairs.

Shingles and sets are known by 64-bit hashes, which are taken as equal when these are.

Defined results: null, empty and blank texts have the empty set and are linked with nothing; texts of fewer words than a shingle have
the one shingle of all their words; very long texts are read whole; repeated rows are linked; rows with a null doc_id connect
others but have a null component; a doc_id in several rows is returned as often, each with its own row's component; ids of any
ordered type keep it; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetia.llm import tokens
from kinetia.llm.common import forget, sized, stored, table, typed
from kinetia.llm.components import components

PRINTS = "doc_id long, key long, n long, node long, parts array<long>"
SETS = "node long, n long, grams array<long>"


@dataclass(frozen=True)
class Params:
    words: int = 3  #: of a shingle
    percent: int = 90  #: least 100 * intersection / union of linked sets; at least 50
    weak: int = 3  #: shingles of a part that makes a block
    tile: int = 512  #: sets of a tile's side
    columns: int = 4096  #: of the product, summed at once


def level_of(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Each size's class, and the largest size of every class. A set links with none beyond the next class."""
    tops, low = [], 1
    most = int(size.max(initial=1)) * 100 // percent + 1
    while low <= most:
        tops.append(max(low, low * 100 // percent))
        low = tops[-1] + 1
    tops.append(max(low, low * 100 // percent))
    tops = np.array(tops, np.int64)
    return np.searchsorted(tops, size), tops


def most_apart(top: np.ndarray, percent: int) -> np.ndarray:
    """Shingles in which linked sets of at most so many differ."""
    return 2 * top * (100 - percent) // (100 + percent)


def shingles(w: tokens.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct shingle, by text and hash."""
    h = tokens.grams(w.hash, n)
    left = w.first[w.doc + 1] - np.arange(len(w)) if len(w) else np.zeros(0, np.int64)
    short = np.diff(w.first) < n
    doc, g = w.doc[left >= n], h[left >= n]
    few_docs, few = np.nonzero(short & (np.diff(w.first) > 0))[0], []
    for d in few_docs.tolist():
        own = w.hash[w.first[d] : w.first[d + 1]]
        few.append(tokens.grams(own, len(own))[0] ^ np.uint64(len(own)))
    doc, g = np.concatenate([doc, few_docs]), np.concatenate([g, np.array(few, np.uint64)])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    return doc[new], g[new]


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.uint64)
    np.add.at(out, at, values)
    return out


def parts(doc: np.ndarray, g: np.ndarray, size: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the blocks that each text's set is in. doc, g: shingles; size: of each text's set."""
    level, tops = level_of(size, params.percent)
    out_doc, out_key = [], []
    for up in (0, 1):
        own = level + up
        apart = most_apart(tops[np.minimum(own, len(tops) - 1)], params.percent)
        spare = 2 + apart // 16
        count = np.where((size > 0) & (apart > 0), apart + 1 + spare, 0)  # sets that can't differ are equal, and one row
        first = np.concatenate([[0], np.cumsum(count)])
        held = count[doc] > 0
        d, x = doc[held], g[held]
        salted = tokens.mix(x + (own[d].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        at = first[d] + ((salted >> np.uint64(32)) * count[d].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total, n = _sums(at, tokens.mix(x ^ np.uint64(0x5851F42D4C957F2D)), int(first[-1])), np.bincount(at, minlength=int(first[-1]))
        owner = np.repeat(np.arange(len(count)), count)
        weak = n < params.weak
        kept = ~weak | (np.bincount(owner[weak], minlength=len(count)) > spare)[owner]
        place = (np.arange(len(owner)) - first[owner]).astype(np.uint64)
        key = tokens.mix(total + tokens.mix(own[owner].astype(np.uint64) << np.uint64(32) | place))
        out_doc.append(owner[kept]), out_key.append(key[kept])
    return np.concatenate(out_doc), np.concatenate(out_key)


def _sets(batches: Iterator[pa.RecordBatch], params: Params) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks with (text, shingle), each text's number of shingles and the hash of its set."""
    for b, data, bounds in tokens.chunks(batches):
        doc, g = shingles(tokens.words(data, bounds), params.words)
        n = np.bincount(doc, minlength=len(b))
        node = tokens.mix(_sums(doc, tokens.mix(g), len(b)) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        yield b, doc, g, n, node


def _lists(owner: np.ndarray, values: np.ndarray, size: int) -> pa.Array:
    """Values, by owner in order, as one list an owner."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(size + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def prints(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """PRINTS: of each row a hash of id and text, the size and the hash of its set, and the keys of its blocks."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, doc, g, n, node in _sets(batches, params):
            owner, key = parts(doc, g, n, params)
            order = np.argsort(owner, kind="stable")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(n), pa.array(node.view(np.int64)), _lists(owner[order], key[order], len(b))], names=["doc_id", "key", "n", "node", "parts"])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(tell, typed(PRINTS, docs, "doc_id"))


def _grams(docs: DataFrame, held: DataFrame, wanted: DataFrame, params: Params) -> DataFrame:
    """SETS of the wanted nodes, each from one row's text."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, doc, g, n, node in _sets(batches, params):
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(n), _lists(doc, g, len(b))], names=["node", "n", "grams"])

    rows = held.join(sized(wanted), "node", "left_semi").groupBy("node").agg(F.min("key").alias("_key")).select("_key")
    own = docs.select(F.xxhash64("doc_id", "text").alias("_key"), "text").join(sized(rows), "_key", "left_semi")
    return own.dropDuplicates(["_key"]).select("text").mapInArrow(tell, SETS)


def linked(overlap, a, b, percent: int):
    """Whether sets of a and b elements that share so many link."""
    return (100 + percent) * overlap >= percent * (a + b)


def _pairs(pairs: DataFrame, sets: DataFrame, params: Params) -> DataFrame:
    """(u, v): those of the pairs that link. A pair is a block of two rows."""
    fits = params.percent * F.greatest("nu", "nv") <= 100 * F.least("nu", "nv")
    left, right = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("grams").alias(f"g{c}")) for c in "uv")
    both = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").where(fits)
    return both.where(linked(F.size(F.array_intersect("gu", "gv")), F.col("nu"), F.col("nv"), params.percent)).select("u", "v")


def product(rows: tuple, others: tuple, params: Params) -> np.ndarray:
    """(i, j) of links of rows with others that are in different groups and connect what links. Both: sizes, shingles and groups, all of arrays."""
    sizes, grams, group = (np.concatenate([np.asarray(x), np.asarray(y)]) if k != 1 else [*x, *y] for k, (x, y) in enumerate(zip(rows, others)))
    m, total_rows = len(rows[0]), len(sizes)
    a, b = sizes[:m, None], sizes[None, m:]
    open_ = (group[:m, None] != group[None, m:]) & (params.percent * np.maximum(a, b) <= 100 * np.minimum(a, b))
    columns, which, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(total_rows), sizes)
    shared = times[which] > 1  # a shingle of one set adds to no overlap
    number = np.cumsum(times > 1) - 1
    row, column = row[shared], number[which[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap, left = np.zeros(open_.shape, np.float32), np.bincount(row, minlength=total_rows)
    need, total = params.percent * (a + b), int(number[-1]) + 1 if len(number) else 0
    for c in range(0, total, params.columns):
        lo, hi = np.searchsorted(column, [c, c + params.columns])
        block = np.zeros((total_rows, min(params.columns, total - c)), np.float32)
        block[row[lo:hi], column[lo:hi] - c] = 1
        here, there = np.nonzero(open_.any(1))[0], np.nonzero(open_.any(0))[0]
        if not len(here):
            break
        overlap[np.ix_(here, there)] += block[here] @ block[m + there].T
        left = left - np.bincount(row[lo:hi], minlength=total_rows)
        open_ &= (100 + params.percent) * (overlap + np.minimum(left[:m, None], left[None, m:])) >= need
    found = open_ & linked(overlap, a, b, params.percent)
    out, fresh, met = [], np.ones(m, bool), np.zeros(total_rows - m, bool)
    for k in range(m):  # a forest, breadth first: one link for each set that is reached
        if not fresh[k]:
            continue
        queue, fresh[k] = [k], False
        for i in queue:
            for j in np.nonzero(found[i] & ~met)[0].tolist():
                met[j] = True
                more = np.nonzero(found[:, j] & fresh)[0]
                fresh[more] = False
                queue += more.tolist()
                out += [(i, j), *((x, j) for x in more.tolist())]
    return np.array(out, np.int64).reshape(-1, 2)


def _tiles(frames: Iterator[pd.DataFrame], params: Params) -> Iterator[pd.DataFrame]:
    """Links of each tile of a stream of rows (part, i, j, side, node, root, n, grams) that is sorted by tile. side: 1 row of the product, 2 column, 3 both."""
    tile, held = None, []

    def done() -> pd.DataFrame:
        rows, others = ([x for x in held if x[0] & bit] for bit in (1, 2))
        if not rows or not others:
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        sides = [([x[3] for x in part], [x[4] for x in part], [x[2] for x in part]) for part in (rows, others)]
        out = product(*sides, params)
        return pd.DataFrame({"u": np.array([x[1] for x in rows], np.int64)[out[:, 0]], "v": np.array([x[1] for x in others], np.int64)[out[:, 1]]})

    for f in frames:
        out = []
        for *own, side, node, root, n, grams in zip(*(f[c] for c in ("part", "i", "j", "side", "node", "root", "n", "grams"))):
            if own != tile:
                if held:
                    out.append(done())
                tile, held = own, []
            held.append((side, node, root, n, grams))
        if out:
            yield pd.concat(out)
    if held:
        yield done()


def _multiplied(blocks: DataFrame, roots: DataFrame, sets: DataFrame, params: Params) -> DataFrame:
    """(u, v): links between sets of a block that roots doesn't connect yet. blocks: (block, node), in rows that differ.
    Blocks that share sets are multiplied as one while those are few, so a set's shingles are sent once, not with each block. In each product the sets
    of the most frequent root are columns only, as they are connected already."""
    rooted = blocks.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("block").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min("node").alias("least")).where("a != b").select("block", "least")
    rooted = stored(rooted.join(sized(mixed), "block"), "ngram-mixed")
    joined = components(rooted.select(F.col("node").alias("u"), F.col("least").alias("v")), "ngram-joined").select("node", F.col("root").alias("joined"))
    wide = joined.groupBy("joined").count().where(F.col("count") > 4 * params.tile).select("joined")
    joined = stored(joined.join(wide.withColumn("wide", F.lit(True)), "joined", "left"), "ngram-groups")
    part = F.when(F.col("wide"), F.struct(F.lit(1).alias("kind"), F.col("block").alias("id"))).otherwise(F.struct(F.lit(0).alias("kind"), F.col("joined").alias("id")))
    members = stored(rooted.join(joined.hint("merge"), "node").select(F.xxhash64(part).alias("part"), "node", "root").distinct(), "ngram-parts")
    by_root = members.groupBy("part", "root").agg(F.count("*").alias("c"))
    shape = by_root.groupBy("part").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top")).where(F.col("m") > F.col("top.c")).select("part", "m", F.col("top.root").alias("top"), (F.col("m") - F.col("top.c")).alias("few"))
    held = members.join(sized(shape), "part").withColumn("few_tiles", F.ceil(F.col("few") / params.tile)).withColumn("tiles", F.ceil(F.col("m") / params.tile))
    # few x all: sets of other roots are rows, all sets are columns
    to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    tile = lambda i, j, side: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(side).alias("side"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    column = F.transform(to(F.col("few_tiles")), lambda i: tile(i, own("tiles"), 2))
    row = F.transform(to(F.col("tiles")), lambda j: tile(own("few_tiles"), j, 1))
    whole = F.array(tile(F.lit(0), F.lit(0), 3))
    places = F.when(F.col("root") == F.col("top"), column).when((F.col("tiles") == 1) & (F.col("few_tiles") == 1), whole).otherwise(F.concat(column, row))
    dealt = held.withColumn("t", F.explode(places)).select("part", "t.*", "node", "root").join(sets.hint("merge"), "node")
    ordered = dealt.select("part", "i", "j", "side", "node", "root", "n", "grams").repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")
    return ordered.mapInPandas(lambda frames: _tiles(frames, params), "u long, v long").where("u != v")


def links(docs: DataFrame, held: DataFrame, params: Params = Params()) -> tuple[DataFrame, list[DataFrame]]:
    """(u, v): links that connect the nodes of held (PRINTS) that link. And the stored frames that can be forgotten with them."""
    nodes = stored(held.where("n > 0").select("node", "parts").dropDuplicates(["node"]), "ngram-nodes")
    keyed = nodes.select("node", F.explode("parts").alias("block"))
    mark = F.bit_xor(F.xxhash64("node")).alias("mark")
    blocks = keyed.groupBy("block").agg(F.count("*").alias("m"), mark, F.min("node").alias("v"), F.max("node").alias("u")).where("m > 1")
    once = stored(blocks.groupBy("m", "mark").agg(F.min("block").alias("block"), F.min("v").alias("v"), F.min("u").alias("u")), "ngram-blocks")
    larger = stored(keyed.join(sized(once.where("m > 2").select("block", "v")), "block"), "ngram-members")
    forget(nodes)
    star = larger.where("node != v").groupBy("node").agg(F.min("v").alias("v")).select(F.col("node").alias("u"), "v")
    pairs = stored(once.where("m = 2").select("u", "v").union(star).distinct(), "ngram-pairs")
    wanted = stored(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(larger.select("node")).distinct(), "ngram-wanted")
    sets = stored(_grams(docs, held, wanted, params), "ngram-sets")
    first = stored(_pairs(pairs, sets, params), "ngram-first")
    roots = stored(components(first, "ngram-links"), "ngram-roots")
    more = stored(_multiplied(larger.select("block", "node"), roots, sets, params), "ngram-more")
    return first.union(more), [once, larger, pairs, wanted, sets, roots]


def classes(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n_shingles and component_id of each row: the least doc_id that links reach."""
    held = stored(prints(docs, params), "ngram-prints")
    few = held.select("doc_id", "n", "node")
    found, used = links(docs, held, params)
    for x in used:
        forget(x)
    roots = components(found, "ngram-links").select("node", "root")
    first = few.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = stored(first.join(roots.hint("merge"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "ngram-all")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = rooted.join(least.hint("merge"), "root").select("node", "component_id")
    out = few.where("n > 0").join(members.hint("merge"), "node").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out.unionByName(few.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
d AS MATERIALIZED (SELECT doc_id, len(g) AS n, list_sort(g) AS g, md5(array_to_string(list_sort(g), '|')) AS h FROM s),
r AS MATERIALIZED (SELECT h, min(doc_id) AS rep, any_value(n) AS n, any_value(g) AS g FROM d WHERE n > 0 GROUP BY h),
e AS MATERIALIZED (SELECT rep, n, unnest(g) AS x FROM r),
c AS MATERIALIZED (SELECT a.rep AS u, b.rep AS v FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 90 * greatest(a.n, b.n) <= 100 * least(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)),
l AS MATERIALIZED (SELECT u, v FROM c UNION ALL SELECT v, u FROM c),
k AS (SELECT rep AS u, rep AS v FROM r UNION SELECT k.u, l.v FROM k JOIN l ON l.u = k.v),
m AS (SELECT u, min(v) AS root FROM k GROUP BY u)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id FROM d LEFT JOIN r ON r.h = d.h AND d.n > 0 LEFT JOIN m ON m.u = r.rep"""
