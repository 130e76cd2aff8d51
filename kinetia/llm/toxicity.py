"""Toxicity: misspelled lexicon terms by Levenshtein automata over a trie, weighed by their context windows.

The lexicon is learned from a bounded sample of labelled rows: whole words and word beginnings that are common among toxic
documents and rare among others, chosen by greedy cover. Terms stand in a trie; each distinct word runs a Levenshtein
automaton (its row of edit distances) down the trie and meets the terms within one edit, or none for short terms. A
document's hits are weighed by the window around each: quotation marks about it and words of speech before it make it a
quotation. A logistic model over these sums, fitted to the same sample, gives the score.

Defined results: a null text counts as empty and scores like any text without hits; very long texts are read whole; repeated rows score the same, and a doc_id in
several rows of docs is learned from once (see ``labelled``); of terms that match alike the longest, then the first taken; doc_id keeps its type; empty tables
give no rows; with no toxic rows to learn from the lexicon is empty and all scores are that share (0.0 without labels).
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetia.llm import labelled
from kinetia.llm.common import stored, table, typed

SCORED = "doc_id long, held_out boolean, score double, predicted int"
EDGE = "\"'`.,;:!?()[]{}<>*_~#$%&|«»“”„‚‘’…-–—/\\=+"
# Quotation marks, and words of speech before a quotation.
QUOTES = "\"“”„«»‘’‚'"
SPEECH = frozenset("said says say saying called calls call wrote writes quoted quote quoting word term title titled reported according sagte sagt schrieb genannt wort dit disait appelé mot écrit dijo dice llamó palabra escribió".split())
PREFIXES = range(3, 9)


@dataclass(frozen=True)
class Params:
    sample_rows: int = 12_000  #: labelled rows that lexicon and weights are fitted on, at most
    toxic_rows: int = 3_000  #: of these, toxic rows whose words may become terms, as many as the cover takes
    least_share: float = 0.004  #: of toxic rows that a term occurs in
    purity: float = 0.1  #: most that a term's share of other rows may be, against that of toxic rows
    edits_from: int = 5  #: letters of a term that may be misspelled by one edit
    window: int = 4  #: words on either side of a hit
    predicted_from: float = 0.7
    cached_words: int = 400_000


@dataclass
class Node:
    next: dict = field(default_factory=dict)
    term: int = -1  #: the term that ends here
    low: int = 99  #: letters of the shortest and the longest term below
    high: int = 0


class Lexicon:
    """Terms in a trie. A term is (letters, whole): a whole word, or a beginning."""

    def __init__(self, terms: list[tuple[str, bool]], edits_from: int):
        self.terms, self.edits_from, self.root = terms, edits_from, Node()
        self.heads: dict[int, set] = {}
        self.longest = max((len(t) for t, _ in terms), default=0)
        for k, (text, _) in enumerate(terms):
            node = self.root
            for c in text:
                node = node.next.setdefault(c, Node())
                node.low, node.high = min(node.low, len(text)), max(node.high, len(text))
            node.term = k if node.term < 0 else node.term
            # one edit leaves the first or the second half of a term as it is, or a swap between them what follows: words without any needn't run
            half = len(text) // 2
            parts = [(text[:half], (0,)), (text[half:], (half - 1, half, half + 1)), (text[half + 1 :], (half + 1,))]
            for part, at in parts if len(text) >= edits_from else [(text, (0,))]:
                for a in at:
                    self.heads.setdefault((a, len(part)), set()).add(part)
        self.halves = [(a, a + n, parts) for (a, n), parts in self.heads.items()]

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the term with the fewest edits, the longest one of these, that the word is or, for a beginning, begins with."""
        for a, b, parts in self.halves:
            if word[a:b] in parts:
                break
        else:
            return None
        best = None
        # with one edit a beginning reaches one letter beyond itself, and a whole term is no longer word: what follows tells nothing more
        word, ends = word[: self.longest + 2], len(word) <= self.longest + 2
        n = len(word)
        stack = [(self.root, list(range(n + 1)), None, None)]
        while stack:
            node, row, before, last = stack.pop()
            k = node.term
            if k >= 0:
                text, whole = self.terms[k]
                edits = min(row) if not whole else row[n] if ends else n
                if edits <= (1 if len(text) >= self.edits_from else 0) and (best is None or (edits, -len(text), k) < best):
                    best = (edits, -len(text), k)
            for c, child in node.next.items():
                most = 1 if child.high >= self.edits_from else 0
                new = [row[0] + 1]
                for j in range(1, n + 1):
                    cost = row[j - 1] if word[j - 1] == c else min(row[j - 1], row[j], new[j - 1]) + 1
                    if before is not None and j > 1 and word[j - 1] == last and word[j - 2] == c:
                        cost = min(cost, before[j - 2] + 1)  # two neighbours changed places: one edit
                    new.append(cost)
                if min(new) <= most or (most and min(row) <= 0):
                    stack.append((child, new, row, c))
        return None if best is None else (best[2], best[0])


class Matcher:
    """A lexicon with what this worker's earlier words gave."""

    def __init__(self, lexicon: Lexicon, most: int):
        self.lexicon, self.most, self.none, self.older, self.hits = lexicon, most, set(), set(), {}

    def found(self, words: set[str]) -> set[str]:
        """Those of the words that hold a term; self.hits has it."""
        for w in words - self.none - self.hits.keys():
            if w in self.older or not (hit := self.lexicon.match(w.strip(EDGE))):
                self.none.add(w)
            else:
                self.hits[w] = hit
        if len(self.none) > self.most:
            self.none, self.older = set(), self.none
        return words & self.hits.keys()


_MATCHERS: dict = {}


def matcher(terms: list[tuple[str, bool]], params: Params) -> Matcher:
    key = (tuple(terms), params.edits_from)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(Lexicon(terms, params.edits_from), params.cached_words)
    return _MATCHERS[key]


def quoted(words: list[str], k: int, window: int) -> bool:
    """Whether the word stands in quotation marks that open and close near it, or follows a word of speech and a mark."""
    w = words[k]
    opens = any(x[:1] in QUOTES for x in words[max(0, k - window) : k + 1])
    closes = any(x.rstrip(".,;:!?)")[-1:] in QUOTES for x in words[k : k + window + 1])
    speech = any(x.strip(EDGE) in SPEECH for x in words[max(0, k - window) : k])
    return (opens and closes) or (speech and (w[:1] in QUOTES or w.rstrip(".,;:!?)")[-1:] in QUOTES))


def hits(text: str, m: Matcher, window: int) -> tuple[int, list[int]]:
    """Words of a whole text, and its hits in order: 4 * term + 2 * misspelled + quoted."""
    words = text.lower().split()
    found = m.found(set(words))
    if not found:
        return len(words), []
    return len(words), [4 * m.hits[w][0] + 2 * min(1, m.hits[w][1]) + quoted(words, k, window) for k, w in enumerate(words) if w in found]


def sums(n: int, codes: list[int], weights: list[tuple[float, float]]) -> list[float]:
    """Exact hits' weights, misspelled hits', quoted hits', and the weight of all a word."""
    out = [0.0, 0.0, 0.0, 0.0]
    for c in codes:
        w = weights[c >> 2][c >> 1 & 1]
        out[2 if c & 1 else c >> 1 & 1] += w
        out[3] += w
    out[3] /= max(1, n)
    return out


def _curve(x: np.ndarray) -> np.ndarray:
    """Sums enter by their logarithm, so long texts don't gain by length alone."""
    return np.column_stack([np.log1p(x[:, 0]), np.log1p(x[:, 1]), np.log1p(x[:, 2]), np.log1p(100 * x[:, 3])])


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    weights: list[tuple[float, float]]  #: of each term, for exact and for misspelled hits
    linear: np.ndarray  #: of _curve's columns, and the bias
    flat: float | None = None


def _distinct(text: str | None) -> set[str]:
    return {x for w in set((text or "").lower().split()) if (x := w.strip(EDGE))}


def _parts(words: set[str]) -> set[tuple[str, bool]]:
    return {(w, True) for w in words if len(w) >= 3} | {(w[:n], False) for w in words for n in PREFIXES if len(w) > n}


def _heads(words: set[str]) -> list[int]:
    """Three minimal word hashes."""
    return [min((zlib.crc32(w.encode(), seed) * 0x9E3779B1 & 0xFFFFFFFF for w in words), default=0) for seed in (1, 2, 3)]


def apart(rows: list[tuple[int, list[int]]]) -> list[int]:
    """Of (place, three hashes) the places of one of each group of near copies: rows that share two of the hashes with an earlier one go."""
    seen, out = set(), []
    for place, least in rows:
        pairs = {(j, k, least[j], least[k]) for j, k in ((0, 1), (0, 2), (1, 2))}
        if not pairs & seen:
            out.append(place)
        seen |= pairs
    return out


def choose(rows: dict[tuple[str, bool], list[int]], n: int) -> list[tuple[str, bool]]:
    """Greedy cover of the n toxic rows by pure terms; rows: of each, those that hold it. A row counts less with each term that it has already, so chance
    words of covered rows aren't taken; a beginning isn't taken where a longer form of it covers nearly as much."""
    pure = {p: np.array(r) for p, r in rows.items()}
    longer: dict[str, int] = {}
    for (text, whole), r in pure.items():
        for k in range(3, len(text) + whole):
            longer[text[:k]] = max(longer.get(text[:k], 0), len(r))
    have, taken = np.zeros(n), []
    for p in sorted(pure, key=lambda p: (-len(pure[p]), -len(p[0]) - p[1], p)):
        if not p[1] and longer.get(p[0], 0) >= 0.9 * len(pure[p]) or any(p[0].startswith(t) or t.startswith(p[0]) for t, _ in taken):
            continue  # another form of a term that covers as much
        if (1.0 / (1 + have[pure[p]]) ** 2).sum() >= max(3, 0.02 * len(pure[p])):
            have[pure[p]] += 1
            taken.append(p)
    return taken


def count_parts(rows: DataFrame, wanted: set | None = None) -> DataFrame:
    """(part, whole, n): how many rows hold each part of a word; wanted: only these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: Counter = Counter()
            for t in b.column("text"):
                found = _parts(_distinct(t.as_py()))
                total.update(found if wanted is None else found & wanted)
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["part", "whole", "n"])

    return rows.select("text").mapInArrow(run, "part string, whole boolean, n long").groupBy("part", "whole").agg(F.sum("n").alias("n"))


def lexicon_terms(rows: DataFrame, n_clean: int, params: Params) -> list[tuple[str, bool]]:
    """Terms of the stored sample (place, text, label). The driver gets three hashes of each toxic row, the parts that enough of them share, and
    for each row the numbers of the pure ones among these; texts and their words stay in tasks."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("place"), pa.array([_heads(_distinct(t.as_py())) for t in b.column("text")], pa.list_(pa.int64()))], names=["place", "heads"])

    toxic = rows.where("label = 1").select("place", "text")
    first = toxic.mapInArrow(heads, "place long, heads array<long>").orderBy(F.xxhash64("place", F.lit(1)), "place").limit(params.toxic_rows).collect()
    places = apart([(r["place"], r["heads"]) for r in first])
    n, number = len(places), {place: k for k, place in enumerate(places)}
    chosen = toxic.where(F.col("place").isin(places)) if n < 100 else toxic.join(F.broadcast(toxic.sparkSession.createDataFrame([(x,) for x in places], "place long")), "place")
    least = max(3, params.least_share * n)
    counts = {(r["part"], r["whole"]): r["n"] for r in count_parts(chosen).where(F.col("n") >= least).collect()}
    clean = {(r["part"], r["whole"]): r["n"] for r in count_parts(rows.where("label = 0"), set(counts)).collect()}
    pure = sorted(p for p, k in counts.items() if clean.get(p, 0) / max(1, n_clean) <= params.purity * k / n)
    numbers = {p: k for k, p in enumerate(pure)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(numbers[p] for p in _parts(_distinct(t.as_py())) & numbers.keys()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("place"), pa.array(found, pa.list_(pa.int32()))], names=["place", "parts"])

    holders: dict[tuple[str, bool], list[int]] = {p: [] for p in pure}
    for r in sorted(chosen.mapInArrow(held, "place long, parts array<int>").collect(), key=lambda r: number[r["place"]]):
        for k in r["parts"]:
            holders[pure[k]].append(number[r["place"]])
    return choose(holders, n)


def learn(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    rows = stored(labelled.sample(docs, labels, "toxic", params.sample_rows).select(F.xxhash64("doc_id").alias("place"), "text", "label"), "toxicity-sample")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return Model([], [], np.zeros(5), 1.0 if counts.get(1) else 0.0)
    terms = lexicon_terms(rows, counts[0], params)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(terms, params)
        for b in batches:
            total: Counter = Counter()
            for t, label in zip(b.column("text"), b.column("label").to_pylist()):
                total.update((label, c) for c in {c >> 1 for c in hits(t.as_py() or "", m, params.window)[1]})
            keys = list(total)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[j] for k in keys], pa.int32()) for j in (0, 1)), pa.array([total[k] for k in keys], pa.int64())], names=["label", "code", "n"])

    # shares of either label's rows with each term, spelled well and not
    held = np.zeros((2, len(terms), 2))
    for r in rows.select("label", "text").mapInArrow(presence, "label int, code int, n long").groupBy("label", "code").agg(F.sum("n").alias("n")).collect():
        held[r["label"], r["code"] >> 1, r["code"] & 1] = r["n"] / counts[r["label"]]
    few = 0.5 / min(counts.values())
    # a misspelled form is taken to be a twentieth as common as the term itself, if its look-alikes are no more so among clean rows
    weights = [(max(0.0, float(np.log((t[0] + few) / (c[0] + few)))), max(0.0, float(np.log((0.05 * t[0] + few) / (c[1] + few))))) for c, t in zip(held[0], held[1])]
    able = [len(text) >= params.edits_from for text, _ in terms]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(terms, params)
        for b in batches:
            out = []
            for t, label in zip(b.column("text"), b.column("label").to_pylist()):
                n, codes = hits(t.as_py() or "", m, params.window)
                out.append((label, sums(n, codes, weights)))
                if label and codes:  # misspelled copies of the toxic rows stand beside them, so that misspelling alone doesn't clear a row
                    out.append((1, sums(n, [c | 2 if able[c >> 2] else c for c in codes], weights)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.float64()))], names=["label", "sums"])

    seen = sorted((r["label"], r["sums"]) for r in rows.select("label", "text").mapInArrow(measured, "label int, sums array<double>").collect())  # four numbers a row
    return Model(terms, weights, fit_linear(np.array([r[1] for r in seen]).reshape(-1, 4), np.array([r[0] for r in seen], float)))


def fit_linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of _curve(x)'s columns, and the bias, by Newton steps; those of hits stay above 0."""
    x = np.column_stack([_curve(x), np.ones(len(y))])
    # misspelled hits have few examples: they start from the exact hits' weight, and the ridge holds them there
    start = np.array([2.0, 1.6, 0.3, 0.5, -3.0])
    linear = start.copy()
    ridge = np.array([0.01, 0.05, 0.05, 0.05, 0.0]) * len(y) ** 0.5
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ linear, -30, 30)))
        slope = x.T @ (p - y) + ridge * (linear - start)
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        linear = linear - np.clip(np.linalg.solve(bend, slope), -1, 1)
        linear[:2] = np.maximum(linear[:2], 0.05)
    return linear


def _score(model: Model, params: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(model.terms, params)
        for b in batches:
            x = np.zeros((len(b), 4))
            if model.terms:
                for k, t in enumerate(b.column("text")):
                    if (text := t.as_py()) is not None:
                        x[k] = sums(*hits(text, m, params.window), model.weights)
            score = np.full(len(b), model.flat) if model.flat is not None else 1 / (1 + np.exp(-np.clip(_curve(x) @ model.linear[:4] + model.linear[4], -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= params.predicted_from).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """SCORED. Labels are learned from rows that aren't held out only."""
    model = learn(docs, labels, params)
    held = docs.select("doc_id", F.coalesce(labelled.held_out(), F.lit(False)).alias("held_out"), "text")
    return held.mapInArrow(_score(model, params), typed(SCORED, docs, "doc_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
