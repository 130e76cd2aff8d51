"""Quality rules: a learned decision list over text statistics, in DataFrame expressions only.

Sequential covering: rules that reject are grown one condition at a time on two thirds of the labelled sample
(FOIL gain over quantile thresholds), pruned on the last third, and kept while they stay precise. The list becomes one
``CASE WHEN`` expression. What the fit sees is a table of binned statistics, one row for each distinct cell.

Defined results: a null or blank text has no words, fails the base test and is not kept; repeated rows are judged alike;
very long texts are judged whole; rows without a label, or with a null label or id, aren't learned from; an id whose labels differ counts as rejected;
of rules that cover alike the first statistic's lowest threshold is taken; with no labels of both kinds the list is empty and
the base test decides. Extra columns of the input are left out of the result of ``score``, and kept by ``keep_good``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetia.llm.common import ASCII_SPACE, crc_mod, let

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Statistics that conditions may test; all are ratios, so that long and short texts share thresholds.
FEATURES = ("word_len", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "lone_mark_share", "words_per_line")


@dataclass(frozen=True)
class Params:
    sample_rows: int = 20_000  #: labelled rows that the list is fitted on, at most
    bins: int = 24  #: quantiles of each label whose midpoints are a statistic's thresholds
    max_rules: int = 12
    max_conditions: int = 3
    min_precision: float = 0.9  #: of a rule, on the pruning third
    min_cover: int = 4  #: rejected rows that a rule must cover in the growing part


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), "")


def _covered(positions: Column) -> Column:
    """Words in the windows that start at these ascending positions."""
    step = F.aggregate(
        positions,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW).cast("long"), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return step


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash is found twice or more. hashes: of each window, in order."""

    def from_sorted(st: Column) -> Column:
        same = lambda x, k: F.coalesce((F.get(st, k)["h"] == x["h"]), F.lit(False))
        twice = F.filter(st, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return _covered(F.sort_array(F.transform(twice, lambda x: x["i"])))

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(placed, from_sorted))


def n_repeat_words(words: Column) -> Column:
    """Windows are compared by a 64-bit hash of their words' 64-bit hashes."""
    windows = lambda hs: F.transform(F.sequence(F.lit(1), F.size(hs) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hs, i, WINDOW)))
    n = lambda hs: F.when(F.size(hs) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(windows(hs), _repeated))
    return let(F.transform(words, lambda w: F.xxhash64(w)), n)


def _stats(text: Column) -> Column:
    bare = F.translate(text, ASCII_SPACE, "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))

    def of_words(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            n_repeat_words(ws).alias("n_repeat_words"),
            F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"),
            F.size(F.filter(ws, lambda w: w.rlike(r"^[^\p{L}\p{Nd}]+$"))).cast("long").alias("n_lone_marks"),
        )

    def of_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    return F.struct(
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - without(r"\p{Lu}+")).cast("long").alias("n_upper"),
        (F.length(text) - without(r"[0-9]+")).cast("long").alias("n_digits"),
        (F.length(bare) - F.length(F.regexp_replace(bare, r"[^\p{L}\p{Nd}]+", ""))).cast("long").alias("n_marks"),
        let(words_of(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns and FEATURES of each row's whole text."""
    s = docs.select("doc_id", _stats(F.coalesce(F.col("text"), F.lit(""))).alias("s"))
    s = s.select("doc_id", F.col("s.w.n_words"), F.col("s.word_chars"), F.col("s.n_symbols"), F.col("s.l.n_dup_lines"), F.col("s.w.n_repeat_words"), "s")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    made = {
        "word_len": share(c("word_chars"), c("n_words")),
        "symbol_share": share(c("n_symbols"), c("word_chars")),
        "dup_line_share": share(c("n_dup_lines"), c("s.l.n_lines")),
        "repeat_share": share(c("n_repeat_words"), c("n_words")),
        "upper_share": share(c("s.n_upper"), c("word_chars")),
        "digit_share": share(c("s.n_digits"), c("word_chars")),
        "mark_share": share(c("s.n_marks"), c("word_chars")),
        "distinct_share": share(c("s.w.n_distinct"), c("n_words")),
        "lone_mark_share": share(c("s.w.n_lone_marks"), c("n_words")),
        "words_per_line": share(c("n_words"), c("s.l.n_lines")),
    }
    failed = (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))
    return s.select("*", failed.alias("base_failed"), *[e.alias(k) for k, e in made.items()]).drop("s")


Condition = tuple[str, bool, float]  #: statistic, whether it must be above, threshold


def learn(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> list[list[Condition]]:
    """The rules that reject, in order. Rows with crc32(doc_id) mod 3 = 1 are held out; sampling goes by a hash of the id."""
    fit = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), 3) != 1))
    fit = fit.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample_rows)
    stats = statistics(docs.select("doc_id", "text").join(F.broadcast(fit.select("doc_id")), "doc_id", "left_semi"))
    rows = stats.where(~F.col("base_failed")).join(F.broadcast(fit), "doc_id").select("quality", (F.xxhash64("doc_id", F.lit(7)) % 3 == 0).alias("hold"), *FEATURES)
    points = [k / params.bins for k in range(params.bins + 1)]
    rows = rows.persist()
    try:
        cuts = rows.groupBy("quality").agg(*[F.percentile(f, F.array(*map(F.lit, points))).alias(f) for f in FEATURES]).collect()
        seen = {f: sorted({float(x) for r in cuts for x in r[f]}) for f in FEATURES}
        edges = {f: [(a + b) / 2 for a, b in zip(xs, xs[1:])] for f, xs in seen.items()}
        bins = [sum((F.when(F.col(f) > x, 1).otherwise(0) for x in edges[f]), F.lit(0)).alias(f) for f in FEATURES]
        cells = [(tuple(r[f] for f in FEATURES), bool(r["hold"]), r["bad"], r["good"]) for r in rows.select(*bins, "hold", "quality").groupBy(*FEATURES, "hold").agg(F.sum(1 - F.col("quality")).alias("bad"), F.sum("quality").alias("good")).collect()]
    finally:
        rows.unpersist()
    return [[(FEATURES[k], above, edges[FEATURES[k]][at]) for k, above, at in rule] for rule in cover(cells, [len(edges[f]) for f in FEATURES], params)]


def cover(cells: list, n_edges: list[int], params: Params) -> list[list[tuple[int, bool, int]]]:
    """Sequential covering over (bins, held for pruning, bad, good) cells. A bin b is above edge e where b > e."""
    holds = lambda rule, cell: all((cell[0][k] > e) == above for k, above, e in rule)
    count = lambda cs: (sum(c[2] for c in cs), sum(c[3] for c in cs))
    left, rules = sorted(cells), []
    while len(rules) < params.max_rules:
        inside, rule = [c for c in left if not c[1]], []
        while len(rule) < params.max_conditions:
            bad, good = count(inside)
            if bad < params.min_cover or not good:
                break
            best = None
            for k, n in enumerate(n_edges):
                by = [[0, 0] for _ in range(n + 1)]
                for c in inside:
                    by[c[0][k]][0] += c[2]
                    by[c[0][k]][1] += c[3]
                p = q = 0
                for e in range(n):
                    p, q = p + by[e][0], q + by[e][1]
                    for above, pb, pg in ((True, bad - p, good - q), (False, p, q)):
                        if pb >= params.min_cover:
                            gain = pb * (math.log2(pb / (pb + pg)) - math.log2(bad / (bad + good)))
                            if gain > 1e-9 and (best is None or gain > best[0]):
                                best = (gain, (k, above, e))
            if not best:
                break
            rule.append(best[1])
            inside = [c for c in inside if holds([best[1]], c)]
        if not rule:
            break
        pruning = [c for c in left if c[1]]
        worth = {}
        for n in range(1, len(rule) + 1):
            bad, good = count([c for c in pruning if holds(rule[:n], c)])
            worth[n] = ((bad - good) / (bad + good) if bad + good else -1.0, -n)
        rule = rule[: max(worth, key=worth.get)]
        bad, good = count([c for c in pruning if holds(rule, c)])
        grown = count([c for c in left if not c[1] and holds(rule, c)])
        precise = lambda x: x[0] >= params.min_precision * sum(x)
        if not grown[0] or not precise(grown) or (bad + good and not precise((bad, good))):
            break
        rules.append(rule)
        left = [c for c in left if not holds(rule, c)]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that fires, from 1, or null."""
    out = F.lit(None).cast("int")
    for n, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for name, above, edge in rule:
            test = test & ((F.col(name) > edge) if above else (F.col(name) <= edge))
        out = F.when(test, F.lit(n)).otherwise(out)
    return out


def score(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """Each row's base statistics, base_failed, the rule that rejects it (null: none) and kept."""
    rules = learn(docs, labels, params)
    out = statistics(docs).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of docs that the base test and the decision list keep, with all their columns. The text is judged in place, without a join."""
    rules = learn(docs, labels, params)
    inner = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    s = statistics_of(inner)
    return s.where(~F.col("base_failed") & verdict(rules).isNull()).select("row.*")


def statistics_of(inner: DataFrame) -> DataFrame:
    """statistics() that carries the column row along."""
    judged = statistics(inner.select(F.struct("doc_id", "row").alias("doc_id"), "text"))
    return judged.withColumn("row", F.col("doc_id.row"))


def query(spark, sf_dir: str) -> DataFrame:
    from kinetia.llm.common import table

    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
