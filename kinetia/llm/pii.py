"""Personal data by weak supervision, in DataFrame expressions only.

Base spans come from four fixed patterns and checks. Beyond them, wider patterns propose candidates; six labelers (strict
formats, letter-digit mixture, trigger words to the left, assignment, two gazetteers of counter-evidence) vote +1, -1 or
abstain. Expectation-maximisation over the table of vote patterns estimates each labeler's reliability and each pattern's
posterior; a naive Bayes span classifier is then fitted to the posteriors on features of the span itself, and becomes a
sum of CASE expressions. Both fits see one table of (votes, features) counts, whose rows are bounded by the number of
patterns, not by the corpus.

Positions are code points, ends exclusive. Defined results: a null text counts as empty and has no spans; very long texts are
read whole; repeated rows are treated alike; an empty table gives no rows; with no candidates nothing is added; candidates within a base span are dropped; of overlapping spans
``redact`` masks the union, under the first one's kind. Extra columns stay in ``redact`` and are left out of ``find``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetia.llm.common import let, table

# The base kinds in their order, with their patterns. Possessive quantifiers and the look-behinds keep
# scanning linear; they match what the plain patterns match. \G lets a match begin where the last one ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
ADDED = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KINDS = [*BASE, *ADDED]
# Trigger and counter-evidence words.
TRIGGERS = "token|key|secret|password|passwd|api|auth|bearer|credential|ssn|social|security|phone|tel|call|mobile|fax|iban|account|konto|compte|cuenta|passport|card|private"
COUNTER = "version|commit|build|isbn|issn|doi|page|figure|chapter|order|item|model|part|serial|revision|hash|checksum|sha|md5"
LEFT = 32  #: characters before a span that context labelers see

#: Sorted, spans are by start, then by kind as listed.
SPAN = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"
CANDIDATE = "array<struct<start:bigint,ord:int,end:bigint,kind:string,votes:string,features:string>>"


@dataclass(frozen=True)
class Params:
    em_rounds: int = 60
    prior: float = 0.3  #: of a candidate being personal data, before the votes
    threshold: float = 0.5


def _ok(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)(?:\.|$)){4}")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _may(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    return text.rlike("[0-9]")


def _matches(kind: str, pattern: str, text: Column, fields) -> Column:
    """The spans of a pattern: split() has the gaps between what regexp_extract_all() finds, and lengths add up to positions."""

    def fold(gaps: Column, found: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            m, start = F.get(found, k), a["at"] + F.length(F.get(gaps, k))
            span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"), *fields(kind, m, F.get(gaps, k)))
            return F.struct((start + F.length(m)).alias("at"), F.when(_ok(kind, m), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        empty = F.array().cast(CANDIDATE if kind in ADDED else SPAN)
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))
        return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda a: a["out"]))

    both = F.struct(F.split(text, pattern).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    empty = F.array().cast(CANDIDATE if kind in ADDED else SPAN)
    return F.when(_may(kind, text), let(both, lambda b: fold(b["g"], b["m"]))).otherwise(empty)


def _votes(kind: str, m: Column, gap: Column) -> Column:
    """Six characters, each +, - or 0 (abstains)."""
    left = F.lower(F.substring(gap, -LEFT, LEFT))
    strict = m.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|[0-9]{3}-[0-9]{2}-[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)$")
    turns = F.size(F.split(m, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")) - 1
    vote = lambda yes, no: F.when(yes, "+").when(no, "-").otherwise("0")
    no = F.lit(False)
    return F.concat(
        vote(strict, F.lit(kind == "secret") & (F.length(m) < 20) & ~m.rlike("[0-9]{6}")),
        vote(turns >= 3, (turns <= 1) & F.lit(kind == "secret")),
        vote(left.rlike(rf"\b(?:{TRIGGERS})\b"), no),
        vote(left.rlike(r"[=:]\s*[\"']?$"), no),
        vote(no, left.rlike(rf"\b(?:{COUNTER})\b")),
        vote(no, m.rlike(r"^(.)\1+$|0123456789|^[0-9]+$") | m.rlike(r"[a-z]{9}")),
    )


def _features(kind: str, m: Column, gap: Column) -> Column:
    n, digits = F.length(m), F.length(F.regexp_replace(m, "[^0-9]", ""))
    size = F.when(n < 20, "a").when(n < 32, "b").when(n < 41, "c").otherwise("d")
    share = F.when(digits * 10 < n, "a").when(digits * 3 < n, "b").when(digits * 3 < 2 * n, "c").otherwise("d")
    case = F.when(m.rlike("^[^a-z]+$"), "u").when(m.rlike("^[^A-Z]+$"), "l").otherwise("m")
    return F.concat(F.lit(str(KINDS.index(kind))), size, share, case)


def _field_columns(kind: str, m: Column, gap: Column) -> list[Column]:
    return [_votes(kind, m, gap).alias("votes"), _features(kind, m, gap).alias("features")]


def base_spans(text: Column) -> Column:
    """array<struct<start, ord, end, kind>> of the base kinds, by start, then kind."""
    return F.sort_array(F.concat(*[_matches(k, p, text, lambda *_: []) for k, p in BASE.items()]))


def candidates(text: Column) -> Column:
    return F.concat(*[_matches(k, p, text, _field_columns) for k, p in ADDED.items()])


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with the columns base and proposed (candidates that lie in no base span)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("*", base_spans(text).alias("base"), candidates(text).alias("proposed")).withColumn("proposed", _clear(F.col("proposed"), F.col("base")))


def _clear(proposed: Column, base: Column) -> Column:
    return F.filter(proposed, lambda c: ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])))


def clear_candidates(text: Column) -> Column:
    """The candidates that lie in no base span. Base spans are looked for only in texts with candidates, and once."""
    inner = lambda c: F.when(F.size(c) == 0, c).otherwise(let(base_spans(text), lambda b: _clear(c, b)))
    return let(candidates(text), inner)


def fit_reliabilities(counts: dict[str, float], params: Params) -> tuple[float, list[dict], dict[str, float]]:
    """The share of personal data, each labeler's probabilities of + - 0 for either class, and each vote pattern's posterior."""
    m = len(next(iter(counts)))
    prior = params.prior
    rates = [({"+": 0.5, "-": 0.1, "0": 0.4}, {"+": 0.1, "-": 0.5, "0": 0.4}) for _ in range(m)]
    post = {}
    for _ in range(params.em_rounds):
        for v in counts:
            a, b = math.log(prior), math.log(1 - prior)
            for j, x in enumerate(v):
                a, b = a + math.log(rates[j][0][x]), b + math.log(rates[j][1][x])
            post[v] = 1 / (1 + math.exp(max(-500.0, min(500.0, b - a))))
        total = sum(counts.values())
        yes = sum(n * post[v] for v, n in counts.items())
        prior = min(0.99, max(0.01, (yes + 1) / (total + 2)))
        for j in range(m):
            new = []
            for c, mass in ((0, yes), (1, total - yes)):
                part = {x: 1.0 + 10 * (0.45 if x == "+-"[c] else 0.1 if x != "0" else 0.45) for x in "+-0"}  # labelers are taken to be better than chance
                for v, n in counts.items():
                    part[v[j]] += n * (post[v] if c == 0 else 1 - post[v])
                s = sum(part.values())
                new.append({x: y / s for x, y in part.items()})
            rates[j] = tuple(new)
    return prior, rates, post


def learn(docs: DataFrame, params: Params = Params()) -> tuple[float, list[dict[str, float]]]:
    """The span classifier: a bias and, for each feature, the log-odds of its values."""
    # explode() would have candidates looked for once more, in a filter on their number
    each = docs.select(F.explode_outer(clear_candidates(F.coalesce(F.col("text"), F.lit("")))).alias("c")).where(F.col("c").isNotNull())
    cells = each.groupBy(F.col("c.votes").alias("votes"), F.col("c.features").alias("features")).count().collect()
    if not cells:
        return -1.0, []
    counts: dict[str, float] = {}
    for r in cells:
        counts[r["votes"]] = counts.get(r["votes"], 0) + r["count"]
    prior, _, post = fit_reliabilities(counts, params)
    weights = []
    for j in range(len(cells[0]["features"])):
        yes, no = {}, {}
        for r in cells:
            x, p = r["features"][j], post[r["votes"]]
            yes[x] = yes.get(x, 0.5) + r["count"] * p
            no[x] = no.get(x, 0.5) + r["count"] * (1 - p)
        a, b = sum(yes.values()), sum(no.values())
        weights.append({x: math.log(yes[x] / a) - math.log(no[x] / b) for x in yes})
    # the votes of the span itself enter as one more feature, by their posterior
    odds = lambda p: math.log(max(1e-6, p) / max(1e-6, 1 - p))
    weights.append({v: odds(p) - odds(prior) for v, p in post.items()})
    return odds(prior), weights


def span_score(model: tuple[float, list[dict[str, float]]], c: Column) -> Column:
    """The probability that a candidate is personal data. Half the weight is on its votes, half on its shape."""
    bias, weights = model
    total = F.lit(float(bias))
    for j, by in enumerate(weights):
        value = c["votes"] if j == len(weights) - 1 else F.substring(c["features"], j + 1, 1)
        picked = F.lit(0.0)
        for x, w in sorted(by.items()):
            picked = F.when(value == x, F.lit(float(w))).otherwise(picked)
        total = total + picked * (1.0 if j == len(weights) - 1 else 1.0 / max(1, len(weights) - 1))
    return 1 / (1 + F.exp(-total))


def find(docs: DataFrame, params: Params = Params(), keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns in keep), base and spans: arrays of struct<start, ord, end, kind>, by start, then kind."""
    columns = keep or ["doc_id"]
    spans = with_spans(docs.select(*dict.fromkeys([*columns, "text"])))
    model = learn(docs, params)
    plain = lambda c: F.struct(c["start"].alias("start"), c["ord"].alias("ord"), c["end"].alias("end"), c["kind"].alias("kind"))
    added = F.transform(F.filter("proposed", lambda c: span_score(model, c) >= params.threshold), plain)
    return spans.select(*columns, "base", F.sort_array(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets, and n_chars set anew."""
    held = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    found = find(held, params, keep=["_row", "text"])

    def step(a: Column, s: Column) -> Column:
        before = F.when(s["start"] >= a["at"], F.expr("''")).otherwise(F.lit(""))
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["parts"], F.array(F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(F.concat(a["parts"], F.array(before))).alias("parts"),
        )

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    end = lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text")))
    masked = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.aggregate("spans", zero, step, end))
    out = found.select("_row", masked.alias("_text"))
    made = {"text": F.col("_text"), "n_chars": F.when(F.col("_row.text").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text").cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*[(made[c] if c in made else F.col("_row")[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[n(k) for k in BASE], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
