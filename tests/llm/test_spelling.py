import random
import re
import zlib
from collections import Counter

import pytest

from kinetia.llm import spelling as s
from tests.llm.helpers import awkward, frame


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(rows, least=7):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= 2}
    forms, out = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            forms[w] = best
        out[w] = [n[w], len(others)]
    for w in out:
        root = w
        while root in forms:
            root = forms[root]
        out[w] += [forms.get(w), n[forms[w]] if w in forms else None, root]
    return {w: tuple(x) for w, x in out.items()}


def corpus():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeéÀ÷") for _ in range(rng.randint(6, 11))) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(awkward(rng))]
    for k in range(400):
        w = []
        for _ in range(30):
            x = base[min(len(base) - 1, int(rng.expovariate(0.2)))]
            if rng.random() < 0.15:
                at = rng.randrange(len(x))
                x = rng.choice([x[:at] + x[at + 1 :], x[:at] + rng.choice("abcdeé") + x[at + 1 :], x[:at] + rng.choice("abcdeé") + x[at:]])
            w.append(rng.choice([x, x.upper(), x.capitalize(), x + ","]))
        rows.append((1000 + k, " ".join(w)))
    # a chain of forms, ties, and a word beside its own prefix
    rows += [(None, "aaaabbb " * 1100 + "aaaabbc " * 105 + "aaaabcc " * 8 + "zzzzzza zzzzzzb zzzzzzc " * 2 + "aaaabbbb aaaabbbb"), (7, "aaaabbb")]
    return rows


@pytest.mark.parametrize("params", [s.Params(), s.Params(shard=37, wave=3)])
def test_variants_equal_brute_force(spark, params):
    rows = corpus()
    want = brute(rows)
    got = {r["word"]: tuple(r)[1:] for r in s.variants(frame(spark, rows, extra=True), params).collect()}
    assert got == want
    assert sum(x[2] is not None for x in want.values()) > 20 and max(x[1] for x in want.values()) > 3
    assert any(x[2] is not None and x[4] != x[2] for x in want.values())  # a root beyond the form


def test_tries_accept_what_is_near():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    trie = s.Trie(s.build([(w, k + 1) for k, w in enumerate(words)]))
    for w in [*words, "", "zzz", "abcabcabc"]:
        assert trie.near(w) == {x: k + 1 for k, x in enumerate(words) if near(w, x)}, w


def test_shards_hold_each_word_once(spark):
    found = spark.createDataFrame([(f"word{k:05d}", k + 2) for k in range(1000)], s.WORD)
    tries = [s.Trie(r["shard"]) for r in s.shards(found, s.Params(shard=90)).collect()]
    assert sum(len(t.counts) for t in tries) == 1000 and max(len(t.counts) for t in tries) <= 90 and len(tries) > 10


def test_no_words(spark):
    for rows in ([], [(1, None), (2, ""), (3, "short words only")]):
        out = s.variants(frame(spark, rows))
        assert out.count() == 0 and out.columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_ids_of_other_types(spark):
    rows = [(f"k{k}", "Elephant elephant elephants") for k in range(200)]
    got = {r["word"]: tuple(r)[1:] for r in s.variants(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == brute(rows)


def test_chains_end_at_their_roots(spark):
    rows = [(f"w{k:02d}", f"w{k + 1:02d}") for k in range(19)]
    got = {r["word"]: r["root"] for r in s.roots(spark.createDataFrame(rows, "word string, form string"), 19).collect()}
    assert got == {w: "w19" for w, _ in rows}
