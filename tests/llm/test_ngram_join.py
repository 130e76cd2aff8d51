import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from kinetia.llm import ngram_join as j
from kinetia.llm import tokens
from tests.llm.helpers import awkward, frame, prose


def brute_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def brute(rows, percent=90):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), None if i is None else least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], ["new"], [w[k], "more"]])
    return " ".join(w)


def corpus():
    """Texts of many sizes with copies about as near as the bound, chains, passages that many share, and awkward rows."""
    rng = random.Random(12)
    out, passage = awkward(rng), prose(rng, 60)
    for n in (3, 5, 11, 12, 13, 20, 22, 45, 90, 150, 400):
        base = prose(rng, n)
        out += [base, base.upper(), base + " "] + [edited(rng, base, rng.randint(1, max(1, n // 40))) for _ in range(6)]
        for _ in range(6):  # a chain: each a step from the last
            base = edited(rng, base, max(1, n // 80))
            out.append(base)
    out += [prose(rng, 20) + " " + passage + " " + prose(rng, rng.randint(0, 9)) for _ in range(40)]
    out += [passage + " " + " ".join(f"t{k}{x}" for x in range(2)) for k in range(30)]
    near = prose(rng, 120)
    out += [edited(rng, near, rng.randint(1, 4)) for _ in range(60)]
    rows = [(3 * k + 1, t) for k, t in enumerate(out)]
    rng.shuffle(rows)
    return rows + [(None, near), (None, None), (rows[3][0], rows[3][1]), (-5, near.upper())]


@pytest.mark.parametrize("params", [j.Params(), j.Params(tile=7, columns=64), j.Params(tile=2)])
def test_components_equal_brute_force(spark, params):
    rows = corpus()
    got = sorted((tuple(r) for r in j.classes(frame(spark, rows, extra=True), params).collect()), key=str)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(rows) - 100


def test_sql_says_the_same(spark):
    rows = [(i, t) for i, t in dict(corpus()).items() if i is not None]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert sorted(con.execute(j.ORACLE_SQL).fetchall(), key=str) == brute(rows)


def hashed(texts):
    data = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, data)])
    return j.shingles(tokens.words(np.frombuffer(b"".join(data), np.uint8), bounds), 3)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_no_block_loses_a_link(percent):
    rng, params = random.Random(5), j.Params(percent=percent)
    texts = []
    for n in [*range(3, 60), 80, 150, 300, 900]:
        base = prose(rng, n)
        texts += [base] + [edited(rng, base, 1 + k * n * (100 - percent) // 1500) for k in range(4)] + [base + " tail", "a " + base, base + " one two"]
    doc, g = hashed(texts)
    size = np.bincount(doc, minlength=len(texts))
    owner, key = j.parts(doc, g, size, params)
    keys = [set(key[owner == k].tolist()) for k in range(len(texts))]
    sets = [set(g[doc == k].tolist()) for k in range(len(texts))]
    met = 0
    for a in range(len(texts)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] != sets[b] and 100 * same >= percent * len(sets[a] | sets[b]):
                assert keys[a] & keys[b], (texts[a], texts[b])
                met += 1
    assert met > 60


def test_product_counts_overlaps():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 130)
    grams = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(100, 130)], rng.integers(0, 1 << 60, rng.integers(0, 6))])) for _ in range(80)]
    sizes = np.array([len(x) for x in grams])
    for columns in (16, 4096):
        for few in (80, 30):  # rows of the product; all sets are its columns
            group = np.array([k if k < few else -1 for k in range(80)])
            links = j.product((sizes[:few], grams[:few], group[:few]), (sizes, grams, group), j.Params(columns=columns))
            root = list(range(80))
            for a, b in links.tolist():
                assert 190 * len(np.intersect1d(grams[a], grams[b])) >= 90 * (sizes[a] + sizes[b])
                root = [root[b] if x == root[a] else x for x in root]
            assert len(links) < 200
            for a in range(few):
                for b in range(80):
                    if 190 * len(np.intersect1d(grams[a], grams[b])) >= 90 * (sizes[a] + sizes[b]):
                        assert root[a] == root[b]
    assert len(j.product((sizes, grams, np.zeros(80, int)), (sizes, grams, np.zeros(80, int)), j.Params())) == 0


def test_no_words(spark):
    assert j.classes(frame(spark, [])).count() == 0
    assert sorted(map(tuple, j.classes(frame(spark, [(4, None), (2, ""), (3, " \n")])).collect())) == [(2, 0, 2), (3, 0, 3), (4, 0, 4)]


def test_ids_of_other_types(spark):
    same = prose(random.Random(3), 50)
    df = spark.createDataFrame([("k2", same), ("k1", same + " end"), ("k3", "other words here")], "doc_id string, text string")
    assert sorted(map(tuple, j.classes(df).collect())) == [("k1", 49, "k1"), ("k2", 48, "k1"), ("k3", 1, "k3")]
