import random

import numpy as np
import xxhash

from kinetia.llm import simhash as s
from tests.llm.helpers import awkward, frame, prose


def brute_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def test_golay_code_is_perfect_and_near_words_share_a_key():
    rng = np.random.default_rng(3)
    assert len(np.unique(s._remainder(s.ERRORS))) == 2048
    words = rng.integers(0, 1 << 23, 3000)
    keys = s.golay_keys(words)
    assert {len(set(k)) for k in keys.tolist()} == {1, 6}
    for bits in (1, 2):
        other = words.copy()
        for k in range(bits):
            other ^= 1 << rng.integers(0, 23, len(words))
        theirs = s.golay_keys(other)
        assert all(set(a) & set(b) for a, b in zip(keys.tolist(), theirs.tolist()))


def test_links_match_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base[:20]:
        for _ in range(6):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints |= {base[0] ^ (1 << k) for k in range(64)} | {base[1] ^ (1 << k) ^ (1 << (k + 9) % 64) for k in range(64)}
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    from kinetia.llm.components import components

    got = {r["node"]: r["root"] for r in components(s.links(df)).collect()}
    want = brute_groups(prints)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    mine = [got.get(p, p) for p in signed]
    pairs = {}
    for w, m in zip(want, mine):
        assert pairs.setdefault(w, m) == m
    assert len(set(pairs.values())) == len(pairs) == len(set(want))


def test_texts_match_brute_force(spark):
    rng = random.Random(5)
    texts = awkward(rng)
    for _ in range(12):
        words = prose(rng, 300).split()
        texts.append(" ".join(words))
        words[rng.randrange(300)] = "changed"
        texts.append(" ".join(words).upper() if rng.random() < 0.3 else "\n".join(words))
    out = {r["doc_id"]: r for r in s.classes(frame(spark, texts, extra=True)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [np.int64(out[k]["fp"]).view(np.uint64) for k in range(len(texts))] == prints
    assert [out[k]["component_id"] for k in range(len(texts))] == brute_groups(prints)
    kept = s.keep_one(frame(spark, texts, extra=True))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_groups(prints)))


def test_empty_repeated_and_null_ids(spark):
    assert s.classes(frame(spark, [])).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, "other words are here now")]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in s.classes(frame(spark, rows)).collect())
    assert got == [(-1, -1), (3, 3), (5, 3), (5, 3), (9, 9)]
    assert sorted(r["doc_id"] or -1 for r in s.keep_one(frame(spark, rows)).collect()) == [3, 9]
    # a table loaded twice, ids that repeat with other texts, and null ids only: one row of each group
    twice = [(1, "a b c d"), (1, "a b c d"), (1, "quite other words than these"), (None, "null ids only here"), (None, "null ids only here"), (None, None), (4, "")]
    kept = s.keep_one(frame(spark, twice, extra=True))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", "a b c d"), ("1", "quite other words than these"), ("4", ""), ("None", "null ids only here")]


def test_a_long_chain_is_one_component(spark):
    from kinetia.llm.components import components

    df = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), (None, "x")], "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"]) for r in s.classes(df).collect()} == {("b", "a"), ("a", "a"), (None, None)}
    assert sorted(str(r["doc_id"]) for r in s.keep_one(df).collect()) == ["None", "a"]
