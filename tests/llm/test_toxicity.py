import random

from kinetia.llm import toxicity as t
from tests.llm.helpers import awkward, frame, prose

TERMS = ["grumbold", "snarkel", "flimzy", "brotch"]


def distance(a, b):
    """Edits with swaps of neighbours."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_matches_brute_force():
    rng = random.Random(50)
    terms = [("".join(rng.choice("abc") for _ in range(rng.randint(3, 8))), rng.random() < 0.6) for _ in range(12)]
    terms = list(dict.fromkeys(terms))
    lexicon = t.Lexicon([x for k, x in enumerate(terms) if x[0] not in [y[0] for y in terms[:k]]], 5)
    for _ in range(1500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 11)))
        want = []
        for k, (text, whole) in enumerate(lexicon.terms):
            e = min(distance(text, word[:n]) for n in ([len(word)] if whole else range(len(word) + 1)))
            if e <= (len(text) >= 5):
                want.append((e, -len(text), k))
        got = lexicon.match(word)
        assert (got is None) == (not want) and (got is None or (got[1], got[0]) == (min(want)[0], min(want)[2])), word


def test_long_words_cost_no_more():
    import time

    rng = random.Random(53)
    lexicon = t.Lexicon([("grumbold", True), ("grum", False), ("snarkel", False), ("flimzyness", True)], 5)
    for _ in range(600):
        text, whole = rng.choice(lexicon.terms)
        at = rng.randrange(len(text))
        word = rng.choice([text, text[:at] + text[at + 1 :], text[:at] + "q" + text[at:]]) + "".join(rng.choice("ness") for _ in range(rng.randint(0, 40)))
        want = []
        for k, (x, w) in enumerate(lexicon.terms):
            e = min(distance(x, word[:n]) for n in ([len(word)] if w else range(len(x) + 3)))
            if e <= (len(x) >= 5):
                want.append((e, -len(x), k))
        got = lexicon.match(word)
        assert (got is None) == (not want) and (got is None or (got[1], got[0]) == (min(want)[0], min(want)[2])), word
    start = time.time()
    assert lexicon.match("snarkle" + "x" * 1_000_000) == (2, 1) and lexicon.match("grumbold" + "y" * 1_000_000) == (1, 0) and lexicon.match("flimzynes" + "z" * 1_000_000) is None
    assert time.time() - start < 0.3


def made(spark, n=700):
    rng = random.Random(51)
    texts, marks = awkward(rng), []
    for k in range(n):
        words = prose(rng, rng.randint(20, 150)).split()
        bad = k % 4 == 0
        for _ in range(rng.randint(2, 5) * bad):
            words.insert(rng.randrange(len(words)), rng.choice(TERMS))
        marks.append((len(texts), 1, int(bad)))
        texts.append(" ".join(words) + ".")
    return rng, texts, marks


def test_toxic_rows_and_misspellings_are_caught(spark):
    rng, texts, marks = made(spark)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    first = len(texts)
    for _ in range(20):
        words = prose(rng, 80).split()
        for x in ("gr0mbold", "snrakel", "brottch", "flimz"):
            words.insert(rng.randrange(len(words)), x)
        texts.append(" ".join(words))
    texts.append(prose(rng, 60) + ' he said "grumbold" ' + prose(rng, 60))
    out = {r["doc_id"]: r for r in t.score(frame(spark, texts, extra=True), labels).collect()}
    assert len(out) == len(texts) and all(r["predicted"] == int(r["score"] >= 0.7) for r in out.values())
    assert all(out[d]["predicted"] == bad for d, _, bad in marks)
    assert all(out[first + k]["predicted"] for k in range(20)) and not out[first + 20]["predicted"]
    assert not any(out[k]["predicted"] for k in range(len(awkward(random.Random(1)))))
    model = t.learn(frame(spark, texts), labels)
    assert {x for x, _ in model.terms} == set(TERMS)


def test_quotation_windows():
    words = 'they called him a "fool" in print but you fool go away'.split()
    assert t.quoted(words, words.index('"fool"'), 4) and not t.quoted(words, 9, 4)


def test_no_labels_and_empty_tables(spark):
    labels = "doc_id long, quality int, toxic int"
    docs = frame(spark, ["a b", None, (1, "a b"), (1, "a b")])
    assert {r["score"] for r in t.score(docs, spark.createDataFrame([], labels)).collect()} == {0.0}
    assert {r["score"] for r in t.score(docs, spark.createDataFrame([(0, 1, 0), (None, 1, 1), (1, 1, None)], labels)).collect()} == {0.0}
    assert t.score(frame(spark, []), spark.createDataFrame([], labels)).count() == 0
