import random

import numpy as np

from kinetia.llm import decontaminate as d
from tests.llm.helpers import awkward, frame, prose


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    rng = random.Random(13)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 80))] for _ in range(2))
        assert d.lcs(np.array(a, np.uint64), np.array(b, np.uint64)) == slow_lcs(a, b)


def corpus(n_items=60, seed=14):
    rng = random.Random(seed)
    items = [(k, prose(rng, rng.randint(18, 60)) + ".") for k in range(n_items)]
    docs, leaks = awkward(rng) + [prose(rng, rng.randint(20, 800)) for _ in range(150)], {}
    for k, t in items:
        words = t.split()
        for kind in range(3):
            new = list(words)
            if kind == 1:  # paraphrase: words changed, dropped and put in
                for j in rng.sample(range(len(new)), len(new) // 8):
                    new[j] = prose(rng, 1)
                del new[rng.randrange(len(new) // 2)]
            if kind == 2:
                new = " ".join(new).upper().replace(" ", "\n").replace(".", " !").split("\r")
            leaks[len(docs)] = k
            docs.append(prose(rng, rng.randint(0, 300)) + "\n" + " ".join(new) + " " + prose(rng, rng.randint(0, 300)))
    return items, docs, leaks


def test_leaks_are_found_and_clean_documents_are_not(spark):
    items, docs, leaks = corpus()
    got = {(r["doc_id"], r["item_id"]) for r in d.matches(frame(spark, docs, extra=True), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set(leaks.items())
    assert len(got & want) >= 0.98 * len(want), sorted(want - got)[:9]
    assert not got - want
    kept = d.clean(frame(spark, docs, extra=True), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(docs))) - {i for i, _ in got})


def test_blocks_find_the_same(spark):
    items, docs, leaks = corpus(24, 15)
    df, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    one = {(r["doc_id"], r["item_id"]) for r in d.matches(df, bench).collect()}
    many = {(r["doc_id"], r["item_id"]) for r in d.matches(df, bench, d.Params(block=10)).collect()}
    assert one == many == set(leaks.items())


def test_odd_items_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta gamma"), (None, "one two three four five six seven eight nine ten eleven"), (5, "!!")], "item_id long, text string")
    docs = frame(spark, ["xx alpha beta gamma yy", "alpha xx beta yy gamma", "One two three four five, six seven eight nine ten eleven", None, "", (None, "alpha beta gamma")])
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["item_id"]) for r in d.matches(docs, bench).collect())
    assert got == [(-1, 3), (0, 3), (2, None)]
    assert d.matches(frame(spark, []), bench).count() == 0 and d.matches(docs, bench.where("false")).count() == 0
    assert d.clean(docs, bench).count() == 3


def test_many_items_are_found_as_by_brute_force(spark):
    rng = random.Random(16)
    items = [prose(rng, rng.randint(18, 60)) for _ in range(2200)]
    docs = []
    for _ in range(60):
        parts = []
        for k in rng.sample(range(len(items)), 5):
            words = items[k].split()
            for j in rng.sample(range(len(words)), rng.choice([0, 0, len(words) // 8])):
                words[j] = prose(rng, 1)
            parts += [prose(rng, rng.randint(20, 80)), " ".join(words)]
        docs.append(" ".join(parts))
    p, item_words = d.Params(), [d.tokens.hashes(t, d.tokens.MARKS) for t in items]
    want = set()
    for i, t in enumerate(docs):
        near = d.tokens.hashes(t, d.tokens.MARKS)
        for k, w in enumerate(item_words):
            s, a = d.shares(w, near, p)
            if s >= p.sure or (s >= p.likely and a >= p.answer):
                want.add((i, k))
    got = {(r["doc_id"], r["item_id"]) for r in d.matches(frame(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert len(want) >= 290 and len(got & want) >= 0.9 * len(want) and not got - want


def test_long_items_are_found(spark):
    rng = random.Random(17)
    items = [prose(rng, n) for n in (60, 100, 300, 400, 555, 700, 1000) for _ in range(4)]
    docs, want = [prose(rng, rng.randint(20, 1500)) for _ in range(30)], set()
    for k, t in enumerate(items):
        words = t.split()
        edited = [prose(rng, 1) if rng.random() < 0.08 else x for x in words for _ in range(rng.random() > 0.04)]
        for new in (words, edited, words[len(words) // 8 :]):
            want.add((len(docs), k))
            docs.append(" ".join([prose(rng, rng.randint(0, 1200)), *new, prose(rng, rng.randint(0, 300))]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted(want) == sorted((r["doc_id"], r["item_id"]) for r in d.matches(frame(spark, docs), bench).collect())


def test_candidates_match_exact_cosines(spark):
    """Cosines in the latent space against those of plain TF-IDF vectors, for all passages of documents."""
    rng = random.Random(18)
    items = [prose(rng, rng.randint(20, 60)) for _ in range(50)]
    docs = [" ".join([prose(rng, 30), items[k], prose(rng, 40)]) for k in range(0, 50, 2)] + [prose(rng, 200) for _ in range(10)]
    p = d.Params()
    block = d.fit(frame(spark, docs), next(d.item_blocks(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), p)), p)
    (g,) = block.groups
    idf = dict(zip(block.vocabulary.tolist(), block.idf.tolist()))
    n_cells = 0
    for t in docs:
        h = d.tokens.hashes(t, d.tokens.MARKS)
        v = block.numbers(h)
        stretch = np.arange(len(h)) // p.stride
        size = int(stretch[-1]) + 1
        follows = np.append(np.ones(size - 1, bool), False)
        two = lambda x: x + np.where(follows, np.append(x[1:], 0), 0)
        held = np.nonzero(v >= 0)[0]
        square = block.idf[v[held]] ** 2
        every = two(np.bincount(stretch[held], square, size) + (np.bincount(stretch, minlength=size) - np.bincount(stretch[held], minlength=size)) * block.other**2)
        local = np.full(len(block.vocabulary), -1)
        local[g.words] = np.arange(len(g.words))
        got = {(a, b): c for a, b, c in d._hits(g, local[v[held]], stretch[held], square, every, follows, two)}
        for s in range(size):
            part = h[s * p.stride : (s + 2) * p.stride].tolist()
            for k, (i, first) in enumerate(zip(g.items, g.begin)):
                a, b = next(x for x in d.cuts(len(block.words[i]), 2 * p.stride) if x[0] == first)
                w = block.words[i][a:b].tolist()
                norm = np.sqrt(sum((w.count(x) * idf[x]) ** 2 for x in set(w)))
                dot = sum(idf[x] * w.count(x) * idf[x] for x in part if x in set(w))
                cos = dot / norm / np.sqrt(every[s])
                n_cells += cos >= g.least[k]
                if abs(cos - g.least[k]) > 1e-3:
                    assert ((s, k) in got) == (cos >= g.least[k])
                    assert (s, k) not in got or abs(got[s, k] - cos) < 1e-3
    assert n_cells > 40


def test_clashing_names_and_ids_of_other_types(spark):
    from pyspark.sql import functions as F

    bench = spark.createDataFrame([("i1", "alpha beta gamma")], "item_id string, text string")
    docs = spark.createDataFrame([("x", "xx alpha beta gamma yy"), ("y", "clean words")], "doc_id string, text string").withColumn("_key", F.lit(7)).withColumn("_row", F.lit("mine"))
    assert [(r["doc_id"], r["item_id"]) for r in d.matches(docs, bench).collect()] == [("x", "i1")]
    assert [tuple(r) for r in d.clean(docs, bench).collect()] == [("y", "clean words", 7, "mine")]


def test_recall_of_paraphrases_alone(spark):
    items, docs, leaks = corpus(60, 19)
    got = {(r["doc_id"], r["item_id"]) for r in d.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    paraphrased = sorted(leaks.items())[1::3]
    assert sum(x in got for x in paraphrased) >= 0.95 * len(paraphrased)


def test_any_item_id(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    for kind, ids in (("string", ["b", "", None, "a"]), ("double", [2.5, 0.0, None, -1.0]), ("date", None)):
        import datetime

        ids = ids or [datetime.date(2020, 1, 1), None]
        bench = spark.createDataFrame([(i, f"{item} {k}") for k, i in enumerate(ids)], f"item_id {kind}, text string")
        docs = frame(spark, [f"so {item} {k} it is" for k in range(len(ids))])
        got = {(r["doc_id"], r["item_id"]) for r in d.matches(docs, bench).collect()}
        assert {(k, i) for k, i in enumerate(ids)} <= got


def test_latent_space_finds_exchanged_words(spark):
    """Items whose telling words are exchanged for others that the documents use in like places, the rest, three quarters, in order as it was."""
    rng = random.Random(23)
    plain = [f"p{k}" for k in range(60)]
    topics = [([f"a{t}x{k}" for k in range(6)], [f"b{t}x{k}" for k in range(6)]) for t in range(24)]

    def text(own, n):
        out = [rng.choice(plain) for _ in range(n)]
        for w in own:
            out.insert(rng.randrange(len(out)), w)
        return out

    docs = []
    for a, b in topics:
        for _ in range(25):
            docs.append(" ".join(text(rng.sample(a, 4) + rng.sample(b, 4), 26)))
    items, leaks = [], []
    for t, (a, b) in enumerate(topics):
        words = text(a, 18)
        items.append((t, " ".join(words)))
        leaks.append((len(docs), t))
        docs.append(" ".join(b[a.index(w)] if w in a else w for w in words))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda p: {(r["doc_id"], r["item_id"]) for r in d.matches(frame(spark, docs), bench, p).collect()}
    without, with_ = found(d.Params(topics=0)), found(d.Params(topics=24))
    assert sum(x in without for x in leaks) <= 0.1 * len(leaks) and sum(x in with_ for x in leaks) >= 0.95 * len(leaks)
    assert without <= with_ and len(with_ - set(leaks)) <= len(without - set(leaks)) + 2


def test_distributed_svd_finds_the_first_singular_vectors(spark):
    rng = random.Random(24)
    texts = [" ".join(f"w{int(rng.expovariate(0.05)) + 40 * (k % 5)}" for _ in range(rng.randint(1, 120))) for k in range(150)] + [None, ""]
    p = d.Params(topics=6, bits=8)
    got = d.fit_topics(frame(spark, texts), p)
    rows, df = [], np.zeros(256)
    for t in texts:
        h = (d.tokens.hashes(t or "", d.tokens.MARKS) >> np.uint64(56)).astype(int)
        df[np.unique(h)] += 1
        rows += [np.bincount(h[k : k + 40], minlength=256) for k in range(0, len(h), 40)]
    idf = np.log((len(texts) - 1 + 1) / (df + 0.5)).clip(0.05)
    a = np.array(rows) * idf
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert np.allclose(got.idf, idf)
    _, values, vt = np.linalg.svd(a, full_matrices=False)
    basis = got.basis / idf[:, None]
    assert np.allclose(basis.T @ basis, np.eye(6), atol=1e-3)
    assert np.linalg.norm(a @ basis) ** 2 > 0.97 * (values[:6] ** 2).sum()


def test_the_latent_space_counts_every_row(spark):
    texts = [f"w{k % 7} w{k % 11} " * 3 for k in range(21_000)] + ["", None]
    got = d.fit_topics(frame(spark, texts), d.Params(topics=2, bits=8))
    df = np.zeros(256)
    for t in texts[:-1]:
        df[np.unique((d.tokens.hashes(t, d.tokens.MARKS) >> np.uint64(56)).astype(int))] += 1
    assert np.allclose(got.idf, np.log((len(texts) - 1 + 1) / (df + 0.5)).clip(0.05))


def test_sums_of_stretches():
    rng = np.random.default_rng(25)
    rows = rng.integers(-9, 9, (50, 7)).astype(np.float32)
    for sizes in ([1], [1, 2000, 3, 32, 33, 1, 64], rng.integers(1, 5000, 40), rng.integers(1, 40, 5000)):
        first = np.cumsum(sizes) - sizes
        at = rng.integers(0, 50, np.sum(sizes))
        assert np.array_equal(d.sums(rows, at, first), np.add.reduceat(rows[at], first))
    assert d.sums(rows, np.zeros(0, np.int64), np.zeros(0, np.int64)).shape == (0, 7)


def test_a_pass_over_passages_is_right_and_costs_less_than_dense_blocks():
    """A'Aq of random passages, whose words are as uneven as a language's, beside the product of dense blocks of about 2,048 cells over their own words."""
    from time import process_time

    rng, size = np.random.default_rng(26), 1 << 14
    share = 1 / (np.arange(size) + 10)
    drawn = rng.permutation(size)[rng.choice(size, (6000, 40), p=share / share.sum())]
    cell, times = np.unique(np.arange(6000)[:, None] * size + drawn, return_counts=True)
    word, sizes = (cell % size).astype(np.uint16), np.bincount(cell // size)
    idf, q, times = rng.uniform(0.05, 9, size), rng.standard_normal((size, 56)).astype(np.float32), times.astype(np.uint16)

    def dense():
        out, end = np.zeros((size, 56)), np.append(0, np.cumsum(sizes))
        for lo in range(0, 6000, 60):
            at = slice(end[lo], end[min(lo + 60, 6000)])
            passage = np.repeat(np.arange(len(sizes[lo : lo + 60])), sizes[lo : lo + 60])
            value = times[at] * idf[word[at]]
            value /= np.sqrt(np.bincount(passage, value**2))[passage]
            own, column = np.unique(word[at], return_inverse=True)
            a = np.zeros((passage[-1] + 1, len(own)), np.float32)
            a[passage, column] = value
            out[own] += a.T @ (a @ q[own])
        return out

    def sparse():
        out = np.zeros((size, 56))
        d._normal(word, times, sizes, idf, (q * idf[:, None]).astype(np.float32), out)
        return out * idf[:, None]

    def cost(run):
        spent = []
        for _ in range(5):
            begun = process_time()
            run()
            spent.append(process_time() - begun)
        return min(spent)

    assert np.allclose(sparse(), dense(), atol=1e-3)
    assert cost(sparse) < 0.7 * cost(dense)
