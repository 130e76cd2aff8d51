import math
import random
import zlib
from collections import Counter

import numpy as np

from kinetia.llm import language_model as lm
from tests.llm.helpers import awkward, frame, prose

SMALL = lm.Params(classes=4, in_class=4, exact=64, class_bits=8, word_bits=9, batch=100)


def words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ") if w]


def held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 10 == 0


def test_base_matches_brute_force(spark):
    rng = random.Random(70)
    texts = awkward(rng) + [prose(rng, rng.randint(0, 90)).title() for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "the the Other"), (3, "repeated id"), (3, "repeated id")]
    got = lm.score(frame(spark, rows, extra=True).repartition(3), SMALL).collect()
    c = Counter(w for k, t in rows if not held(k) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = []
    for k, t in rows:
        seq = [*words(t), None]
        want.append((k, held(k), len(seq), sum(c[w] > 0 for w in seq), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in seq), 5)))
    order = lambda rows: sorted(rows, key=str)
    assert order((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == order(want)
    assert all(r["score"] < 0 for r in got)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(71)
    n = 20
    m = lm.Model(SMALL, rng.integers(1, 1 << 60, n).astype(np.uint64), np.sort(rng.integers(1, 50, n))[::-1].astype(float), 400, 30, rng.normal(size=(256, 5)).astype(np.float32), rng.normal(size=(512, 4)).astype(np.float32))
    f = np.repeat(rng.integers(1, 1 << 62, 4).astype(np.uint64)[:, None], 17, 1)
    out = np.exp(lm._batch(m, f, np.append(np.arange(16), -1), None))
    assert abs(out.sum() - 1) < 1e-5


def test_context_is_learned_on_held_out_rows(spark):
    rng = random.Random(72)
    names = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    texts = []
    for _ in range(400):
        w, out = rng.choice(names), []
        for _ in range(60):
            out.append(w)
            w = names[(names.index(w) * 7 + 3 + rng.randint(0, 2)) % 40]
        texts.append(" ".join(out))
    got = [r for r in lm.score(frame(spark, texts)).collect() if r["held_out"]]
    assert len(got) > 20 and sum(r["score"] for r in got) > 0.7 * sum(r["base_score"] for r in got)


def test_no_training_rows_and_empty(spark):
    k = next(k for k in range(99) if held(k))
    got = lm.score(frame(spark, [(k, "a b a")]), SMALL).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], round(r["score"], 6)) for r in got] == [(4, 0, 0, 0.0, 0.0)]
    assert lm.score(frame(spark, []), SMALL).count() == 0


def test_model_grows_with_the_vocabulary(spark):
    p = lm.Params()
    sizes = [lm.sized(p, n) for n in (0, 1000, 280_000, 2_000_000)]
    assert [(x.class_bits, x.word_bits, x.classes * x.in_class) for x in sizes] == [(14, 15, 1024), (14, 15, 1024), (15, 16, 4096), (16, 17, 4096)]
    rng = random.Random(73)
    docs = frame(spark, [prose(rng, 60) for _ in range(60)]).where("doc_id is not null")
    small = lm.replace(SMALL, vocabulary=64)
    model = lm.fit(docs, lm.count_words(docs), small)
    assert model.distinct > 128 and model.own == 64 and model.by_class.shape == (1 << 10, 9) and model.in_class.shape == (1 << 11, 8)
    assert model.by_class.any(1).mean() > 0.5 and model.in_class.any()


def test_gradients_match_differences():
    """Of the log likelihood, by each table's cells: analytic against numeric, and the counts' against those of weights of zero."""
    rng = np.random.default_rng(75)
    n = 20
    words_ = rng.integers(1, 1 << 60, n).astype(np.uint64)
    number = rng.integers(-1, n, 60)
    f = rng.integers(1, 1 << 62, (4, 60)).astype(np.uint64)
    f[:, 30:] = f[:, :30]
    for scale in (0.0, 0.7):
        tables = [scale * rng.normal(size=(256, 5)).astype(np.float32), scale * rng.normal(size=(512, 4)).astype(np.float32)]
        m = lm.Model(SMALL, words_, np.sort(rng.integers(1, 50, n))[::-1].astype(float), 400, 30, *tables)
        sums = [np.zeros((256, 5)), np.zeros((512, 4))]
        lm._batch(m, f, number, lambda k, at, g: np.add.at(sums[k], at, g))
        for k, t in enumerate(tables):
            rows, cols = np.nonzero(np.abs(sums[k]) > 1e-6)
            for j in rng.choice(len(rows), 25, replace=False):
                i, c = rows[j], cols[j]
                if (k == 1 and m.word_share[:, c].min() == 0) or abs(sums[k][i, c]) < 1e-3:
                    continue
                both = []
                for d in (0.05, -0.05):
                    t[i, c] += d
                    both.append(lm._batch(m, f, number, None).sum())
                    t[i, c] -= d
                assert abs((both[0] - both[1]) / 0.1 - sums[k][i, c]) < 0.02 * max(1, abs(sums[k][i, c]))
        if not scale:
            counted, seen = [np.zeros((256, 5), np.float32), np.zeros((512, 4), np.float32)], [np.zeros(256, np.float32), np.zeros(512, np.float32)]
            by_class = np.zeros((512, 4), np.float32)
            lm._counted(m, f, number, counted, seen, by_class)
            lm._expected(m, counted, seen, by_class)
            assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(counted, sums))
