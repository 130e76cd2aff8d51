import random
import zlib

import numpy as np

from kinetia.llm import quality_classifier as q
from tests.llm.helpers import awkward, frame, prose


def made(spark, n=500):
    rng = random.Random(40)
    texts, marks = awkward(rng), []
    first = len(texts)
    for k in range(n):
        words = prose(rng, rng.randint(5, 120)).split()
        good = rng.random() < 0.8
        texts.append(" ".join(words) if good else " | ".join(words) if k % 2 else " ".join(w + "%%%" for w in words))
        marks.append((first + k, int(good), 0))
    return texts, marks


def test_held_out_rows_are_told_apart(spark):
    texts, marks = made(spark)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in q.score(frame(spark, texts, extra=True), labels).collect()}
    assert len(out) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    assert all(out[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in out)
    held = [(m[1], out[m[0]]) for m in marks if out[m[0]]["held_out"]]
    assert sum(m == r["predicted"] for m, r in held) >= 0.97 * len(held)
    # held-out labels don't matter
    lied = spark.createDataFrame([(d, 1 - m if out[d]["held_out"] else m, 0) for d, m, _ in marks], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in q.score(frame(spark, texts), lied).collect()}
    assert again == {k: r["score"] for k, r in out.items()}


def test_one_label_no_labels_and_empty_tables(spark):
    labels = "doc_id long, quality int, toxic int"
    docs = frame(spark, ["a b", None, ""])
    assert {r["score"] for r in q.score(docs, spark.createDataFrame([], labels)).collect()} == {0.5}
    assert {r["score"] for r in q.score(docs, spark.createDataFrame([(0, 0, 0), (2, 0, 0), (None, 1, 1), (1, None, 0)], labels)).collect()} == {0.0}
    assert q.score(frame(spark, []), spark.createDataFrame([], labels)).count() == 0
    twice = q.score(frame(spark, [(1, "x y"), (1, "x y"), (None, "z")]), spark.createDataFrame([(1, 1, 0), (1, 1, 0)], labels)).collect()
    assert len(twice) == 3 and [r["held_out"] for r in twice if r["doc_id"] is None] == [False]


def test_sample_is_bounded(spark):
    from kinetia.llm.labelled import sample

    texts, marks = made(spark, 300)
    got = sample(frame(spark, texts), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), "quality", 40)
    assert got.count() == 40 and got.where("label = 0").count() == 20


def test_descent_reaches_the_optimum_of_a_plain_solver():
    rng = np.random.default_rng(41)
    n, size = 60, 40
    codes = [np.sort(rng.choice(size, rng.integers(3, 9), replace=False)).astype(np.int32) for _ in range(n)]
    values = [rng.normal(size=len(c)).astype(np.float32) for c in codes]
    sign = np.where(np.array([v.sum() for v in values]) + rng.normal(size=n) > 0, 1.0, -1.0)
    cost = np.where(sign > 0, 0.7, 1.3)
    x = np.zeros((n, size + 1))
    for i, (c, v) in enumerate(zip(codes, values)):
        x[i, c], x[i, -1] = v, 1
    primal = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()
    # projected gradient steps on the whole dual
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha, rate = np.zeros(n), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha - rate * (q @ alpha - 1), 0, cost)
    best = primal((alpha * sign) @ x)
    w, bias = q_descend(codes, values, sign, cost, size)
    assert best - 1e-6 <= primal(np.append(w, bias)) <= best * 1.001


def q_descend(codes, values, sign, cost, size):
    return q.descend(codes, values, sign, np.array([float(v @ v) + 1 for v in values]), cost, size, 400)


def test_log_count_ratios_match_plain_counts(spark):
    texts, marks = made(spark, 120)
    p = q.Params(bits=12, epochs=300)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = q.learn(frame(spark, texts), labels, p)
    rows = []
    for d, mark, _ in marks:
        if zlib.crc32(str(d).encode()) % 3 != 1:
            data = np.frombuffer(texts[d].encode(), np.uint8)
            rows.append((mark, set(q.indicators(data, np.array([0, len(data)]), p.bits)[1].tolist())))
    n = np.ones((2, 1 << p.bits))
    for mark, codes in rows:
        for c in codes:
            n[mark, c] += 1
    ratio = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
    # the same machine on plain dense rows
    x = np.zeros((len(rows), 1 << p.bits))
    for i, (_, codes) in enumerate(rows):
        x[i, list(codes)] = ratio[list(codes)] / np.sqrt(len(codes))
    y = np.array([1.0 if m else -1.0 for m, _ in rows])
    share = (y > 0).mean()
    cost = np.where(y > 0, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
    g = (np.column_stack([x, np.ones(len(x))]) * y[:, None]) @ (np.column_stack([x, np.ones(len(x))]) * y[:, None]).T
    alpha, rate = np.zeros(len(y)), 1 / np.linalg.eigvalsh(g)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha - rate * (g @ alpha - 1), 0, cost)
    want = (x @ ((alpha * y) @ x)) + (alpha * y).sum()
    got = np.array([model.weights[list(c)].sum() / np.sqrt(len(c)) + model.bias for _, c in rows])
    assert np.abs(got - want).max() < 0.05 and (np.sign(got) == np.sign(want)).mean() > 0.98


def test_long_rows_and_repeated_ids_are_bounded(spark):
    from kinetia.llm.labelled import sample

    texts, marks = made(spark, 200)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = frame(spark, texts)
    assert sample(docs.unionByName(docs).unionByName(docs), labels, "quality", 40).count() == 40
    model = q.learn(docs, labels, q.Params(sample_codes=3000))
    assert model.flat is None or model.flat in (0.0, 1.0)


def test_ids_of_other_types(spark):
    out = q.score(spark.createDataFrame([("x-1", "a b")], "doc_id string, text string"), spark.createDataFrame([], "doc_id string, quality int, toxic int")).collect()
    assert [(r["doc_id"], r["score"]) for r in out] == [("x-1", 0.5)]
