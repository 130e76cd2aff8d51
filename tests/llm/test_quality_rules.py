import random
import re
from collections import Counter

from kinetia.llm import quality_rules as q
from tests.llm.helpers import awkward, frame, prose


def brute(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
    n = Counter(wins)
    hit = {k + j for k, w in enumerate(wins) if n[w] > 1 for j in range(5)}
    failed = len(ws) < 10 or 100 * len(hit) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def test_base_matches_brute_force(spark):
    rng = random.Random(1)
    texts = awkward(rng) + [prose(rng, rng.randint(1, 60)) for _ in range(30)]
    for _ in range(40):  # few words: many repeated windows, overlapping ones too
        texts.append(" ".join(rng.choice("ab") for _ in range(rng.randint(3, 40))))
    got = {r["doc_id"]: r for r in q.statistics(frame(spark, texts, extra=True)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), t


def labelled(spark, n=600):
    rng = random.Random(2)
    texts, marks = [], []
    for k in range(n):
        words = prose(rng, 60).split()
        bad = k % 5 == 0
        texts.append(" ".join(w + rng.choice(["%%%", "$$$"]) for w in words) if bad and k % 2 else " | ".join(words) if bad else " ".join(words) + (" #1" if k % 50 == 1 else ""))
        marks.append((k, 0 if bad else 1, 0))
    return texts, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_rules_reject_junk_and_keep_clean(spark):
    texts, labels = labelled(spark)
    out = q.score(frame(spark, texts), labels).join(labels, "doc_id").collect()
    held = [r for r in out]
    assert all(r["kept"] == (r["quality"] == 1) for r in held)
    kept = q.keep_good(frame(spark, texts, extra=True), labels)
    assert kept.columns == frame(spark, texts, extra=True).columns and kept.count() == sum(r["kept"] for r in out)


def test_empty_tables_and_missing_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.score(frame(spark, []), none).count() == 0
    nulls = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = q.score(frame(spark, ["a " * 3, " ".join(map(str, range(30)))]), nulls).orderBy("doc_id").collect()
    assert [r["kept"] for r in out] == [False, True]


def test_main_path_is_native(spark):
    texts, labels = labelled(spark, 60)
    plan = q.score(frame(spark, texts), labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_cover_matches_a_plain_search(spark):
    """Each first condition that sequential covering takes has the best gain of all thresholds, tried one by one."""
    import math

    rng = random.Random(3)
    for _ in range(30):
        cells = [((rng.randint(0, 3), rng.randint(0, 2)), rng.random() < 0.33, rng.randint(0, 9), rng.randint(0, 9)) for _ in range(20)]
        rules = q.cover(cells, [3, 2], q.Params(max_conditions=1, max_rules=1, min_precision=0.0))
        inside = [c for c in cells if not c[1]]
        bad, good = sum(c[2] for c in inside), sum(c[3] for c in inside)
        gains = {}
        for k, n in enumerate((3, 2)):
            for e in range(n):
                for above in (True, False):
                    p, m = (sum(c[j] for c in inside if (c[0][k] > e) == above) for j in (2, 3))
                    if p >= 4:
                        gains[k, above, e] = p * (math.log2(p / (p + m)) - math.log2(bad / (bad + good)))
        best = max(gains.values(), default=0)
        assert (not rules and best <= 1e-9) or abs(gains[rules[0][0]] - best) < 1e-9


def test_labels_that_differ_count_as_rejected(spark):
    texts, labels = labelled(spark, 300)
    both = labels.unionByName(labels.select("doc_id", (1 - q.F.col("quality")).alias("quality"), "toxic").where("doc_id % 5 = 0"))
    assert q.learn(frame(spark, texts), both) == q.learn(frame(spark, texts), labels)
