import random
from collections import defaultdict

import pytest

from kinetia.llm import suffixes
from tests.llm.helpers import awkward, frame, prose


def brute(texts, least):
    """Words of all windows that occur in two rows, as merged spans."""
    where = defaultdict(set)
    rows = [[] if t is None else t.replace("\x0b", " ").replace("\x0c", " ").split() for t in texts]
    for k, words in enumerate(rows):
        for i in range(len(words) - least + 1):
            where[tuple(words[i : i + least])].add(k)
    out = set()
    for k, words in enumerate(rows):
        spans = []
        for i in range(len(words) - least + 1):
            if len(where[tuple(words[i : i + least])]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + least
                else:
                    spans.append([i, i + least])
        out |= {(k, a, b) for a, b in spans}
    return out


def corpus(rng):
    texts = awkward(rng)
    shared = [prose(rng, n).split() for n in (49, 50, 51, 60, 67, 68, 90, 400)]
    for k in range(160):
        words = prose(rng, rng.randint(0, 120)).split()
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, max(0, len(s) - 48))
            words += s[a : a + rng.randint(30, 120)] if rng.random() < 0.7 else s
            words += prose(rng, rng.randint(0, 30)).split()
        texts.append(" ".join(words))
    return texts + texts[20:24] * 3 + ["again and " * 90, "again and " * 70]


@pytest.mark.parametrize("n_partitions", [1, 7])
def test_spans_match_brute_force(spark, n_partitions):
    texts = corpus(random.Random(60))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n_partitions))
    try:
        got = suffixes.repeats(frame(spark, texts, extra=True).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    spans = {(r["doc_id"], r["start"], r["end"]) for r in got}
    assert len(got) > 100 and spans == brute(texts, 50) and len(got) == len(spans)


def test_few_held_at_once(spark, monkeypatch):
    texts = corpus(random.Random(61))
    monkeypatch.setattr(suffixes, "MANY", 1)
    rows = suffixes.repeats(frame(spark, texts)).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in rows} == brute(texts, 50)


def test_null_and_repeated_ids_and_empty(spark):
    same = prose(random.Random(62), 70)
    rows = suffixes.repeats(frame(spark, [(None, same), (5, same), (5, same), (6, None), (7, " ".join(same.split()[:49]))])).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["end"]) for r in rows) == [("5", 0, 70), ("5", 0, 70), ("None", 0, 70)]
    assert suffixes.repeats(frame(spark, [])).count() == 0


def test_a_hot_prefix_is_held_in_parts(spark, monkeypatch):
    """Many rows with one passage, each in other surroundings: its suffixes are one group, larger than a task holds."""
    rng = random.Random(63)
    shared = prose(rng, 55)
    texts = [" ".join([prose(rng, 30), shared, prose(rng, 30)]) for _ in range(60)] + [prose(rng, 25) + " " + shared] * 5
    monkeypatch.setattr(suffixes, "MANY", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = suffixes.repeats(frame(spark, texts)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["doc_id"], r["start"], r["end"]) for r in got} == brute(texts, 50)
