import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
from tokenizers import Tokenizer

from kinetia.llm import packing as p
from tests.llm.helpers import awkward, frame, prose


def tokens(text):
    t = Tokenizer.from_file(p.Params().path())
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def test_fullest_is_optimal():
    rng = random.Random(6)
    for _ in range(60):
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 30), 5)}
        room = rng.randint(1, 60)
        best = max(s for ks in product(*(range(c + 1) for c in counts.values())) if (s := sum(k * n for k, n in zip(ks, counts))) <= room)
        used = p.fullest(counts, room)
        assert sum(n * k for n, k in used.items()) == best and all(k <= counts[n] for n, k in used.items())


def test_patterns_use_every_piece_once():
    rng = random.Random(7)
    counts = Counter(rng.randint(1, 2047) for _ in range(3000))
    counts[700] += 1500
    found = p.patterns(dict(counts), 2048)
    total = Counter()
    for times, used, cut in found:
        assert sum(n * k for n, k in used.items()) + (cut[1] if cut else 0) <= 2048
        for n, k in used.items():
            total[n] += times * k
        if cut:
            total[cut[0]] += times
            total[cut[0] - cut[1]] -= times
    assert +total == counts
    padding = sum(t for t, *_ in found) * 2048 - sum(n * c for n, c in counts.items())
    assert padding < 0.02 * sum(n * c for n, c in counts.items())


def test_pack_round_trip(spark):
    rng = random.Random(8)
    texts = awkward(rng) + ["A<|endoftext|>b's <|ENDOFTEXT|>", "Don't stop!!! it's x's. 'S", "Ééà, naïve... ß!! İx 12,5 a,'s", "z" * 30000, "é, à.  x y, z"] + [prose(rng, rng.randint(1, 900)) + "." for _ in range(40)]
    out = p.pack(frame(spark, texts, extra=True)).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(range(len(texts)))
    for k, t in enumerate(texts):
        ids, at = tokens(t), 0
        for r in sorted(by[k], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part), t
            at += r["length"]
        assert at == len(ids)
    windows = {}
    for r in out:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(windows) == list(range(len(windows)))
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        assert at <= 2048


def test_crc_of_rest():
    rng = np.random.default_rng(9)
    raw = rng.integers(0, 256, 4 * 900, dtype=np.uint8).tobytes()
    for n in (0, 1, 63, 500, 900):
        got = p.crc_of_rest(np.array([zlib.crc32(raw)]), np.array([zlib.crc32(raw[: len(raw) - 4 * n])]), np.array([n]))
        assert got[0] == zlib.crc32(raw[len(raw) - 4 * n :])


def test_lengths_that_leave_room_are_cut(spark):
    texts = ["one two three four five six seven " * 100 + f"w{k}" for k in range(90)]
    out = p.pack(frame(spark, texts)).collect()
    windows = 1 + max(r["sequence_id"] for r in out)
    assert sum(r["length"] for r in out) > 0.93 * 2048 * (windows - 1) and len(out) > 90
    for k, t in enumerate(texts):
        ids, at = tokens(t), 0
        for r in sorted((r for r in out if r["doc_id"] == k), key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_empty_and_repeated(spark):
    assert p.pack(frame(spark, [])).count() == 0
    rows = [(1, "same words here")] * 50 + [(None, None)]
    out = p.pack(frame(spark, rows)).collect()
    assert len(out) == 51 and len({(r["sequence_id"], r["offset"]) for r in out}) == 51


def test_ids_keep_their_types_beside_null(spark):
    big = 2**60 + 1
    out = p.pack(frame(spark, [(None, "a b"), (big, "a c"), (big + 1, "words " * 3000)])).collect()
    assert {r["doc_id"] for r in out} == {None, big, big + 1}
    named = spark.createDataFrame([("x1", "a b"), (None, "a c"), ("", "d")], "doc_id string, text string")
    assert {r["doc_id"] for r in p.pack(named).collect()} == {"x1", None, ""}
