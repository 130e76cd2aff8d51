import hashlib
import random
import re
import zlib

import pytest

from kinetia.llm import periodic_runs as r
from tests.llm.helpers import awkward, frame


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[: len(w) - q])


def brute_runs(w, least=12):
    """For each period the maximal stretches that keep it, of which those count whose smallest period it is."""
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e - s + q >= max(least, 2 * q) and smallest_period(w[s : e + q]) == q:
                out.append((s, e - s + q, q))
            s = max(e, s) + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def brute_digest(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts():
    rng = random.Random(13)
    out = awkward(rng)[:-5] + ["a\x0bb\x0cc\rd e", "ok " * 300, "é è " * 40]
    for k in range(120):
        w = [rng.choice("ab" if k % 3 else "abcd") for _ in range(rng.randint(0, 90))]
        out.append(" ".join(w))
    for k in range(40):
        part = [rng.choice("abcdef") for _ in range(rng.randint(1, 9))]
        out.append(" ".join([rng.choice("xyz") for _ in range(rng.randint(0, 9))] + part * rng.randint(2, 9) + part[: rng.randint(0, len(part))] + ["end", *part, *part]))
    fib = ["a", "ab"]
    for _ in range(7):
        fib.append(fib[-1] + fib[-2])
    return out + [" ".join(fib[-1]), " ".join(bin(k).count("1") % 2 and "x" or "y" for k in range(128))]


@pytest.mark.parametrize("base", [r.BASES[0], r.BASES[2]])
def test_runs_equal_brute_force(base):
    for t in texts():
        w = (t or "").split()[:400]
        known: dict = {}
        values = [known.setdefault(x, len(known) + 1) for x in w] + [-1]
        for least in (2, 12):
            assert [tuple(x) for x in r.all_runs(values, least, (base,)).tolist()] == brute_runs(w, least), t


def test_bad_hashes_are_noticed():
    values = [1, 2, 3, 4, 5] * 12 + [9, 7, 8] * 9 + [-1]
    assert len(r.all_runs(values)) == 2
    with pytest.raises(RuntimeError):
        r.all_runs([1] * 20 + [r.PRIME + 1] + [1] * 20 + [2] + [-1], 12, (1,))  # all numbers but the last two look alike


def test_long_periodic_text_is_fast():
    import time

    rng = random.Random(1)
    part = [rng.randrange(1, 500) for _ in range(700)]
    t = time.time()
    assert r.all_runs(part * 60 + [501] + [3] * 30000 + [-1]).tolist() == [[0, 42000, 700], [42001, 30000, 1]]
    assert time.time() - t < 20


def test_digest_equals_brute_force(spark):
    rows = [(k * 7 + 1, t) for k, t in enumerate(texts()) if len((t or "").split()) < 2000]
    rows += [(None, "a b " * 20), (rows[5][0], rows[5][1])] + [(5_000_000 + k, " ".join(random.Random(k).choice("pqrstu") for _ in range(50))) for k in range(100)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 15
    got = sorted((tuple(x) for x in r.digest(frame(spark, rows, extra=True)).collect()), key=str)
    assert got == sorted(((i, *brute_digest(i, t)) for i, t in rows), key=str)
    small = r.digest(frame(spark, rows), r.Params(chunk=300)).collect()
    assert sorted(map(tuple, small), key=str) == got


def test_runs_and_collapsed_texts(spark):
    df = frame(spark, [(1, "x " + "a b c " * 5 + "y"), (2, "no runs here"), (None, None), (3, "")], extra=True)
    assert [tuple(x) for x in r.runs(df).collect()] == [(1, 1, 15, 3)]
    out = r.collapse(df)
    assert out.columns == df.columns
    assert {x["doc_id"]: x["text"] for x in out.collect()} == {1: "x a b c y", 2: "no runs here", None: None, 3: ""}
    assert r.digest(df.limit(0)).count() == r.runs(df.limit(0)).count() == r.collapse(df.limit(0)).count() == 0


def test_ids_of_other_types_are_kept(spark):
    df = spark.createDataFrame([("k7", "a b " * 9), (None, "a b " * 9), ("", "")], "doc_id string, text string")
    out = {x["doc_id"]: x["n_runs"] for x in r.digest(df, planted=False).collect()}
    assert out == {"k7": 1, None: 1, "": 0} and r.runs(df).schema["doc_id"].dataType.simpleString() == "string"
    assert r.digest(df).count() == 3
