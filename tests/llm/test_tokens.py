import random
import re

import numpy as np
import pyarrow as pa

from kinetia.llm import tokens as t
from tests.llm.helpers import awkward, prose


def test_words_match_split():
    rng = random.Random(12)
    texts = awkward(rng) + ["end", "begin", "", "é x\x1cy"] + [prose(rng, 50) for _ in range(20)]
    table = pa.table({"text": pa.array(texts)}).to_batches()
    seen, at = {}, 0
    for b, data, bounds in t.chunks(iter(table), most=700):
        w = t.words(data, bounds)
        for k in range(len(b)):
            want = [x for x in re.split(rb"[\x20\x09-\x0D]+", (texts[at + k] or "").encode()) if x]
            span = range(w.first[k], w.first[k + 1])
            assert [data[w.starts[j] : w.ends[j]].tobytes() for j in span] == want
            assert all(w.doc[j] == k for j in span)
            for j, x in zip(span, want):
                assert seen.setdefault(x.lower(), w.hash[j]) == w.hash[j]
        at += len(b)
    assert at == len(texts) and len(set(seen.values())) == len(seen)


def test_grams():
    h = t.hashes("a b c a b c d")
    g = t.grams(h, 3)
    assert g[0] == g[3] and g[1] != g[4] and len(np.unique(g)) == 6
