import random

import corpus_pipeline as c
from tests.llm.helpers import awkward, frame, prose
from tests.llm.test_packing import tokens
from tests.llm.test_pii import brute as brute_pii
from tests.llm.test_quality_rules import brute as brute_quality
from tests.llm.test_simhash import brute_groups, brute_print


def made(spark, path):
    rng = random.Random(30)
    texts = awkward(rng)
    for k in range(160):
        words = prose(rng, rng.randint(60, 200)).split()
        texts.append(" | ".join(words) if k % 8 == 0 else " ".join(words) + (f" mail a{k}@example.org now" if k % 5 == 0 else ""))
    texts += [texts[20], texts[21], texts[20] + " end"]
    items = [(k, prose(rng, 40)) for k in range(10)]
    for _, t in items:
        texts.append(prose(rng, 60) + " " + t + " " + prose(rng, 60))
    frame(spark, texts).write.parquet(f"{path}/documents.parquet")
    marks = [(k, 0 if "|" in (t or "") else 1, 0) for k, t in enumerate(texts) if t]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return texts, items


def test_stages_match_brute_force(spark, tmp_path):
    texts, items = made(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, dict(enumerate(texts))
    left = {k: t for k, t in left.items() if not brute_quality(t)[-1] and "|" not in t}
    for n, (name, stage) in enumerate(c.STAGES[:4]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        if n == 1:
            ids = sorted(left)
            groups = brute_groups([brute_print(left[k]) for k in ids])
            left = {k: left[k] for k in {ids[g] for g in groups}}
        if n == 2:
            left = {k: t for k, t in left.items() if not any(i in t for _, i in items)}
        if n == 3:
            for k, t in left.items():
                for kind, s, e in reversed(brute_pii(t)):
                    t = t[:s] + f"[{kind.upper()}]" + t[e:]
                left[k] = t
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == left, name
        docs.write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
    sizes = {}
    for r in c.run(spark, str(tmp_path)).collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {k: len(tokens(t)) for k, t in left.items()}


def test_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
