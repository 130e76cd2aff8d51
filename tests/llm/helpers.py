"""Small corpora with the awkward rows that every operator must stand."""

import random

from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng: random.Random, n: int) -> str:
    syllables = ["th", "er", "on", "an", "re", "ing", "ea", "st", "ly", "be"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def frame(spark, texts, extra=False):
    """texts: of rows 0, 1, ... or (doc_id, text) pairs."""
    pairs = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], DOC)
    if extra:
        from pyspark.sql import functions as F

        for name in ("n_words", "score", "row", "key", "h", "hash", "text_lower", "length", "component_id", "spans", "label", "value", "start", "_row", "_key", "place", "fp"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def awkward(rng: random.Random) -> list:
    same = prose(rng, 80)
    return [None, "", "   \n\t ", "word", "a b", same, same, "é " * 40, "x" * 5000, "ok " * 300, prose(rng, 4000), "# $ % & | < >", "line one is here\nline one is here\n\n \nline two", "a\x0bb\x0cc\rd e"]
