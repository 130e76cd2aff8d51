"""Samples, splits and quotas. Draws go by hashes of ids, so they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(df: DataFrame, column: str, share: float, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    n = F.row_number().over(w.orderBy(column, "_id"))
    return df.withColumn("split", F.when(n <= F.floor(F.count("*").over(w) * share), "train").otherwise("val"))


def split_videos(frames: DataFrame, key: str, share: float = 0.85, seed: int = 42) -> DataFrame:
    """(key, split): videos in the order of a hash; the first share of them trains. Only ids are ranked, one row a video."""
    ids = frames.select(key).distinct().withColumns({"_h": F.md5(F.concat_ws(":", key, F.lit(seed))), "_id": F.col(key)})
    return _share(ids, "_h", share).select(key, "split")


def split_frames(frames: DataFrame, key: str, order: str, share: float = 0.85, seed: int = 42) -> DataFrame:
    """(key, order, split): frames of each video in the order of a hash; the first share of them trains."""
    ids = frames.select(key, order, F.md5(F.concat_ws(":", key, order, F.lit(seed))).alias("_h"), F.col(order).alias("_id"))
    return _share(ids, "_h", share, key).select(key, order, "split")


def proportional(videos: DataFrame, key: str, size: str, target: int, slack: int = 5) -> DataFrame:
    """(key, n): target shared out by size, at least 1 each (halves to even), then one after another given to the largest, or taken from the smallest that
    has more than one, until the sum is within slack. What is given all goes to the one that is largest, the first of equals; what is taken goes by ranks."""
    total = videos.agg(F.sum(size).alias("_total"))
    n = videos.crossJoin(F.broadcast(total)).select(key, F.greatest(F.lit(1), F.bround(F.col(size) / F.col("_total") * target).cast("int")).alias("n"))  # one row
    s = n.agg(F.sum("n").alias("_sum"), F.max(F.struct("n")).alias("_top"))
    first = Window.orderBy(F.desc("n"), key)
    least = Window.orderBy((F.col("n") <= 1), "n", key).rowsBetween(Window.unboundedPreceding, -1)
    df = n.crossJoin(F.broadcast(s))
    give, take = F.greatest(F.lit(0), target - slack - F.col("_sum")), F.greatest(F.lit(0), F.col("_sum") - target - slack)
    before = F.coalesce(F.sum(F.col("n") - 1).over(least), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("n") - 1, take - before))
    return df.select(key, (F.col("n") + F.when(F.row_number().over(first) == 1, give).otherwise(0) - taken).cast("long").alias("n"))


def category_quotas(videos: DataFrame, category: str, per_video: dict[str, int], target: int) -> DataFrame:
    """(category, n): frames of each category of per_video, those of its videos scaled to about target in all, at least 5, also where it has no videos."""
    each = videos.sparkSession.createDataFrame(list(per_video.items()), f"{category} string, _each int")
    counts = videos.groupBy(category).agg(F.count("*").alias("_v"))
    n = each.join(counts, category, "left").withColumn("v", F.coalesce("_v", F.lit(0)) * F.col("_each"))
    whole = n.agg(F.sum("v").alias("_all"))
    scaled = F.when(F.col("_all") > 0, F.col("v") * (F.lit(float(target)) / F.col("_all"))).otherwise(0.0)
    return n.crossJoin(F.broadcast(whole)).select(category, F.greatest(F.lit(5), scaled.cast("int")).cast("long").alias("n"))  # one row


def every(df: DataFrame, order: str, stride: int) -> DataFrame:
    return df.where(F.pmod(F.col(order), F.lit(stride)) == 0)


def inner(df: DataFrame, key: str, order: str, margin: int = 5) -> DataFrame:
    """Rows that aren't among the first margin frames of their key nor in its last margin - 1."""
    n = F.max(order).over(Window.partitionBy(key)) + 1
    return df.withColumn("_n", n).where((F.col(order) >= margin) & (F.col(order) <= F.col("_n") - margin)).drop("_n")


def flagged_union(regular: DataFrame, special: DataFrame, on: list[str]) -> DataFrame:
    """The distinct rows of two samples, with tag: empty for the first, _BOTTOM for the second only, _RB for both."""
    both = regular.select(*on, F.lit(1).alias("r"), F.lit(0).alias("b")).unionByName(special.select(*on, F.lit(0).alias("r"), F.lit(1).alias("b")))
    held = both.groupBy(*on).agg(F.max("r").alias("r"), F.max("b").alias("b"))
    return held.select(*on, F.when(F.col("b") == 0, "").when(F.col("r") == 0, "_BOTTOM").otherwise("_RB").alias("tag"))


def quietest(df: DataFrame, key: str, order: str, energy: str, n: int) -> DataFrame:
    """Each key's n rows of the least energy, the first of equals; all where there are no more than twice as many."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("_k", F.row_number().over(w.orderBy(energy, order))).withColumn("_n", F.count("*").over(w))
    return ranked.where((F.col("_n") <= 2 * n) | (F.col("_k") <= n)).drop("_k", "_n")


def low_points(df: DataFrame, key: str, order: str, energy: str, side: int, below: float = 0.6) -> DataFrame:
    """Rows whose energy, over the key's median, is below a share of it and no more than all of side rows before and after; the first of each side rows."""
    from kinetia.operators.folds import thin

    mid = df.groupBy(key).agg(F.median(energy).alias("_m")).where("_m != 0")
    w = Window.partitionBy(key).orderBy(order)
    before, after = w.rowsBetween(-side, -1), w.rowsBetween(1, side)
    e = F.col(energy)
    whole = (F.count("*").over(before) == side) & (F.count("*").over(after) == side)
    low = df.withColumn("_low", whole & (e <= F.min(e).over(before)) & (e <= F.min(e).over(after))).join(mid, key).where(F.col("_low") & (e / F.col("_m") < below))
    return thin(low.select(key, F.col(order).cast("long").alias(order), F.col(order).cast("double").alias("at")), key, order, "at", side - 0.5).select(key, order)


def sweep(base: DataFrame, key: str, values: list[float], count) -> DataFrame:
    """Sensitivity: base (key, n), count(value) the same with a parameter's value. (value, key, n, base, changed), one join for each value."""
    out = None
    for v in values:
        part = count(v).select(key, "n").join(base.select(key, F.col("n").alias("base")), key, "full").select(F.lit(float(v)).alias("value"), key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "base")))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("changed", F.col("n") != F.col("base"))


def size_audit(files: DataFrame, length: str, single_mb: float = 15.0, total_mb: float = 100.0) -> DataFrame:
    mb = F.col(length) / (1024 * 1024)
    return files.agg(F.sum(mb).alias("total_mb"), F.count_if(mb > single_mb).alias("n_over"), (F.sum(mb) > total_mb).alias("over"))


def distribution_audit(index: DataFrame, spec: dict[str, dict], load: str = "load_kg", plate: str = "outer_plate") -> DataFrame:
    """(dimension, n_distinct, n_missing, n_thin, covered) of each column in spec: required values (each at least min_each times) or min_distinct of them; nulls and
    empty strings don't count. One more row, small_plate: light loads must show a plate that isn't of full size. One pass over the index."""
    from kinetia.functions.columns import load_band

    real = lambda c: F.when(c.cast("string") != "", c.cast("string"))
    columns = index.select(*(real(F.col(d) if d in index.columns else load_band(F.col(load))).alias(d) for d in spec), load_band(F.col(load)).alias("_band"), real(F.col(plate)).alias("_plate"))
    sums: list[Column] = [F.countDistinct(d).alias(f"d_{d}") for d in spec]
    sums += [F.count_if(F.col(d) == v).alias(f"n_{d}_{v}") for d, s in spec.items() for v in sorted(s.get("required", ()))]
    light = F.col("_band") == "light"
    sums += [F.count_if(light).alias("light"), F.count_if(light & F.col("_plate").isNotNull() & ~F.col("_plate").isin("20kg", "25kg", "45lb")).alias("small")]
    row = columns.agg(*sums)
    parts = []
    for d, s in spec.items():
        found = [F.col(f"n_{d}_{v}") for v in sorted(s.get("required", ()))]
        count = lambda test: sum((F.when(test(n), 1).otherwise(0) for n in found), F.lit(0)).cast("long")  # noqa: E731, B023
        missing, thin = count(lambda n: n == 0), count(lambda n: n < s.get("min_each", 1)) - count(lambda n: n == 0)  # noqa: B023
        ok = (missing == 0) & (thin == 0) & (F.col(f"d_{d}") >= s.get("min_distinct", 0))
        parts.append(F.struct(F.lit(d).alias("dimension"), F.col(f"d_{d}").alias("n_distinct"), missing.alias("n_missing"), thin.alias("n_thin"), ok.alias("covered")))
    zero = F.lit(0).cast("long")
    parts.append(F.struct(F.lit("small_plate").alias("dimension"), F.col("small").alias("n_distinct"), zero.alias("n_missing"), zero.alias("n_thin"), ((F.col("light") == 0) | (F.col("small") > 0)).alias("covered")))
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
