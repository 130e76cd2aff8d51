"""Ordered operators as windows: runs, fills, gradients, look-ahead. Each takes the key columns and the order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def runs(df: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """Maximal runs of consecutive rows where flag holds: key, start, end (of an integer order without gaps), n."""
    place = F.col(order) - F.row_number().over(by(key, order))
    return df.where(flag).withColumn("_run", place).groupBy(key, "_run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("_run")


def longest_run(df: DataFrame, key: str, order: str, flag: Column, longer_than: int) -> DataFrame:
    """The longest run of more than so many rows, the earliest of equals. One pre-aggregated max_by, no ranking of runs."""
    found = runs(df, key, order, flag).where(F.col("n") > longer_than)
    return found.groupBy(key).agg(F.max_by(F.struct("start", "end", "n"), F.struct("n", -F.col("start"))).alias("r")).select(key, "r.*")


def neighbours(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """prev_at, prev, next_at, next: the nearest rows before and after, the row itself included, that have a value."""
    # the next row is the last one of the reverse order: frames that end at the current row are grown, not recomputed for each row
    back, ahead = (Window.partitionBy(key).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(order), F.desc(order)))
    held = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("v")))
    df = df.withColumn("_b", F.last(held, True).over(back)).withColumn("_a", F.last(held, True).over(ahead))
    return df.select("*", F.col("_b.at").alias("prev_at"), F.col("_b.v").alias("prev"), F.col("_a.at").alias("next_at"), F.col("_a.v").alias("next")).drop("_b", "_a")


def interpolate(df: DataFrame, key: str, order: str, value: str, max_gap: int | None = None, hold_edges: bool = True) -> DataFrame:
    """value_filled: gaps (of at most max_gap rows) filled on the line between their neighbours, edges held."""
    n = neighbours(df, key, order, value)
    line = F.col("prev") + (F.col("next") - F.col("prev")) * (F.col(order) - F.col("prev_at")) / (F.col("next_at") - F.col("prev_at"))
    inner = F.when(F.col("prev").isNotNull() & F.col("next").isNotNull() & (F.lit(True) if max_gap is None else F.col("next_at") - F.col("prev_at") - 1 <= max_gap), line)
    filled = F.coalesce(F.col(value), inner, *([F.coalesce("prev", "next")] if hold_edges and max_gap is None else []))
    return n.withColumn(f"{value}_filled", filled).drop("prev_at", "prev", "next_at", "next")


def gradient(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Central differences, one-sided at the ends; unit steps."""
    w = by(key, order)
    v, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn("gradient", F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2))


def median3(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Medians of three rows; the ends take their own value twice."""
    w = by(key, order)
    a, b, c = F.coalesce(F.lag(value).over(w), F.col(value)), F.col(value), F.coalesce(F.lead(value).over(w), F.col(value))
    return df.withColumn("median3", F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)))


def smooth(df: DataFrame, key: str, order: str, value: str, weights: list[float], name: str = "smooth") -> DataFrame:
    """A centred filter with constant weights (Savitzky-Golay's, inside); null where it doesn't fit."""
    w, half = by(key, order), len(weights) // 2
    total = sum((F.lit(x) * (F.lag(value, half - k) if k < half else F.lead(value, k - half) if k > half else F.lag(value, 0)).over(w) for k, x in enumerate(weights)), F.lit(0.0))
    return df.withColumn(name, total)


def sustained(df: DataFrame, key: str, order: str, value: str, frames: int, band: float) -> DataFrame:
    """rises, falls: the next rows, all of so many, are above the band, or below minus the band."""
    w = by(key, order).rowsBetween(1, frames)
    whole = F.count(value).over(w) == frames
    return df.withColumn("rises", whole & (F.min(value).over(w) > band)).withColumn("falls", whole & (F.max(value).over(w) < -band))


def jumps(df: DataFrame, key: str, order: str, position: str, size: str, valid: Column, far: float = 0.5, change: float = 0.3) -> DataFrame:
    """jump: POS, SCALE or POS+SCALE against the row just before, null where either isn't valid, nothing jumps or that row has no size. A jump is more than far sizes of
    the row before, or a change by more than that share of it; both are quotients compared with the threshold, so ties fall as in the reference and SQL."""
    w = by(key, order)
    ok = valid & F.coalesce(F.lag(valid).over(w), F.lit(False))
    last = F.when(F.lag(size).over(w) > 0, F.lag(size).over(w))  # no size: quotients are null, under ANSI division too
    ok = ok & last.isNotNull()
    pos = ok & (F.abs(F.col(position) - F.lag(position).over(w)) / last > far)
    scale = ok & (F.abs(F.col(size) - last) / last > change)
    return df.withColumn("jump", F.when(pos & scale, "POS+SCALE").when(pos, "POS").when(scale, "SCALE"))


def single_linkage(df: DataFrame, key: str, value: str, gap: float, *ties: str) -> DataFrame:
    """cluster: numbers of one-dimensional clusters; a new one begins where the next value is more than gap away."""
    w = Window.partitionBy(key).orderBy(value, *ties)
    fresh = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn("cluster", F.sum("_fresh").over(w)).drop("_fresh")


def transitions(df: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Rows whose state isn't the one before."""
    return df.withColumn("was", F.lag(state).over(by(key, order))).where(F.col("was").isNotNull() & (F.col(state) != F.col("was")))


def event_pairs(events: DataFrame, key: str, order: str, kind: str, first: str, second: str) -> DataFrame:
    """Rows of the first kind that one of the second follows directly: key, start, end, with both values."""
    w = Window.partitionBy(key).orderBy(order, kind)
    follows = events.where(F.col(kind).isin(first, second)).withColumn("_next", F.lead(F.struct(kind, order, "value")).over(w))
    return follows.where((F.col(kind) == first) & (F.col(f"_next.{kind}") == second)).select(key, F.col(order).alias("start"), F.col(f"_next.{order}").alias("end"), F.col("value").alias("from_value"), F.col("_next.value").alias("to_value"))


def relative_gate(df: DataFrame, key: str, value: str, share: float, least: float) -> DataFrame:
    """Rows of at least least, and at least a share of the key's largest."""
    most = df.groupBy(key).agg(F.max(value).alias("_most"))
    return df.join(most, key).where(F.col(value) >= F.greatest(F.lit(least), share * F.col("_most"))).drop("_most")


def hold_bridge(df: DataFrame, key: str, order: str, value: str, most: int = 40) -> DataFrame:
    """held: the value, or the last one before for up to so many missing rows, null beyond."""
    n = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("v"))), True).over(n)
    return df.withColumn("_l", last).withColumn("held", F.when(F.col(order) - F.col("_l.at") <= most, F.col("_l.v"))).drop("_l")


def trim_ends(points: DataFrame, reps: DataFrame, key: str, order: str, start: bool = True, end: bool = True) -> DataFrame:
    """reps (key, start, end) with ends moved inwards past rows whose v isn't above 0; a repetition without such a row is left with one row.
    An equi-join of repetitions and points on buckets of the order."""
    size = 256
    cut = reps.select(key, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))).alias("_b"))
    p = points.select(key, F.col(order).alias("_i"), "v", F.floor(F.col(order) / size).alias("_b"))
    inside = cut.join(p, [key, "_b"]).where(F.col("_i").between(F.col("start"), F.col("end")))
    up = F.when(F.col("v") > 0, F.col("_i"))
    found = inside.groupBy(key, "start", "end").agg(F.min(up).alias("_a"), F.max(up).alias("_z"))
    new_end = F.coalesce("_z", F.col("start")) if end else F.col("end")
    new_start = F.least(F.coalesce("_a", new_end), new_end) if start else F.col("start")
    return found.select(key, "start", "end", new_start.alias("new_start"), new_end.alias("new_end"))


def valleys(df: DataFrame, key: str, order: str, value: str, side: int = 8, reach: int = 60, depth: float = 0.12, apart: int = 20) -> DataFrame:
    """(key, order, depth): least values of side rows either way, as deep as the lower of the highest values up to reach rows before and after, the row
    included; of nearer ones than apart the deeper stays."""
    from kinetia.operators.folds import merge_peaks

    w = by(key, order)
    v = F.col(value)
    around = F.min(v).over(w.rowsBetween(-side, side))
    full = (F.count("*").over(w.rowsBetween(-side, 0)) == side + 1) & (F.count("*").over(w.rowsBetween(0, side)) == side + 1)
    deep = F.least(F.max(v).over(w.rowsBetween(-reach, 0)), F.max(v).over(w.rowsBetween(0, reach - 1))) - v
    found = df.select(key, F.col(order).cast("long").alias(order), (full & (v <= around + 1e-9)).alias("_low"), deep.alias("depth")).where(F.col("_low") & (F.col("depth") > depth))
    return merge_peaks(found.drop("_low"), key, order, "depth", apart + 1)


def moving_signal(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, signal): the column of the largest peak-to-peak range, the first of equals."""
    ranges = [F.struct((F.coalesce(F.max(c) - F.min(c), F.lit(0.0))).alias("r"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(columns)]
    return df.groupBy(key).agg(F.array_max(F.array(*ranges)).alias("b")).select(key, F.col("b.c").alias("signal"), F.col("b.r").alias("span"))


def motion_scores(df: DataFrame, key: str, order: str, array: str, stride: int = 15) -> DataFrame:
    """motion: the mean absolute difference of each row's numbers from those of the row before, of every stride-th row of a key (the first one, which has none before it, aside).
    Arrays of unequal length compare what both have; an empty or null one gives null."""
    w = by(key, order)
    held = df.withColumn("_before", F.lag(array).over(w)).withColumn("_i", F.row_number().over(w) - 1).where((F.col("_i") > 0) & (F.col("_i") % stride == 0))
    n = F.least(F.size(array), F.size("_before"))
    pairs = F.zip_with(F.slice(array, F.lit(1), n), F.slice("_before", F.lit(1), n), lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)
    return held.withColumn("motion", F.when(n > 0, total / n)).drop("_before", "_i")
