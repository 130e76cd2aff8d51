"""Joins and pairings. Interval and as-of joins are equi-joins or windows, never products of a key's rows."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetia.operators.folds import fold


def numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def pair_truncate(truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """(key, pos, gt, pred): the k-th truth with the k-th prediction, as far as both go."""
    return truth.select(key, "pos", "gt").join(pred.select(key, "pos", "pred"), [key, "pos"])


def pair_equal_count(truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """As pair_truncate, for keys with as many predictions as truths."""
    n = truth.groupBy(key).agg(F.count("*").alias("n")).join(pred.groupBy(key).agg(F.count("*").alias("n")), [key, "n"]).select(key)
    return pair_truncate(truth.join(n, key, "left_semi"), pred, key)


def pair_greedy(truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Each truth, in order, takes the nearest prediction that is left, the first of equals. A fold that holds a key's free predictions, sorted: a
    truth costs a bisection, not a scan."""
    both = truth.select(key, "pos", F.col("gt").alias("x"), F.lit(True).alias("is_gt")).unionByName(pred.select(key, "pos", F.col("pred").alias("x"), F.lit(False).alias("is_gt")))

    def start():
        free = []

        def step(is_gt, pos, x):
            if not is_gt:
                insort(free, (x, pos))
            elif free:
                k = bisect_left(free, (x, -1))
                near = [k] if k < len(free) else []
                if k:
                    near.append(bisect_left(free, (free[k - 1][0], -1)))  # of equal values the first prediction
                at = min(near, key=lambda i: (abs(free[i][0] - x), free[i][1]))
                return [(pos, x, free.pop(at)[0])]
            return []

        return step

    return fold(both, key, ["is_gt", "pos"], ["is_gt", "pos", "x"], "pos int, gt double, pred double", start)


def outside(points: DataFrame, intervals: DataFrame, key: str, at: str, bucket: int = 256) -> DataFrame:
    """Points in no inclusive [start, end] of their key. Intervals are cut at buckets, so a point meets those of its bucket only."""
    cut = intervals.select(key, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("_b"))
    p, i = points.withColumn("_b", F.floor(F.col(at) / bucket)).alias("p"), cut.alias("i")
    on = (F.col(f"p.{key}") == F.col(f"i.{key}")) & (F.col("p._b") == F.col("i._b")) & F.col(f"p.{at}").between(F.col("i.start"), F.col("i.end"))
    return p.join(i, on, "left_anti").drop("_b")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, after: float = 0.0, forward: bool = True) -> DataFrame:
    """left with ``found``: the first time of right beyond at + after, strictly (forward), or the last one at or before it. One window over both, no range join."""
    both = left.withColumn("_t", F.col(at) + after).withColumn("_right", F.lit(False)).unionByName(right.select(key, F.col(at).alias("_t")).withColumn("_right", F.lit(True)), allowMissingColumns=True)
    # of equal times right's rows come first: not beyond, but at. Forward is backward in the reverse order, whose frames grow with the rows
    w = Window.partitionBy(key).orderBy(F.desc("_t"), F.col("_right")) if forward else Window.partitionBy(key).orderBy("_t", F.desc("_right"))
    found = F.last(F.when(F.col("_right"), F.col("_t")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("found", found).where("not _right").drop("_t", "_right")


def far_from(left: DataFrame, right: DataFrame, key: str, at: str, reach: float) -> DataFrame:
    """Rows of left with no row of right of their key within reach of their time."""
    near = asof(asof(left, right, key, at, 0.0, False).withColumnRenamed("found", "_last"), right, key, at, 0.0, True).withColumnRenamed("found", "_next")
    ok = lambda c: F.col(c).isNull() | (F.abs(F.col(c) - F.col(at)) > reach)
    return near.where(ok("_last") & ok("_next")).drop("_last", "_next")


def differences(sets: dict[str, DataFrame], column: str) -> DataFrame:
    """Which of several sets of ids lack which ids: one pass over their union."""
    names = list(sets)
    union = None
    for n in names:
        part = sets[n].select(F.col(column), F.lit(n).alias("_set"))
        union = part if union is None else union.unionByName(part)
    held = union.groupBy(column).agg(*(F.max(F.when(F.col("_set") == n, 1).otherwise(0)).alias(f"in_{n}") for n in names))
    return held.where(" or ".join(f"in_{n} = 0" for n in names))


def suppress(boxes: DataFrame, key: str, limit: float) -> DataFrame:
    """Non-maximum suppression of a frame's boxes: by confidence, then pos; a box goes if a kept one overlaps it by more than limit. Boxes without a confidence come
    last. A fold over the frame's few boxes."""
    from kinetia.functions.columns import corners, iou

    box = F.struct(F.coalesce(-F.col("conf"), F.lit(float("inf"))).alias("o"), "pos", "cx", "cy", "w", "h", "conf")
    grouped = boxes.groupBy(key).agg(F.array_sort(F.collect_list(box)).alias("all"))

    def overlap(a, b):
        return iou(*(corners(x["cx"], x["cy"], x["w"], x["h"]) for x in (a, b))) > limit

    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda a: overlap(a, b)), acc).otherwise(F.concat(acc, F.array(b))))
    return grouped.select(key, F.explode(kept).alias("b")).select(key, "b.pos", "b.cx", "b.cy", "b.w", "b.h", "b.conf")


def nearest(boxes: DataFrame, key: str, x: float, y: float, reach: float) -> DataFrame:
    """Each key's box nearest to a point within reach, the last of equals. Pre-aggregated."""
    dx, dy = F.col("cx") - x, F.col("cy") - y
    d = dx * dx + dy * dy
    return boxes.where(d <= reach * reach).groupBy(key).agg(F.min_by(F.struct("pos", "cx", "cy"), F.struct(d, -F.col("pos"))).alias("b")).select(key, "b.*")


def largest(boxes: DataFrame, key: str) -> DataFrame:
    """Each key's box of the largest area, the first of equals. Pre-aggregated."""
    return boxes.groupBy(key).agg(F.max_by(F.struct("pos", "w", "h"), F.struct(F.col("w") * F.col("h"), -F.col("pos"))).alias("b")).select(key, "b.*")


def quota(df: DataFrame, key: str, category: str, order: list[str], quotas: dict[str, int]) -> DataFrame:
    """The first rows of each category of a key, as many as its quota says."""
    most = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    n = F.row_number().over(Window.partitionBy(key, category).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= F.coalesce(F.try_element_at(most, F.col(category)), F.lit(0))).drop("_n")


def top(boxes: DataFrame, key: str, k: int, by: str = "conf") -> DataFrame:
    """Each key's k boxes with the largest by, numbered from 1; of equals the first."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), "pos"))
    return boxes.withColumn("n", n).where(F.col("n") <= k)


def clear_of(spans: DataFrame, others: DataFrame, key: str, bucket: int = 256) -> DataFrame:
    """Spans (key, start, end, inclusive) that overlap none of the others. Both are cut at buckets, so a span meets those of its buckets only."""
    cut = lambda df: df.select(key, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("_b"))
    a, b = cut(spans).alias("a"), cut(others).alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._b") == F.col("b._b")) & (F.col("a.start") <= F.col("b.end")) & (F.col("a.end") >= F.col("b.start"))
    return spans.join(a.join(b, on, "left_semi").select(key, "start", "end").distinct(), [key, "start", "end"], "left_anti")


def expand(spans: DataFrame, key: str, last: DataFrame | None = None) -> DataFrame:
    """(key, idx): the distinct rows of overlapping inclusive spans, none below 0 and, with last (key, last), none beyond it."""
    df = spans if last is None else spans.join(last, key).withColumn("end", F.least("end", "last"))
    df = df.withColumn("start", F.greatest(F.col("start"), F.lit(0))).where("start <= end")
    return df.select(key, F.explode(F.sequence("start", "end")).alias("idx")).distinct()


def near_prediction(boxes: DataFrame, key: str, x: str, y: str, speed: str, missed: str, reach: float = 150.0, k: int = 2) -> DataFrame:
    """The k boxes of each key nearest to where a track must be: (x, y + speed for each missed frame and this one), nearer than reach."""
    dx, dy = F.col("cx") - F.col(x), F.col("cy") - (F.col(y) + F.col(speed) * (F.col(missed) + 1))
    df = boxes.withColumn("dist", F.sqrt(dx * dx + dy * dy)).where(F.col("dist") < reach)
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("dist", "pos"))).where(F.col("n") <= k)
