"""Whole trackers as folds over a video's frames: a gated filter, a filter fed by displacements, and clusters that watch for a lost target.

Each holds one video's state and the boxes of one frame. Frames without boxes must be rows with null boxes.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetia.operators.folds import Motion, fold, median, missing
from kinetia.operators.tracks import by_frame


def gated_filter(boxes: DataFrame, key: str, frame: str, anchors: DataFrame | None = None, fps: float = 30.0, least_conf: float = 0.30, least: int = 3, window: int = 30, every: int = 15, near: float = 60.0, reach: float = 120.0, gate: float = 0.6, diameter: float = 0.45) -> DataFrame:
    """(key, frame, src, y, v, mpp, size) of a target in boxes (key, frame, pos, cx, cy, w, h, conf). Frames are numbered from 1.

    It is anchored at its row of anchors (key, frame, cx, cy, h), or else at the first frame with a trusted box, at the surest one. While it rests, the
    nearest trusted box of each frame gives place and size; after window frames, with enough sizes, their median locks the scale and a filter of constant
    acceleration with fixed steps begins. It is predicted each frame and corrected at each every-th one by the nearest trusted box within reach, unless that is further
    than gate sizes from the prediction (yolo_jump_reject); sizes are averaged 7 to 3. y is in pixels, down; v is up, in pixels a second.
    Frames before the anchor have src none. State: one target's; sizes are held until the scale is locked. Of equally near or sure boxes the first counts."""
    rows, given = by_frame(boxes, key, frame), anchors is not None
    if given:
        a = anchors.select(key, F.col(frame).alias("_at"), F.struct("cx", "cy", "h").alias("_anchor"))
        rows = rows.join(a, (rows[key] == a[key]) & (rows[frame] == a["_at"]), "left").select(rows[key], rows[frame], "boxes", "_anchor")
    else:
        rows = rows.withColumn("_anchor", F.lit(None).cast("struct<cx: double, cy: double, h: double>"))

    def start():
        x = y = size = mpp = filter_ = first = None
        sizes: list[float] = []

        def nearest(found, most):
            near_ = min(((math.hypot(b["cx"] - x, b["cy"] - y), k) for k, b in enumerate(found)), default=(most, -1))
            return found[near_[1]] if near_[0] < most else None

        def step(n, boxes_, anchor):
            nonlocal x, y, size, mpp, filter_, first, sizes
            every_box = list(boxes_) if boxes_ is not None else []
            found = [b for b in every_box if not missing(b["conf"]) and b["conf"] >= least_conf]
            if first is None:
                best = anchor if given else max(found, key=lambda b: b["conf"], default=None)
                if best is None:
                    return [(n, "none", None, None, None, None)]
                x, y, size, first = best["cx"], best["cy"], best["h"], n
                sizes = [size]
                return [(n, "anchor", y, 0.0, None, size)]
            if filter_ is None:
                if (b := nearest(found, near)) is not None:
                    x, y, size = b["cx"], b["cy"], b["h"]
                    sizes.append(size)
                if len(sizes) >= least and n - first >= window and median(sizes) > 2:
                    mpp, filter_, sizes = diameter / median(sizes), Motion(y, (10.0, 10.0, 10.0)), []
                    return [(n, "cal_lock", y, 0.0, mpp, size)]
                return [(n, "cal_static", y, 0.0, None, size)]
            filter_.predict(1 / fps, 0.01, False)
            src = "kalman"
            if n % every == 0:
                b = nearest(found, reach)
                if b is None:
                    src = "yolo_miss" if every_box else "yolo_empty"
                elif abs(b["cy"] - filter_.y) > gate * size:
                    src = "yolo_jump_reject"
                else:
                    src, x, y, size = "yolo+kalman", b["cx"], b["cy"], 0.7 * b["h"] + 0.3 * size
                    filter_.correct(y, 4.0)
            return [(n, src, filter_.y, 0.0 - filter_.v, mpp, size)]

        return step

    return fold(rows, key, [frame], [frame, "boxes", "_anchor"], f"{frame} long, src string, y double, v double, mpp double, size double", start)


def median_steps(features: DataFrame, key: str, frame: str, step: str, least: int = 5) -> DataFrame:
    """(key, frame, step, n): medians of the frames that have enough steps of features. Pre-aggregated; a frame has a few dozen."""
    return features.where(F.col(step).isNotNull()).groupBy(key, frame).agg(F.count("*").alias("n"), F.median(step).alias(step)).where(F.col("n") >= least)


def displaced_filter(frames: DataFrame, features: DataFrame, key: str, frame: str, time: str, place: str, step: str, mpp: float, least: int = 5) -> DataFrame:
    """(key, frame, src, y, v): one filter, in metres, of two kinds of observation. frames: where a frame has a place (pixels), that is absolute. Between such
    frames the place moves by the median step of at least so many features, and is observed there; with fewer it is only predicted.
    A video begins at its first absolute place."""
    moves = median_steps(features, key, frame, step, least).select(key, frame, F.col(step).alias("_step"))
    rows = frames.select(key, frame, time, place).join(moves, [key, frame], "left")

    def start():
        at = filter_ = last = None

        def fed(n, t, z, d):
            nonlocal at, filter_, last
            if filter_ is None:
                if missing(z):
                    return []
                at, filter_, last = z, Motion(z * mpp, (0.001, 0.1, 1.0)), t
                return [(n, "start", filter_.y, 0.0)]
            filter_.predict(t - last if t - last > 0 else 1 / 60, 25.0, True)
            last, src = t, "predicted"
            if not missing(z):
                src, at = "absolute", z
            elif not missing(d):
                src, at = "moved", at + d
            if src != "predicted":
                filter_.correct(at * mpp, 0.0004)
            return [(n, src, filter_.y, filter_.v)]

        return fed

    return fold(rows, key, [frame], [frame, time, place, "_step"], f"{frame} long, src string, y double, v double", start)


class Watch:
    """Clusters of all boxes seen, for a target that was lost to something at rest. A frame's work is for what it adds and for what expires: other clusters are as they were when
    they weren't to be adopted."""

    def __init__(self, least_conf: float, reach: float, keep: int, least: int, motion: float, away: float):
        self.least_conf, self.reach, self.keep, self.least, self.motion, self.away = least_conf, reach, keep, least, motion, away
        self.end()

    def end(self) -> None:
        self.clusters: list[list] = []  # centre x, y, observations (frame, cy, h), number; in order of their numbers
        self.order: deque = deque()  # frame and cluster of each observation
        self.number = 0
        self.target = None

    def moves(self, seen) -> bool:
        if len(seen) < self.least:
            return False
        heights = [o[1] for o in seen]
        if max(heights) - min(heights) < 1.99 * self.motion:  # a deviation is at most half of the range
            return False
        mean = sum(heights) / len(seen)
        return math.sqrt(sum((y - mean) ** 2 for y in heights) / len(seen)) > self.motion

    def see(self, n: int, boxes, target: float) -> tuple[float, float, float, int] | None:
        """A frame's boxes; centre, last height and observations of the cluster to adopt."""
        return self.take(n, [(b["cx"], b["cy"], b["h"], b["conf"]) for b in boxes], target)

    def take(self, n: int, boxes, target: float) -> tuple[float, float, float, int] | None:
        """see() of boxes as (cx, cy, h, conf)."""
        reach, hypot, changed = self.reach, math.hypot, {}
        if target != self.target:
            self.target, changed = target, {c[3]: c for c in self.clusters}
        for x, y, h, conf in boxes:
            if missing(conf) or conf < self.least_conf:
                continue
            for hit in self.clusters:
                if hypot(x - hit[0], y - hit[1]) < reach:
                    break
            else:
                hit = [x, y, deque(), self.number]
                self.number += 1
                self.clusters.append(hit)
            hit[0], hit[1] = 0.7 * x + 0.3 * hit[0], 0.7 * y + 0.3 * hit[1]
            hit[2].append((n, y, h))
            self.order.append((n, hit))
            changed[hit[3]] = hit
        empty = False
        while self.order and self.order[0][0] < n - self.keep:
            _, c = self.order.popleft()
            c[2].popleft()
            changed[c[3]] = c
            empty = empty or not c[2]
        if empty:
            self.clusters = [c for c in self.clusters if c[2]]
        for number in sorted(changed):
            x, y, seen, _ = changed[number]
            if seen and abs(seen[-1][1] - target) > self.away and self.moves(seen):
                self.end()
                return x, y, seen[-1][2], len(seen)
        return None


def watch_clusters(boxes: DataFrame, key: str, frame: str, least_conf: float = 0.3, reach: float = 60.0, keep: int = 90, least: int = 4, motion: float = 40.0, away: float = 60.0) -> DataFrame:
    """(key, frame, cx, cy, h, hits): where a target is adopted from clusters that watch all boxes (key, frame, pos, cx, cy, w, h, conf).

    A trusted box joins the first cluster nearer than reach, whose centre moves 7 parts of 10 to it, or makes a new one. Observations older than keep frames
    expire, clusters without any end. The first cluster with enough observations, whose heights deviate more than motion and whose last one is
    further than away from the target, is adopted: the target goes to its centre and all clusters end. Before the first adoption the target is at 0.
    State: the clusters of the last keep frames."""

    def start():
        watch, target = Watch(least_conf, reach, keep, least, motion, away), 0.0

        def step(n, *found):
            nonlocal target
            adopted = watch.take(n, list(zip(*(x.tolist() for x in found))) if found[0] is not None else [], target)
            if adopted is None:
                return []
            target = adopted[1]
            return [(n, *adopted)]

        return step

    # arrays of numbers reach Python many times faster than structs
    names = ["cx", "cy", "h", "conf"]
    rows = by_frame(boxes, key, frame).select(key, frame, *(F.col(f"boxes.{x}").cast("array<double>").alias(f"_{x}") for x in names))
    return fold(rows, key, [frame], [frame, *(f"_{x}" for x in names)], f"{frame} long, cx double, cy double, h double, hits long", start)
