"""Tracks from several detections a frame. Folds over a video's detections; their state is the tracks that are alive."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetia.operators.folds import fold, median, missing


def by_frame(boxes: DataFrame, key: str, frame: str, *more: str) -> DataFrame:
    """One row a frame with its few boxes in order; frames without any must be rows with null boxes."""
    box = F.struct("pos", "cx", "cy", "w", "h", "conf", *more)
    return boxes.groupBy(key, frame).agg(F.sort_array(F.collect_list(F.when(F.col("cx").isNotNull(), box))).alias("boxes"))


class Candidate:
    """A track that awaits confirmation: its last box, its hits and the mean and squared deviations of its heights."""

    __slots__ = ("box", "hits", "id", "mean", "missed", "squares")

    def __init__(self, id_: int, box):
        self.id, self.box, self.hits, self.missed, self.mean, self.squares = id_, box, 1, 0, box["cy"], 0.0

    def take(self, box) -> None:
        self.box, self.hits, self.missed = box, self.hits + 1, 0
        off = box["cy"] - self.mean
        self.mean += off / self.hits
        self.squares += off * (box["cy"] - self.mean)

    @property
    def motion(self) -> float:
        return math.sqrt(self.squares / self.hits)


class Pending:
    """The candidates of one video. In order, each takes the nearest free box below reach; other boxes begin new ones; those that miss more frames than allowed end."""

    def __init__(self, reach: float, most_missed: int):
        self.reach, self.most_missed, self.alive, self.next_id = reach, most_missed, [], 0

    def see(self, boxes) -> list[Candidate]:
        """A frame's boxes; the candidates that took or began with one."""
        free, taken = dict(enumerate(boxes)), []
        for t in self.alive:
            x, y = t.box["cx"], t.box["cy"]
            near = min(((math.hypot(b["cx"] - x, b["cy"] - y), i) for i, b in free.items()), default=(self.reach, -1))
            if near[0] < self.reach:
                t.take(free.pop(near[1]))
                taken.append(t)
            else:
                t.missed += 1
        new = [Candidate(self.next_id + i, b) for i, b in enumerate(free.values())]
        self.next_id += len(new)
        self.alive = [t for t in self.alive if t.missed <= self.most_missed] + new
        return taken + new


def pending(boxes: DataFrame, key: str, frame: str, reach: float = 40.0, most_missed: int = 5) -> DataFrame:
    """(key, frame, track, pos, hits): each box's track. Tracks, in order, take the nearest free box below reach; other boxes begin tracks; a track that misses more frames than allowed ends."""

    def start():
        candidates = Pending(reach, most_missed)
        return lambda f, found: [(f, t.id, t.box["pos"], t.hits) for t in candidates.see(found if found is not None else [])]

    return fold(by_frame(boxes, key, frame), key, [frame], [frame, "boxes"], f"{frame} long, track long, pos long, hits long", start)


def moving_track(tracked: DataFrame, key: str, least: int = 5, frame: str = "frame_idx", window: int | None = None) -> DataFrame:
    """tracked (key, frame, track, cy, conf), with window only the rows of the last so many frames up to each key's last one: each key's track of enough hits whose cy varies most, of equals the one with the larger last confidence, then the earlier one."""
    if window is not None:
        last = tracked.groupBy(key).agg(F.max(frame).alias("_last"))
        tracked = tracked.join(last, key).where(F.col(frame) > F.col("_last") - window)
    found = tracked.groupBy(key, "track").agg(F.count("*").alias("hits"), F.stddev_pop("cy").alias("motion"), F.max_by("conf", frame).alias("conf")).where(F.col("hits") >= least)
    return found.groupBy(key).agg(F.max(F.struct("motion", "conf", (-F.col("track")).alias("t"), "hits")).alias("b")).select(key, (-F.col("b.t")).alias("track"), F.col("b.motion").alias("motion"), F.col("b.hits").alias("hits"))


def nearest_to_previous(boxes: DataFrame, key: str, frame: str) -> DataFrame:
    """(key, frame, pos): of each frame the box nearest to the last frame's choice, the first of equals; the largest one after a frame without boxes."""

    def start():
        last = None

        def step(f, found):
            nonlocal last
            if found is None or not len(found):
                last = None
                return [(f, None)]
            cost = (lambda b: (b["cx"] - last[0]) ** 2 + (b["cy"] - last[1]) ** 2) if last else (lambda b: -b["w"] * b["h"])
            b = min(found, key=cost)
            last = (b["cx"], b["cy"])
            return [(f, b["pos"])]

        return step

    return fold(by_frame(boxes, key, frame), key, [frame], [frame, "boxes"], f"{frame} long, pos long", start)


def seed_clusters(boxes: DataFrame, key: str, order: str, reach: float = 100.0) -> DataFrame:
    """(key, order, cluster): detections in order join the first seed within reach; one that none is near becomes a seed. State: the seeds."""

    def start():
        seeds = []

        def step(i, x, y):
            for k, (a, b) in enumerate(seeds):
                if math.hypot(x - a, y - b) < reach:
                    return [(i, k)]
            seeds.append((x, y))
            return [(i, len(seeds) - 1)]

        return step

    return fold(boxes, key, [order], [order, "cx", "cy"], f"{order} long, cluster long", start)


def consensus(clustered: DataFrame, key: str, least: int = 3) -> DataFrame:
    """clustered (key, cluster, order, cx, cy, w, h, conf, frame): mean box and score of clusters of enough detections, the best member (the first of equals) and the number of frames."""
    best = F.max_by("pos", F.struct("conf", -F.col("pos")))
    return clustered.groupBy(key, "cluster").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("cx", "cy", "w", "h")), F.avg("conf").alias("score"), best.alias("best"), F.countDistinct("frame").alias("n_frames")).where(F.col("n") >= least)


def liveliest_cluster(clustered: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's cluster of the largest number times deviation, the first of equals."""
    c = clustered.groupBy(key, "cluster").agg((F.count("*") * F.stddev_pop(value)).alias("score"), F.count("*").alias("n"))
    return c.groupBy(key).agg(F.max(F.struct("score", (-F.col("cluster")).alias("c"), "n")).alias("b")).select(key, (-F.col("b.c")).alias("cluster"), F.col("b.score").alias("score"), F.col("b.n").alias("n"))


def fuse(df: DataFrame, key: str, order: str, least_iou: float = 0.2, weight: float = 0.6, sure: float = 0.65, wide: float = 1.4, decay: float = 0.6) -> DataFrame:
    """A tracked box and a detection (dx, dy, dh, conf; null: none), both wide times as wide as high: (key, order, state, cx, cy, speed). A: they overlap, and the detection is
    blended with where the speed has brought the tracked box since the last frame that had a detection; B: they don't, but the detection is sure and is taken, at rest; C: it is
    ignored. The speed, 7 parts of 10 new, is taken between detections of following frames; frames without one slow it down."""

    def start():
        x = y = size = None
        speed, missed = 0.0, 0

        def step(i, dx, dy, dh, conf):
            nonlocal x, y, size, speed, missed
            if missing(dx):
                if x is not None:
                    speed, missed = speed * decay, missed + 1
                return [(i, None, x, y, speed)]
            if x is None:
                x, y, size = dx, dy, dh
                return [(i, "B", x, y, speed)]
            if missed == 0:
                speed = 0.7 * (dy - y) + 0.3 * speed
            over = max(0.0, min(x + size * wide / 2, dx + dh * wide / 2) - max(x - size * wide / 2, dx - dh * wide / 2))
            both = over * max(0.0, min(y + size / 2, dy + dh / 2) - max(y - size / 2, dy - dh / 2))
            if both / max(size * wide * size + dh * wide * dh - both, 1e-6) > least_iou:
                ahead = speed * (missed + 1)
                state, x, y, size = "A", weight * dx + (1 - weight) * (x + ahead), weight * dy + (1 - weight) * (y + ahead), dh
            elif conf > sure:
                state, x, y, size, speed = "B", dx, dy, dh, 0.0
            else:
                state = "C"
            missed = 0
            return [(i, state, x, y, speed)]

        return step

    return fold(df, key, [order], [order, "dx", "dy", "dh", "conf"], f"{order} long, state string, cx double, cy double, speed double", start)


def static_scale(df: DataFrame, key: str, order: str, size: str, least: int = 10, share: float = 0.5, frames: int = 15, diameter: float = 0.45) -> DataFrame:
    """(key, order, mpp): the frame that locks the scale, from the median size so far: with least samples, once they range over a share of the last size or so many
    frames have passed since the first. At most frames + 1 sizes are held unless many frames lack one."""

    def start():
        seen, first, done = [], None, False

        def step(i, h):
            nonlocal first, done
            if done or missing(h):
                return []
            first = i if first is None else first
            seen.append(h)
            if len(seen) < least or not (max(seen) - min(seen) > share * h or i - first >= frames):
                return []
            done = True
            return [(i, diameter / median(seen) if median(seen) else None)]

        return step

    return fold(df, key, [order], [order, size], f"{order} long, mpp double", start)
