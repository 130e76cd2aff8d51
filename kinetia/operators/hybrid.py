"""The hybrid tracker as one fold over a video's frames: candidates are confirmed, then a target is carried from frame to frame by fits of its image and put
right by detections.

What looks at pixels is input: boxes with the match of the target's image at each, and each frame's best fit of that image.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetia.functions.columns import anchor_score
from kinetia.operators.folds import Descent, fold, median, missing
from kinetia.operators.trackers import Watch
from kinetia.operators.tracks import Pending, by_frame


@dataclass(frozen=True)
class Rules:
    """Thresholds: frames, pixels, scores, and shares of the target's size or radius."""

    scan: int = 90  # frames in which candidates may be confirmed
    hits: int = 5  # boxes of a confirmed candidate
    least_conf: float = 0.30
    every: int = 15  # frames from detection to detection
    after: int = 8  # missed frames after which every frame is detected
    gate: float = 150.0  # detections further than this from where the speed leads don't count
    same: float = 0.5  # match of a box that shows the target
    trust: int = 2  # missed frames up to which a box must match
    fit: float = 0.45  # score of a fit that counts
    step: float = 0.25  # of the size, the most that a fit moves
    least_step: float = 15.0
    overlap: float = 0.20
    weight: float = 0.60  # of a detection that overlaps
    sure: float = 0.65  # confidence that takes the target to a detection apart from it
    hold: int = 40  # missed frames for which a place is given
    decay: float = 0.6
    renew: float = 0.45  # confidence at which the target's image is taken anew
    renew_lost: float = 0.35  # the same after a frame without the target
    samples: int = 10  # sizes before the scale may be locked
    change: float = 0.5  # of the size, range of sizes that locks it
    settle: int = 15  # frames after the first one that lock it
    low_conf: float = 0.25  # of boxes looked at after a turn
    correction: float = 4.0  # radii
    least_correction: float = 0.2
    wide: float = 1.4
    diameter: float = 0.45


def overlap(x: float, y: float, h: float, b, wide: float) -> float:
    """Shared part of two boxes that are wide times as wide as high."""
    k = b["h"]
    across = max(0.0, min(x + h * wide / 2, b["cx"] + k * wide / 2) - max(x - h * wide / 2, b["cx"] - k * wide / 2))
    both = across * max(0.0, min(y + h / 2, b["cy"] + k / 2) - max(y - h / 2, b["cy"] - k / 2))
    return both / max(h * wide * h + k * wide * k - both, 1e-6)


def matching(b) -> float:
    return 0.0 if missing(b["match"]) else b["match"]


class Target:
    """One video's state: candidates until one is confirmed, then place, size and speed of the target with its three machines (watch clusters, turns, scale)."""

    def __init__(self, rules: Rules, hint: tuple[float, float] | None):
        self.rules, self.hint, self.first = rules, hint, None
        self.candidates, self.turns = Pending(40.0, 5), Descent()
        self.watch = Watch(rules.least_conf, 60.0, 90, 4, 40.0, 60.0)
        self.x = self.y = self.size = None
        self.speed, self.missed, self.src = 0.0, 0, "none"
        self.sizes: list[float] = []  # of the scale: one at first, then one a correction
        self.still: list[float] | None = []  # sizes until the scale is locked

    def go(self, x: float, y: float, size: float) -> None:
        self.x, self.y, self.size = x, y, size

    def confirm(self, n: int, boxes) -> bool:
        """Whether a candidate with enough hits, of them the one that moves most, becomes the target."""
        if n > self.rules.scan:
            return False
        boxes = [b for b in boxes if b["boot"]]
        if self.hint is not None:
            boxes = sorted(boxes, key=lambda b: math.hypot(b["cx"] - self.hint[0], b["cy"] - self.hint[1]))[:1]
        self.candidates.see(boxes)
        ready = [c for c in self.candidates.alive if c.hits >= self.rules.hits]
        if not ready:
            return False
        best = max(ready, key=lambda c: (c.motion, c.box["conf"])).box
        self.go(best["cx"], best["cy"], best["h"])
        self.first, self.sizes, self.src, self.candidates = n, [self.size], "boot", None
        self.turns.begin(self.y, n)
        return True

    def choose(self, boxes):
        """Of the two boxes nearest to where the speed leads the first that shows the target; after a longer loss the nearest."""
        r, ahead = self.rules, self.y + self.speed * (self.missed + 1)
        near = sorted(((math.hypot(b["cx"] - self.x, b["cy"] - ahead), i) for i, b in enumerate(boxes)))
        near = [boxes[i] for off, i in near if off < r.gate]
        return next((b for b in near[:2] if self.missed > r.trust or matching(b) >= r.same), None)

    def adopt(self, n: int, boxes) -> bool:
        found = self.watch.see(n, boxes, self.y)
        if found is None:
            return False
        self.go(*found[:3])
        self.sizes, self.speed, self.missed, self.src = [self.size], 0.0, 0, "adopt"
        self.turns.begin(self.y, n)
        return True

    def fuse(self, n: int, b) -> tuple[bool, bool]:
        """A chosen box: whether the image is taken anew, and whether the target went on smoothly."""
        r, before = self.rules, self.y
        if self.missed == 0:
            self.speed = 0.7 * (b["cy"] - self.y) + 0.3 * self.speed
        if overlap(self.x, self.y, self.size, b, r.wide) > r.overlap:
            ahead = self.speed * (self.missed + 1)
            self.go(r.weight * b["cx"] + (1 - r.weight) * (self.x + ahead), r.weight * b["cy"] + (1 - r.weight) * (self.y + ahead), b["h"])
        elif b["conf"] > r.sure:
            self.go(b["cx"], b["cy"], b["h"])
            self.speed, self.missed, self.src = 0.0, 0, "reanchor"
            self.turns.begin(self.y, n)
            return True, False
        self.lock(n, b["h"])
        lost = self.missed > 0 or self.src in ("reject", "hold")
        anew = b["conf"] >= (r.renew_lost if lost else r.renew)
        self.missed, self.src = 0, "yolo"
        if abs(self.y - before) <= max(r.least_step, r.step * b["h"]):
            return anew, True
        self.turns.begin(self.y, n)
        return anew, False

    def lock(self, n: int, size: float) -> None:
        r = self.rules
        if self.still is None:
            return
        self.still.append(size)
        if len(self.still) >= r.samples and (max(self.still) - min(self.still) > r.change * self.size or n - self.first >= r.settle):
            self.sizes, self.still = [median(self.still)], None

    def follow(self, x, y, score) -> bool:
        """By the frame's fit; whether it was near enough. Else the place is held."""
        r, fits = self.rules, not (missing(x) or missing(y) or missing(score)) and score >= self.rules.fit
        if fits and math.hypot(x - self.x, y - self.y) <= max(r.least_step, r.step * self.size):
            if self.missed == 0:
                self.speed = 0.7 * (y - self.y) + 0.3 * self.speed
            self.x, self.y, self.missed, self.src = x, y, 0, "ncc"
            return True
        self.missed += 1
        if not fits:
            self.speed *= r.decay
        self.src = "hold" if self.missed <= r.hold else "reject" if fits else "miss"
        return False

    def correct(self, n: int, boxes) -> str | None:
        """After a confirmed turn: snap to a box that shows the target, micro if it is where the target is, reject without any. Null: no turn."""
        r, radius = self.rules, max(10.0, self.size / 2)
        if self.size <= 0 or not self.turns.turned(self.y, n, self.size / 2):
            return None
        near = [(math.hypot(b["cx"] - self.x, b["cy"] - self.y), -i) for i, b in enumerate(boxes) if b["conf"] >= r.low_conf]
        off, i = min(near, default=(math.inf, 0))  # the last of equals
        if off > r.correction * radius or (matching(boxes[-i]) < 0.5 and boxes[-i]["conf"] < 0.5):
            return "reject"
        if off < r.least_correction * radius:
            return "micro"
        self.go(boxes[-i]["cx"], boxes[-i]["cy"], boxes[-i]["h"])
        self.sizes.append(self.size)
        self.speed, self.missed, self.src = 0.0, 0, "regrind"
        return "snap"

    def step(self, n, boxes, fx, fy, score):
        boxes = [b for b in (boxes if boxes is not None else []) if not (missing(b["cy"]) or missing(b["h"]) or missing(b["conf"]))]
        found = [b for b in boxes if b["conf"] >= self.rules.least_conf]
        if self.first is None:
            return [self.row(n, 1.0 if self.confirm(n, found) else 0.0, True, False, self.first is not None, None)]
        detect = n % self.rules.every == 0 or self.missed > self.rules.after
        chosen = self.choose(found) if detect else None
        adopted = detect and self.adopt(n, found)
        anew, smooth, rated = adopted, False, 1.0
        if chosen is not None:
            anew, smooth = self.fuse(n, chosen)
            anew = anew or adopted
        else:
            self.missed += detect
            if not adopted:
                smooth = self.follow(fx, fy, score)
                rated = score if not missing(score) and score >= self.rules.fit and not (missing(fx) or missing(fy)) else 0.0
        turn = self.correct(n, boxes) if smooth else None
        if turn == "snap":
            anew, rated = True, 1.0
        return [self.row(n, rated, detect, adopted, anew, turn)]

    def row(self, n, score, detect, adopted, anew, turn):
        if self.first is None:
            return (n, "none", None, None, None, None, score, n <= self.rules.scan, False, False, None)
        there = self.src not in ("reject", "miss")
        scale = median(self.sizes)
        return (n, self.src, self.x if there else None, self.y if there else None, self.size, self.rules.diameter / scale if scale > 0 else None, score, detect, adopted, anew, turn)


def hybrid(boxes: DataFrame, fits: DataFrame, key: str, frame: str, width: float, height: float, hint: tuple[float, float] | None = None, rules: Rules | None = None) -> DataFrame:
    """(key, frame, src, x, y, size, mpp, score, detected, adopted, anew, turn), a row a frame. Frames are numbered from 1.

    boxes (key, frame, pos, cx, cy, w, h, conf, match), match: how well the target's image fits there (null: 0); frames without boxes are rows with null boxes. fits
    (key, frame, fx, fy, score): the best place of that image in a frame, of several the one with the largest score, then the smallest place. Boxes without place, height or confidence don't count.
    src: none until a candidate is confirmed (boot); yolo, reanchor, adopt: by a detection; ncc: by a fit; regrind: put right after a turn; hold: missed, the place is
    kept; reject, miss: missed too long, no place. A frame that adopts a cluster's place still takes the box that was chosen for the place before, as published; then
    src is that of the box and adopted says the rest. anew: the target's image is to be taken anew; turn: snap, micro or reject after a confirmed turn.
    A video that isn't confirmed in its first frames keeps src none to its end. State: one target's, the clusters of 90 frames, one size a correction, and until
    the scale is locked, with ten sizes that differ or after 15 frames, at most 16 sizes."""
    rules = rules or Rules()
    fine = anchor_score(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.col("conf"), width, height) > 0
    rows = by_frame(boxes.withColumn("boot", F.coalesce(fine, F.lit(False))), key, frame, "match", "boot")
    best = F.max(F.struct("score", (-F.col("fx")).alias("x"), (-F.col("fy")).alias("y"))).alias("b")
    at = fits.where("score IS NOT NULL AND NOT isnan(score)").groupBy(F.col(key).alias("_k"), F.col(frame).alias("_f")).agg(best)
    rows = rows.join(at, rows[key].eqNullSafe(at["_k"]) & (rows[frame] == at["_f"]), "left").select(rows[key], rows[frame], "boxes", (-F.col("b.x")).alias("_fx"), (-F.col("b.y")).alias("_fy"), F.col("b.score").alias("_score"))
    schema = f"{frame} long, src string, x double, y double, size double, mpp double, score double, detected boolean, adopted boolean, anew boolean, turn string"
    return fold(rows, key, [frame], [frame, "boxes", "_fx", "_fy", "_score"], schema, lambda: Target(rules, hint).step)


def report(tracked: DataFrame, key: str) -> DataFrame:
    """tracked: rows of hybrid. A row a video: status TRACKED or NO_PLATE_DETECTED, frames, detections (those after turns, too) and their share of the frames, coverage
    (the share that is booted, detected, fitted or corrected; held and adopted frames don't count), the mean of positive scores and the corrections by kind."""
    n, looked = F.count("*"), F.count_if("detected") + F.count("turn")
    covered = F.count_if(F.col("src").isin("ncc", "yolo", "boot", "regrind")) / n
    kinds = (F.count_if(F.col("turn") == k).alias(f"n_{k}") for k in ("snap", "micro", "reject"))
    status = F.when(F.bool_or(F.col("src") != "none"), "TRACKED").otherwise("NO_PLATE_DETECTED")
    score = F.coalesce(F.avg(F.when(F.col("score") > 0, F.col("score"))), F.lit(0.0))
    return tracked.groupBy(key).agg(status.alias("status"), n.alias("n_frames"), looked.alias("n_detections"), (looked / n).alias("detection_share"), covered.alias("coverage"), score.alias("mean_score"), *kinds, F.count_if("adopted").alias("n_adopted"))
