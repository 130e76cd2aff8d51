"""Ordered folds: state machines and filters that need the last state for the next row.

Rows are dealt by key and sorted, and a fold runs over the sorted stream of a partition. It holds one key's state and one
batch, never a key's rows, so a key of any length fits. A window deals and sorts them, so rows that are dealt by key already are not shuffled again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(df: DataFrame, key: str, order: list[str], columns: list[str], schema: str, start: Callable) -> DataFrame:
    """start() gives a step: a function of (*columns) that returns a list of output rows, each without the key. schema is theirs. Rows with a null key are a group of
    their own, as are rows with a NaN key; all NaNs are one key, as Spark groups them."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, names = None, [key, "_null", *(x.split()[0] for x in schema.split(", "))]
        for f in frames:
            out = []
            for *k, place, row in zip(f["_key"], f["_null"], f["_place"], zip(*(f[c] for c in columns))):
                if place == 1:
                    step = start()
                out += [(*k, *x) for x in step(*row)]
            yield pd.DataFrame(out, columns=names)

    # the flag stands for null, as pandas would make doubles of whole numbers with nulls
    some = F.lit("1970-01-01" if kind.startswith(("date", "timestamp")) else "0").cast(kind)
    held = df.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).sortWithinPartitions(key, *order)
    rows = held.select(F.coalesce(F.col(key), some).alias("_key"), F.col(key).isNull().alias("_null"), "_place", *dict.fromkeys(columns))
    out = rows.mapInPandas(run, f"{key} {kind}, _null boolean, {schema}")
    # pandas makes nulls of NaNs, too: keys that weren't null were NaN
    own = F.coalesce(F.col(key), F.lit(float("nan")).cast(kind)) if kind in ("double", "float") else F.col(key)
    return out.withColumn(key, F.when(~F.col("_null"), own)).drop("_null")


def missing(x) -> bool:
    return x is None or x != x


REPS = "start_idx long, end_idx long, start_time double, end_time double, duration_s double, rom_m double, mcv_mps double, pcv_mps double"


def repetitions(df: DataFrame, key: str, order: str, exercise: str = "squat", thresh: float = 0.08, band: float = 0.02, confirm: int = 3, min_s: float = 0.20, min_rom: float = 0.12, least_rows: int = 10) -> DataFrame:
    """Repetitions of each key's (t, y, v), y up. Squats: down faster than thresh, then from where the next rows all rise to where they
    all fall. Deadlifts: from before two rows above thresh to two rows below band. The first row, and the last ones that have
    no full look-ahead, change no state; a repetition that is unfinished at the end is dropped. order: rows' places from 0."""
    from pyspark.sql import Window

    from kinetia.operators.windows import by, sustained

    ahead = sustained(df, key, order, "v", confirm, band)
    whole = Window.partitionBy(key)
    w = by(key, order)
    ready = ahead.withColumn("v_next", F.lead("v").over(w)).withColumn("t_last", F.lag("t").over(w)).withColumn("y_last", F.lag("y").over(w)).withColumn("v_last", F.lag("v").over(w))
    n = F.count("*").over(whole)
    live = (n >= least_rows) & (F.col(order) >= 1) & (F.col(order) < n - max(2, confirm + 1))
    ready = ready.withColumn("live", live)
    lift = exercise == "deadlift"

    def start():
        state, first = "idle", None
        top = -math.inf

        def step(i, t, y, v, rises, falls, v_next, t_last, y_last, v_last, live):
            nonlocal state, first, top
            out = []
            if state == "up":
                top = max(top, v)
            if not live:
                return out
            if state == "idle":
                if lift and v > thresh and v_next > thresh:
                    state, first, top = "up", (i - 1, t_last, y_last), max(v_last, v)
                elif not lift and v < -thresh:
                    state = "down"
            elif state == "down":
                if v >= -band and rises:
                    state, first, top = "up", (i, t, y), v
            elif (v < band and v_next < band) if lift else (v <= band and falls):
                state = "idle"
                seconds, rom = t - first[1], abs(y - first[2])
                if seconds >= min_s and rom >= min_rom:
                    out.append((first[0], i, first[1], t, seconds, rom, rom / seconds, top))
            return out

        return step

    return fold(ready, key, [order], [order, "t", "y", "v", "rises", "falls", "v_next", "t_last", "y_last", "v_last", "live"], REPS, start)


def traced(df: DataFrame, key: str, order: str, thresh: float = 0.08, band: float = 0.02, min_s: float = 0.20, min_rom: float = 0.12) -> DataFrame:
    """Every candidate of the older two-row rule over (t, y, v), with why it was dropped: (key, start, end, start_time, end_time, duration_s, rom, mcv, accepted, short, shallow, reason).
    Down faster than thresh, then up from where this row has stopped and the next one rises, to where this one has stopped and the next one doesn't rise. The first row and the last two change nothing."""
    from pyspark.sql import Window

    from kinetia.operators.windows import by

    n = F.count("*").over(Window.partitionBy(key))
    w = by(key, order)
    ready = df.withColumn("_next", F.lead("v").over(w)).withColumn("_i", F.row_number().over(w) - 1)
    ready = ready.withColumn("_live", (F.col("_i") >= 1) & (F.col("_i") < n - 2))

    def start():
        state, first = "idle", None

        def step(i, t, y, v, ahead, live):
            nonlocal state, first
            if not live:
                return []
            if state == "idle" and v < -thresh:
                state = "down"
            elif state == "down" and v >= -band and ahead > band:
                state, first = "up", (i, t, y)
            elif state == "up" and v <= band and ahead < band:
                state = "idle"
                seconds, rom = t - first[1], abs(y - first[2])
                short, shallow = seconds < min_s, rom < min_rom
                why = "; ".join(x for x, on in ((f"dur {seconds:.3f}<{min_s}", short), (f"rom {rom:.4f}<{min_rom}", shallow)) if on)
                return [(first[0], i, first[1], t, seconds, rom, rom / seconds if seconds > 0 else 0.0, not (short or shallow), short, shallow, why)]
            return []

        return step

    schema = "start long, end long, start_time double, end_time double, duration_s double, rom double, mcv double, accepted boolean, short boolean, shallow boolean, reason string"
    return fold(ready, key, [order], [order, "t", "y", "v", "_next", "_live"], schema, start)


def kalman_scalar(df: DataFrame, key: str, order: str, value: str, q: float = 0.005, r: float = 0.05, keep: str | None = None) -> DataFrame:
    """A random-walk filter of one value from 0 with variance 1: (key, order, filtered), and with keep that column of doubles as it was."""

    def start():
        x, p = 0.0, 1.0

        def step(i, z, *kept):
            nonlocal x, p
            p += q
            if not missing(z):
                k = p / (p + r)
                x, p = x + k * (z - x), (1 - k) * p
            return [(i, *kept, x)]

        return step

    kept = [keep] if keep else []
    return fold(df, key, [order], [order, value, *kept], f"{order} long, {''.join(f'{c} double, ' for c in kept)}filtered double", start)


class Motion:
    """A value with its speed and acceleration, and their six covariances written out."""

    __slots__ = ("a", "p00", "p01", "p02", "p11", "p12", "p22", "v", "y")

    def __init__(self, y: float, p0: tuple[float, float, float]):
        self.y, self.v, self.a = float(y), 0.0, 0.0
        self.p00, self.p11, self.p22 = p0
        self.p01 = self.p02 = self.p12 = 0.0

    def predict(self, d: float, q: float, jumps: bool) -> None:
        """By a time d. q: the density of the acceleration's jumps, or else what is added to each variance."""
        e = d * d / 2
        self.y, self.v = self.y + self.v * d + self.a * e, self.v + self.a * d
        m00, m01, m02 = self.p00 + d * self.p01 + e * self.p02, self.p01 + d * self.p11 + e * self.p12, self.p02 + d * self.p12 + e * self.p22
        m11, m12 = self.p11 + d * self.p12, self.p12 + d * self.p22
        ee, ed, e1, dd, d1 = (q * e * e, q * e * d, q * e, q * d * d, q * d) if jumps else (q, 0.0, 0.0, q, 0.0)
        self.p00, self.p01, self.p02 = m00 + d * m01 + e * m02 + ee, m01 + d * m02 + ed, m02 + e1
        self.p11, self.p12, self.p22 = m11 + d * m12 + dd, m12 + d1, self.p22 + q

    def correct(self, z: float, r: float) -> None:
        s, off = self.p00 + r, z - self.y
        k0, k1, k2 = self.p00 / s, self.p01 / s, self.p02 / s
        self.y, self.v, self.a = self.y + k0 * off, self.v + k1 * off, self.a + k2 * off
        self.p11, self.p12, self.p22 = self.p11 - k1 * self.p01, self.p12 - k1 * self.p02, self.p22 - k2 * self.p02
        self.p00, self.p01, self.p02 = self.p00 - k0 * self.p00, self.p01 - k0 * self.p01, self.p02 - k0 * self.p02


def kalman_motion(df: DataFrame, key: str, order: str, time: str | None, value: str, noise: float, r: float, p0: tuple[float, float, float], dt: float | None = None) -> DataFrame:
    """Constant-acceleration filter of a position: (key, order, y, v, a). noise: spectral density of the acceleration's jumps with
    time steps from ``time`` (steps that don't go forward count as a sixtieth of a second), or with a fixed dt the variance added to each state."""

    def start():
        held = last = None

        def step(i, t, z):
            nonlocal held, last
            seen = not missing(z)
            if held is None:
                if not seen:
                    return []
                held, last = Motion(z, p0), t
            else:
                held.predict(dt if dt is not None else t - last if t - last > 0 else 1 / 60, noise, dt is None)
                last = t
                if seen and math.isfinite(z):
                    held.correct(z, r)
            return [(i, held.y, held.v, held.a)]

        return step

    return fold(df, key, [order], [order, time or order, value], f"{order} long, y double, v double, a double", start)


def physical_filter(df: DataFrame, key: str, order: str, time: str, value: str) -> DataFrame:
    return kalman_motion(df, key, order, time, value, 25.0, 0.0004, (0.001, 0.1, 1.0))


def fixed_step_filter(df: DataFrame, key: str, order: str, value: str, dt: float = 1 / 120) -> DataFrame:
    return kalman_motion(df, key, order, None, value, 0.01, 4.0, (10.0, 10.0, 10.0), dt)


def associate(df: DataFrame, key: str, order: str, reach: float = 400.0, anchor_frames: int = 5, timeout_frames: int = 15) -> DataFrame:
    """States of a target's detections (cx, cy; null where there is none): (key, order, state, valid, gap, cx, cy, is_anchor). A target is anchored at the
    median of its first detections; lost, it is held at the anchor's height; found in time it has RECOVERED, later it has DRIFTED and is anchored anew."""

    def start():
        state, seen, anchor, lost, held = "INIT", [], (0.0, 0.0), 0, None

        def blend(a, x, y):
            return (a * x + (1 - a) * anchor[0], a * y + (1 - a) * anchor[1])

        def step(i, x, y):
            nonlocal state, seen, anchor, lost, held
            there = not missing(x) and not missing(y)
            x, y = (x, y) if there else (None, None)
            if state in ("INIT", "ANCHORING"):
                if there:
                    state, seen = "ANCHORING", [*seen, (x, y)]
                if len(seen) >= anchor_frames:
                    state, anchor, seen = "TRACKING", (median(a for a, _ in seen), median(b for _, b in seen)), []
                return [(i, state, there, 0, x, y, there)]
            if state == "TRACKING":
                if not there:
                    state, lost, held = "LOST", i, anchor[1]
                elif math.hypot(x - anchor[0], y - anchor[1]) < reach:
                    anchor = blend(0.7, x, y)
                return [(i, state, there, 0, x, y, False)]
            gap = i - lost
            if not there:
                return [(i, "LOST", True, gap, None, held, False)]
            if gap <= timeout_frames:
                state, anchor = "TRACKING", blend(0.5, x, y)
                return [(i, "RECOVERED", True, gap, x, y, False)]
            state, seen = "ANCHORING", [(x, y)]
            return [(i, "DRIFTED", True, gap, x, y, True)]

        return step

    return fold(df, key, [order], [order, "cx", "cy"], f"{order} long, state string, valid boolean, gap long, cx double, cy double, is_anchor boolean", start)


class Descent:
    """Follows a height (y down) through descents, and tells when a turn after a descent's lowest point is confirmed. Unknown until a top is given or seen."""

    __slots__ = ("armed", "held", "high", "low", "low_at", "top", "up")

    def __init__(self):
        self.top = None

    def begin(self, y: float, i: int = 0) -> None:
        self.up, self.top, self.low, self.low_at, self.armed, self.held, self.high = False, y, y, i, False, 0, y

    def turned(self, y: float, i: int, radius: float, arm: float = 1.5, back: float = 0.3, frames: int = 4) -> bool:
        if self.top is None:
            self.begin(y, i)
        elif self.up:
            self.high = min(self.high, y)
            if self.low - self.high >= arm * radius:
                self.begin(self.high, i)
        elif y > self.low:
            self.low, self.low_at, self.held = y, i, 0
            self.armed = self.armed or y - self.top >= arm * radius
        elif self.armed:
            self.held = self.held + 1 if self.low - y >= back * radius else 0
            if self.held >= frames:
                self.up, self.armed, self.held, self.high = True, False, 0, y
                return True
        return False


def bottoms(df: DataFrame, key: str, order: str, value: str, radius: float, arm: float = 1.5, back: float = 0.3, frames: int = 4) -> DataFrame:
    """Triggers after the lowest point (largest value, y down) of each descent: (key, order, bottom, at). A descent of arm radii from the top arms; it fires when
    for so many frames in a row the value has been back radii above the lowest. Then the value must climb arm radii, to a new top, before the next descent counts.
    Thresholds are products of decimals, as written: 1.5 radii of 0.1 are 0.15, not the 0.15000000000000002 of doubles, which a tie would miss."""
    arms, backs = (float(Decimal(repr(x)) * Decimal(repr(radius))) for x in (arm, back))

    def start():
        d = Descent()
        return lambda i, y: [(i, d.low, d.low_at)] if not missing(y) and d.turned(y, i, 1.0, arms, backs, frames) else []

    return fold(df, key, [order], [order, value], f"{order} long, bottom double, at long", start)


def thin(df: DataFrame, key: str, order: str, time: str, least: float) -> DataFrame:
    """Rows more than least after the last one that was kept: (key, order, time)."""

    def start():
        last = -math.inf

        def step(i, t):
            nonlocal last
            if t - last <= least:
                return []
            last = t
            return [(i, t)]

        return step

    return fold(df, key, [order], [order, time], f"{order} long, {time} double", start)


def merge_peaks(df: DataFrame, key: str, order: str, value: str, apart: float) -> DataFrame:
    """Of peaks nearer than apart to the last one of their group the highest: (key, order, value)."""

    def start():
        group = None

        def step(i, v, final):
            nonlocal group
            out = []
            if group is not None and i - group[0] < apart:
                group = (i, v) if v > group[1] else group
            else:
                if group is not None:
                    out.append(group)
                group = (i, v)
            return [*out, group] if final else out

        return step

    from kinetia.operators.windows import by

    marked = df.withColumn("final", F.lead(order).over(by(key, order)).isNull())
    return fold(marked, key, [order], [order, value, "final"], f"{order} long, {value} double", start)


def decayed(df: DataFrame, key: str, order: str, value: str, keep: float = 0.7, decay: float = 0.6) -> DataFrame:
    """Exponential average of a value, shrunk by decay where it misses: (key, order, average)."""

    def start():
        x = None

        def step(i, v):
            nonlocal x
            x = (None if x is None else x * decay) if missing(v) else v if x is None else keep * v + (1 - keep) * x
            return [(i, x)]

        return step

    return fold(df, key, [order], [order, value], f"{order} long, average double", start)
