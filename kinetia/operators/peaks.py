"""Peaks of a signal, smoothing with fitted edges, and the older segmentation that rests on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetia.operators import folds, windows


def savgol_weights(window: int, degree: int, deriv: int = 0) -> np.ndarray:
    """A row for each place in a window: the weights of the window's values in the least-squares polynomial's value (or derivative) there."""
    x = np.arange(window) - window // 2
    fit = np.linalg.pinv(np.vander(x, degree + 1, increasing=True))
    powers = np.arange(degree + 1)
    scale = np.array([np.prod(np.arange(p, p - deriv, -1)) if p >= deriv else 0.0 for p in powers], float)
    return np.where(powers >= deriv, scale * x[:, None].astype(float) ** np.maximum(powers - deriv, 0), 0.0) @ fit


def savgol(df: DataFrame, key: str, order: str, value: str, window: int, degree: int, deriv: int = 0, name: str = "smooth", least: int | None = None) -> DataFrame:
    """Savitzky-Golay smoothing or derivative by unit steps; the first and last half window take the polynomial of the first and the last whole window.
    Null for keys with fewer rows than the window. With least, keys of no more rows than the window take the largest odd window below their number of rows, from least
    on, and a degree below it; keys too short for that are null. One native window over lags and leads."""
    w = windows.by(key, order)
    i, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(key))
    near = [F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w) for k in range(1 - window, window)]
    held = df.withColumn("_near", F.array(*near)).withColumn("_i", i).withColumn("_n", n)

    def total(width: int):
        rows = savgol_weights(width, min(degree, width - 1), deriv)
        first = F.greatest(F.lit(0), F.least(F.col("_i") - width // 2, F.col("_n") - width))  # the window's first row
        place = F.col("_i") - first
        weights = F.get(F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in rows)), place.cast("int"))
        values = F.slice("_near", (window - place).cast("int"), F.lit(width))
        return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)

    if least is None:
        smooth = F.when(F.col("_n") >= window, total(window))
    else:
        smooth = F.when(F.col("_n") > window, total(window))
        for width in range(window - 2, least - 1, -2):
            smooth = smooth.when(F.col("_n") > width, total(width))
    return held.withColumn(name, smooth).drop("_near", "_i", "_n")


def find(y: np.ndarray, distance: int = 1, prominence: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Places and prominences of local maxima (the middle of a flat top). Of those nearer than distance to a higher one that stays, only that stays;
    the prominence of the others is their height over the higher of the lowest values on the way to a higher value on either side."""
    change = np.nonzero(np.diff(y))[0]
    starts, ends = np.append(0, change + 1), np.append(change, len(y) - 1)
    level = y[starts]
    top = np.nonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:]))[0] + 1 if len(level) > 2 else np.zeros(0, int)
    at = (starts[top] + ends[top]) // 2
    stays = np.ones(len(at), bool)
    for k in np.argsort(y[at], kind="stable")[::-1]:
        if stays[k]:
            stays[(np.abs(at - at[k]) < distance) & (np.arange(len(at)) != k)] = False
    at = at[stays]
    out = np.zeros(len(at))
    for k, i in enumerate(at):
        lows = []
        for part in (y[: i + 1][::-1], y[i:]):
            higher = np.nonzero(part > y[i])[0]
            lows.append(part[: higher[0] if len(higher) else len(part)].min())
        out[k] = y[i] - max(lows)
    return at[out >= prominence], out[out >= prominence]


def peaks(df: DataFrame, key: str, order: str, value: str, distance: int = 1, prominence: float = 0.0) -> DataFrame:
    """(key, order, height, prominence) of each key's peaks. A key is one video's signal, a few numbers a frame, and is one task's, as heights are compared over
    all of it; nulls are left out."""
    kinds = dict(df.dtypes)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order)
        y = f[value].to_numpy(float)
        at, high = find(y, distance, prominence)
        return pd.DataFrame({key: f[key].to_numpy()[at], order: f[order].to_numpy()[at], "height": y[at], "prominence": high})

    rows = df.where(F.col(value).isNotNull()).select(key, order, value)
    return rows.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, height double, prominence double")


def peak_troughs(signal: DataFrame, peaks_: DataFrame, troughs: DataFrame, key: str, order: str, value: str, gap: int, reach: int, share: float = 0.6) -> DataFrame:
    """(key, order, end, found, peak_value, end_value): each peak with the first trough more than gap rows after it that lies below the key's share quantile, or, where there is
    none, with the lowest of its own and the next reach rows, the first of equals. signal: rows without gaps in order; peaks_ and troughs: (key, order), rows of it.

    Windows whose frames grow by a row at a time (over the reversed order) or hold reach rows, so a key's rows are passed in linear time; a key's quantile holds its distinct values."""
    level = signal.groupBy(key).agg(F.percentile(value, share).alias("_level"))
    marks = lambda df, name: df.select(key, order).distinct().withColumn(name, F.lit(True))
    rows = signal.select(key, order, value).join(marks(peaks_, "_peak"), [key, order], "left").join(marks(troughs, "_trough"), [key, order], "left").join(level, key)
    at = F.struct(F.col(order).alias("at"), F.col(value).alias("v"))
    back, w = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0), windows.by(key, order)
    rows = rows.withColumn("_next", F.last(F.when(F.col("_trough") & (F.col(value) < F.col("_level")), at), True).over(back))
    low = F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(order).alias("at")))).over(w.rowsBetween(0, reach))
    rows = rows.withColumn("_first", F.lead("_next", gap + 1).over(w)).withColumn("_low", low).where("_peak")
    found = F.col("_first").isNotNull()
    end = F.when(found, F.col("_first.at")).otherwise(F.col("_low.at"))
    return rows.select(key, order, end.alias("end"), F.when(found, "trough").otherwise("lowest").alias("found"), F.col(value).alias("peak_value"), F.when(found, F.col("_first.v")).otherwise(F.col("_low.v")).alias("end_value"))


def first_troughs(y: np.ndarray, apart: int, prominence: float, gap: int, reach: int, share: float = 0.6) -> list[tuple[int, int]]:
    """Places of each peak and its trough, as peak_troughs pairs them, of one signal (NaN: no value). Troughs are half as far apart as peaks, of any depth."""
    has = np.nonzero(~np.isnan(y))[0]
    if not len(has):
        return []
    known = y[has]
    tops, lows = has[find(known, apart, prominence)[0]], has[find(-known, max(apart // 2, 10))[0]]
    ranked, at = np.sort(known), (len(known) - 1) * share
    a, b = ranked[math.floor(at)], ranked[math.ceil(at)]
    lows = lows[y[lows] < (a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b)]
    later = np.searchsorted(lows, tops + gap, "right")
    return [(int(p), int(lows[k]) if k < len(lows) else int(p + np.nanargmin(y[p : p + reach + 1]))) for p, k in zip(tops, later)]


def peak_first(df: DataFrame, key: str, order: str, value: str, speed: str, fps: float, scale: float, least_rows: int = 30, seconds: tuple[float, float] = (0.2, 7.5), least_cm: float = 8.0, prominence: float = 12.0) -> DataFrame:
    """(key, start, end, duration_s, rom_cm, mcv, pv): repetitions from each peak of value to its trough. Peaks are apart half a second, or 20 rows if that is more, and prominent;
    troughs are half as far apart. mcv is the mean of the positive speeds before the end (0: none), pv the largest one. Keys of fewer rows, and a null key, have none.

    As peaks are found over a key's whole signal in one task, its repetitions are taken there, too: joins of the peaks, troughs and spans with the signal would
    shuffle all rows four times. Rows that are dealt by key are not shuffled."""
    apart, kinds = max(int(fps * 0.5), 20), dict(df.dtypes)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order)
        out, place, y, v = [], f[order].to_numpy(), f[value].to_numpy(float), f[speed].to_numpy(float)
        for p, t in first_troughs(y, apart, prominence, int(fps * 0.15), max(int(fps * 3.0), 60)) if len(f) >= least_rows else []:
            took, rom = (place[t] - place[p]) / fps, abs(y[t] - y[p]) * scale * 100.0
            if seconds[0] <= took <= seconds[1] and rom >= least_cm:
                own = v[p:t][~np.isnan(v[p:t])]
                up = own[own > 0]
                out.append((f[key].iloc[0], place[p], place[t], took, rom, up.mean() if len(up) else 0.0, own.max() if len(own) else None))
        return pd.DataFrame(out, columns=[key, "start", "end", "duration_s", "rom_cm", "mcv", "pv"])

    rows = df.where(F.col(key).isNotNull()).select(key, order, value, speed)
    return rows.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, start {kinds[order]}, end {kinds[order]}, duration_s double, rom_cm double, mcv double, pv double")


def trailing_event(events: DataFrame, ends: DataFrame, key: str, order: str, fps: float, scale: float, seconds: tuple[float, float], least_rom: float) -> DataFrame:
    """events (key, order, kind b or t, value) with one more t where a key's last event is a b, at its last row (ends: key, order, value), if that lasts and climbs enough."""
    last = events.groupBy(key).agg(F.max(F.struct(order, "kind", "value")).alias("l"))
    e = ends.select(key, F.col(order).alias("_at"), F.col("value").alias("_v")).join(last, key)
    took = (F.col("_at") - F.col(f"l.{order}")) / fps
    more = e.where((F.col("l.kind") == "b") & took.between(*seconds) & ((F.col("l.value") - F.col("_v")) * scale >= least_rom))
    return events.unionByName(more.select(key, F.col("_at").alias(order), F.lit("t").alias("kind"), F.col("_v").alias("value")))


def repetitions(df: DataFrame, key: str, order: str, value: str, fps: float, scale: float, window: int = 15, clean: int = 30, max_gap: int = 10, prominence: float = 12.0, seconds: tuple[float, float] = (0.25, 4.5), least_rom: float = 0.012, keep: float = 0.45, least_speed: float = 0.10) -> DataFrame:
    """The older rule over y in pixels, downwards: small gaps filled, the longest clean run smoothed, peaks merged, bottoms paired with the tops that follow, gates by
    duration, range and speed, then by the video's largest range: (key, start, end, rom, mcv, mcv_pos, mcv_mid, pv)."""
    filled = windows.interpolate(df.select(key, order, value), key, order, value, max_gap, hold_edges=False).select(key, order, F.col(f"{value}_filled").alias("y"))
    run = windows.longest_run(filled, key, order, F.col("y").isNotNull(), clean).select(key, F.col("start").alias("_a"), F.col("end").alias("_z"))
    inside = filled.join(run, key).where(F.col(order).between(F.col("_a"), F.col("_z"))).select(key, order, "y")
    s = savgol(savgol(inside, key, order, "y", window, 3), key, order, "y", window, 3, 1, "_d").select(key, order, F.round("smooth", 9).alias("smooth"), (-F.col("_d") * fps * scale).alias("v"))  # equal tops are equal whatever the order of sums
    near, apart = int(fps * seconds[0]), max(6, int(fps * 0.33))
    events = None
    for kind, sign in (("b", 1), ("t", -1)):
        found = peaks(s.select(key, F.col(order).cast("long").alias(order), (sign * F.col("smooth")).alias("height_in")), key, order, "height_in", near, prominence).select(key, order, "height")
        part = folds.merge_peaks(found, key, order, "height", apart).select(key, order, F.lit(kind).alias("kind"), (sign * F.col("height")).alias("value"))
        events = part if events is None else events.unionByName(part)
    ends = s.groupBy(key).agg(F.max(F.struct(F.col(order).cast("long").alias(order), F.col("smooth").alias("value"))).alias("l")).select(key, "l.*")
    events = trailing_event(events, ends, key, order, fps, scale, seconds, least_rom)
    pairs = windows.event_pairs(events, key, order, "kind", "b", "t").withColumn("rom", F.abs(F.col("to_value") - F.col("from_value")) * scale).where(((F.col("end") - F.col("start")) / fps).between(*seconds) & (F.col("rom") >= least_rom))
    from kinetia.operators.metrics import rep_velocities

    speeds = rep_velocities(s, pairs, key, order, "v")
    gated = windows.relative_gate(pairs.select(key, "start", "end", "rom").join(speeds, [key, "start", "end"]), key, "rom", keep, least_rom)
    return gated.where(F.col("mcv") >= least_speed)
