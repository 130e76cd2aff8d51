"""Column functions: geometry, gates, classes, names. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plate diameters in metres by normalised name.
PLATES = {"45lb": 0.45, "25kg": 0.45, "20kg": 0.45, "35lb": 0.42, "25lb": 0.40, "15kg": 0.38, "10lb": 0.28, "10kg": 0.32}


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def letterbox(h: Column, w: Column, size: int) -> dict[str, Column]:
    """scale, nh, nw and offsets of an image fitted into a square."""
    scale = F.least(size / h, size / w)
    nh, nw = (h * scale).cast("int"), (w * scale).cast("int")
    return {"scale": scale, "nh": nh, "nw": nw, "dy": ((size - nh) / 2).cast("int"), "dx": ((size - nw) / 2).cast("int")}


def unletterbox(c: Column, offset: Column, scale: Column) -> Column:
    return (c - offset) / scale


def ratio(w: Column, h: Column) -> Column:
    """Long side to short side; 999 without area."""
    return F.when(F.least(w, h) <= 0, 999.0).otherwise(F.greatest(w, h) / F.least(w, h))


def corners(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Of two boxes given by corners; 0 without a union."""
    zero = F.lit(0.0)
    both = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union > 0, F.try_divide(both, union)).otherwise(0.0)


def anchor_score(cx: Column, cy: Column, w: Column, h: Column, conf: Column, width: float, height: float, margin: float = 0.03, low: float = 0.03, high: float = 0.15, most: float = 1.6) -> Column:
    """0 outside the gates (beyond the edge margin, height share, ratio), else confidence weighed by how central the box is on both axes."""
    within = lambda c, size: (c > size * margin) & (c < size * (1 - margin))
    off = lambda c, size: F.abs(c - size / 2) / (size / 2)
    inside, central = within(cx, width) & within(cy, height), F.greatest(F.lit(0.0), 1 - (off(cx, width) + off(cy, height)) / 2)
    return F.when(inside & (h / height).between(low, high) & (ratio(w, h) <= most), conf * (0.4 + 0.6 * central)).otherwise(0.0)


def metres_per_pixel(diameter: float, major: Column) -> Column:
    return F.when(major >= 2, diameter / major)


def step_seconds(now: Column, last: Column) -> Column:
    """Time steps; those that don't go forward count as a sixtieth of a second."""
    return F.when(now - last > 0, now - last).otherwise(1.0 / 60)


def usable_fps(fps: Column, usual: float = 30.0, low: float = 0.0, high: float | None = None) -> Column:
    """Frames a second; the usual number where there is none above low, or one above high."""
    fine = fps.isNotNull() & ~F.isnan(fps) & (fps > low)
    return F.when(fine if high is None else fine & (fps <= high), fps).otherwise(usual)


def video_error(n_frames: Column, least: int = 30) -> Column:
    """VIDEO_ERROR for a video of too few frames or an unknown number of them, else null."""
    return F.when(F.coalesce(n_frames, F.lit(0)) < least, "VIDEO_ERROR")


def frame_time(pts: Column, idx: Column, fps: Column) -> Column:
    """A frame's time: its own where that is positive, else by its number."""
    return F.when(pts > 0, pts).otherwise(idx / fps)


def load_band(kg: Column) -> Column:
    return F.when(kg <= 40, "light").when(kg >= 100, "heavy").otherwise("medium")


def frame_class(detected: Column, conf: Column, n_plates: Column, cy: Column, height: Column, brightness: Column) -> Column:
    return F.when(~detected, "no_detection").when(conf < 0.15, "occlusion").when(n_plates >= 2, "multi_plate").when(cy > 0.65 * height, "bottom").when(brightness < 80, "low_light").otherwise("normal")


def regrind_verdict(corr: Column, ncc: Column, conf: Column, r: Column, small: float = 0.2) -> Column:
    """What a correction at the bottom is: null where neither match nor confidence is trusted, micro below a small share of the radius, else snap."""
    return F.when(~((ncc >= 0.5) | (conf >= 0.5)), F.lit(None)).when(corr < small * r, "micro").otherwise("snap")


def plate_diameter(name: Column, specs: dict[str, float] = PLATES, default: float = 0.45) -> Column:
    table = F.create_map(*(F.lit(x) for kv in specs.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit(""))), F.lit(default))


def parse_name(filename: Column) -> tuple[Column, Column]:
    """Load and repetition velocities from `{load}kg_{r1}_{r2}.mp4`; nulls for other names."""
    pattern = r"^(\d+(?:\.\d+)?)kg((?:_\d+\.\d+)+)\.mp4$"
    reps = F.regexp_extract(filename, pattern, 2)
    return F.regexp_extract(filename, pattern, 1).try_cast("double"), F.when(reps != "", F.transform(F.split(F.substring(reps, 2, 1000), "_"), lambda x: x.cast("double")))


def safe_id(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_.-]", "_")


def short_hash(text: Column, kind: str = "sha256") -> Column:
    return F.left(F.sha2(text, 256), F.lit(16)) if kind == "sha256" else F.left(F.md5(text), F.lit(8))


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(77 * r + 150 * g + 29 * b + 128, 8)


def unrotate(cx: Column, cy: Column, width: Column) -> tuple[Column, Column]:
    """Centres in a frame that was turned by 90 degrees clockwise, from those in the turned one; width: of that."""
    return cy, width - cx


def boot_gate(w: Column, h: Column, frame_area: float) -> Column:
    """Boxes that a first detection may have: 0.1 to 30 % of the frame, height 0.2 to 3.5 times the width."""
    return (w * h).between(0.001 * frame_area, 0.30 * frame_area) & (h / F.greatest(w, F.lit(1e-6))).between(0.2, 3.5)


def round_gate(w: Column, h: Column, conf: Column) -> Column:
    return (ratio(w, h) <= 1.4) & (conf >= 0.35)


def candidate_score(cx: Column, cy: Column, w: Column, h: Column, conf: Column, width: float, height: float) -> Column:
    """Confidence weighed by a middling size and a central place."""
    size = F.when((h > 80) & (h < 350) & (w > 50) & (w < 400), 1.0).otherwise(0.2)
    central = F.greatest(F.lit(0.0), 1 - (F.abs(cx - width / 2) / (width / 2) + F.abs(cy - height / 2) / (height / 2)) / 2)
    return conf * (0.4 + 0.6 * size) * (0.5 + 0.5 * central)


def brightness_class(brightness: Column, deviation: Column) -> Column:
    return F.when(brightness < 80, "dark").when(brightness > 140, "bright").when(deviation < 3000, "low_contrast").otherwise("normal")


def plausible_speed(mcv: Column, low: float = 0.05, high: float = 2.5) -> tuple[Column, Column]:
    """Whether a mean velocity is outside the plausible range, and the velocity clipped to it."""
    return ~mcv.between(low, high), clip(mcv, low, high)


def in_crop(cx: Column, cy: Column, w: Column, h: Column, x0: Column, y0: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """A box's centre and sizes as shares of a crop at (x0, y0), after clipping to it."""
    cut = lambda c, size: F.greatest(F.lit(0.0), F.least(size, c))
    a, b, c, d = cut(cx - w / 2 - x0, width), cut(cy - h / 2 - y0, height), cut(cx + w / 2 - x0, width), cut(cy + h / 2 - y0, height)
    return (a + c) / 2 / width, (b + d) / 2 / height, (c - a) / width, (d - b) / height
