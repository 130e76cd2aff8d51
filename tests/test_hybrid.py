"""The hybrid tracker against a plain form of its rules, written as one loop over one video's frames."""

import math
import random
import statistics
from collections import Counter

import pytest

from kinetia.operators import hybrid

BOX = "k string, f long, pos long, cx double, cy double, w double, h double, conf double, match double"
FIT = "k string, f long, fx double, fy double, score double"


def gate(b, width, height):
    x, y, w, h, conf = b[:5]
    return conf > 0 and 0.03 * width < x < 0.97 * width and 0.03 * height < y < 0.97 * height and 0.03 <= h / height <= 0.15 and max(w / h, h / w) <= 1.6


def plain(frames, width, height):
    """frames: (boxes (cx, cy, w, h, conf, match), fit (x, y, score) or None) in order. (src, x, y, size, turn, adopted, locked size) of each."""
    out, s, pend, clusters, ref = [], None, [], [], None
    dist = lambda a, b, c, d: math.hypot(a - c, b - d)
    for n, (boxes, fit) in enumerate(frames, 1):
        found = [b for b in boxes if b[4] >= 0.3]
        if s is None:
            if n <= 90:
                free = [b for b in found if gate(b, width, height)]
                for p in pend:
                    close = sorted((dist(b[0], b[1], *p["at"][-1][:2]), free.index(b)) for b in free)
                    if close and close[0][0] < 40:
                        p["at"].append(free.pop(close[0][1]))
                        p["miss"] = 0
                    else:
                        p["miss"] += 1
                pend = [p for p in pend if p["miss"] <= 5] + [{"at": [b], "miss": 0} for b in free]
                ready = sorted((p for p in pend if len(p["at"]) >= 5), key=lambda p: (-statistics.pstdev(b[1] for b in p["at"]), -p["at"][-1][4]))
                if ready:
                    b = ready[0]["at"][-1]
                    s = {"x": b[0], "y": b[1], "h": b[3], "v": 0.0, "m": 0, "src": "boot", "first": n, "sizes": [b[3]], "still": [], "locked": False}
                    ref = ["down", b[1], b[1], False, 0]  # phase, top or bottom, extreme, armed, run
                    out.append(("boot", b[0], b[1], b[3], None, False, b[3]))
                    continue
            out.append(("none", None, None, None, None, False, None))
            continue
        adopted = smooth = False
        chosen, turn = None, None
        detect = n % 15 == 0 or s["m"] > 8
        if detect:
            goal = s["y"] + s["v"] * (s["m"] + 1)
            for b in sorted((b for b in found if dist(b[0], b[1], s["x"], goal) < 150), key=lambda b: dist(b[0], b[1], s["x"], goal))[:2]:
                if chosen is None and (s["m"] > 2 or b[5] >= 0.5):
                    chosen = b
            for b in found:
                c = next((c for c in clusters if dist(b[0], b[1], *c["c"]) < 60), None)
                if c is None:
                    c = {"c": b[:2], "o": []}
                    clusters.append(c)
                c["c"] = (0.7 * b[0] + 0.3 * c["c"][0], 0.7 * b[1] + 0.3 * c["c"][1])
                c["o"].append((n, b[1], b[3]))
            for c in clusters:
                c["o"] = [o for o in c["o"] if o[0] >= n - 90]
            clusters = [c for c in clusters if c["o"]]
            for c in clusters:
                if len(c["o"]) >= 4 and statistics.pstdev(o[1] for o in c["o"]) > 40 and abs(c["o"][-1][1] - s["y"]) > 60:
                    s |= {"x": c["c"][0], "y": c["c"][1], "h": c["o"][-1][2], "v": 0.0, "m": 0, "src": "adopt", "sizes": [c["o"][-1][2]]}
                    ref, clusters, adopted = ["down", s["y"], s["y"], False, 0], [], True
                    break
        if chosen is not None:
            bx, by, _, bh, conf, _ = chosen
            if s["m"] == 0:
                s["v"] = 0.7 * (by - s["y"]) + 0.3 * s["v"]
            old, h = s["y"], s["h"]
            side = lambda a, p, b, q: max(0.0, min(a + p / 2, b + q / 2) - max(a - p / 2, b - q / 2))
            both = side(s["x"], 1.4 * h, bx, 1.4 * bh) * side(s["y"], h, by, bh)
            if both / (1.4 * h * h + 1.4 * bh * bh - both) > 0.2:
                far = s["v"] * (s["m"] + 1)
                s |= {"x": 0.6 * bx + 0.4 * (s["x"] + far), "y": 0.6 * by + 0.4 * (s["y"] + far), "h": bh}
                way = "yolo"
            else:
                way = "reanchor" if conf > 0.65 else "yolo"
            if way == "reanchor":
                s |= {"x": bx, "y": by, "h": bh, "v": 0.0}
                ref = ["down", by, by, False, 0]
            else:
                if not s["locked"]:
                    s["still"].append(bh)
                    if len(s["still"]) >= 10 and (max(s["still"]) - min(s["still"]) > 0.5 * s["h"] or n - s["first"] >= 15):
                        s |= {"locked": True, "sizes": [statistics.median(s["still"])]}
                smooth = abs(s["y"] - old) <= max(15, bh / 4)
                if not smooth:
                    ref = ["down", s["y"], s["y"], False, 0]
            s |= {"m": 0, "src": way}
        elif adopted:
            s["m"] += 1
        else:
            s["m"] += detect
            good = fit is not None and fit[2] >= 0.45
            if good and dist(fit[0], fit[1], s["x"], s["y"]) <= max(15, s["h"] / 4):
                if s["m"] == 0:
                    s["v"] = 0.7 * (fit[1] - s["y"]) + 0.3 * s["v"]
                s |= {"x": fit[0], "y": fit[1], "m": 0, "src": "ncc"}
                smooth = True
            else:
                s["m"] += 1
                s["v"] *= 1 if good else 0.6
                s["src"] = "hold" if s["m"] <= 40 else "reject" if good else "miss"
        if smooth:
            r, y, fired = s["h"] / 2, s["y"], False
            if ref[0] == "up":
                ref[2] = min(ref[2], y)
                if ref[1] - ref[2] >= 1.5 * r:
                    ref = ["down", ref[2], ref[2], False, 0]
            elif y > ref[2]:
                ref = ["down", ref[1], y, ref[3] or y - ref[1] >= 1.5 * r, 0]
            elif ref[3]:
                ref[4] = ref[4] + 1 if ref[2] - y >= 0.3 * r else 0
                if ref[4] >= 4:
                    ref, fired = ["up", ref[2], y, False, 0], True
            if fired:
                r, best = max(10, r), None
                for b in boxes:
                    d = dist(b[0], b[1], s["x"], s["y"])
                    if b[4] >= 0.25 and d <= 4 * r and (best is None or d <= best[0]):
                        best = (d, b)
                turn = "reject" if best is None or (best[1][5] < 0.5 and best[1][4] < 0.5) else "micro" if best[0] < 0.2 * r else "snap"
                if turn == "snap":
                    b = best[1]
                    s |= {"x": b[0], "y": b[1], "h": b[3], "v": 0.0, "m": 0, "src": "regrind"}
                    s["sizes"].append(b[3])
        there = s["src"] not in ("reject", "miss")
        out.append((s["src"], s["x"] if there else None, s["y"] if there else None, s["h"], turn, adopted, statistics.median(s["sizes"])))
    return out


def video(seed, length=700):
    rng, frames, hidden, drift = random.Random(seed), [], 0, 0.0
    for n in range(1, length + 1):
        if hidden == 0 and rng.random() < 0.01:
            hidden = rng.choice([3, 12, 25, 60])
        y, x = 300 + 60 * math.sin(n / 25), 320.0
        drift = 0.0 if rng.random() < 0.03 else min(drift + 0.15, 14)
        boxes = [(560.0, 90 + rng.random(), 50.0, 50.0, 0.9, 0.1)]
        if rng.random() < 0.85:
            boxes.append((x + rng.gauss(0, 2), y + rng.gauss(0, 2), 50.0, 48 + rng.random() * 6, 0.1 if hidden else rng.uniform(0.2, 1), rng.random()))
        if seed % 3 == 0:
            boxes.append((200 + rng.random() * 3, 430 + 90 * math.sin(n / 40), 45.0, 45.0, rng.uniform(0.3, 1), rng.random()))
        if rng.random() < 0.05:
            boxes.append((x + rng.choice([-1, 1]) * rng.uniform(60, 120), y + rng.uniform(-60, 60), 50.0, 50.0, rng.uniform(0.3, 1), rng.random()))
        if seed % 5 == 4:
            boxes = boxes[:1] if n % 7 == 0 else []
        fit = None if rng.random() < 0.02 else (x, y + drift + (80 if rng.random() < 0.04 or hidden == 60 else 0), 0.2 if hidden and hidden % 5 else rng.uniform(0.4, 1))
        hidden = max(0, hidden - 1)
        frames.append((boxes, fit))
    return frames


@pytest.fixture(scope="module")
def videos():
    return {f"v{k}": video(k) for k in range(15)}


def tracked(spark, videos, **more):
    rows = [(k, n, i, *b) for k, fs in videos.items() for n, (bs, _) in enumerate(fs, 1) for i, b in enumerate(bs)]
    rows += [(k, n, 0, None, None, None, None, None, None) for k, fs in videos.items() for n, (bs, _) in enumerate(fs, 1) if not bs]
    fits = [(k, n, *f) for k, fs in videos.items() for n, (_, f) in enumerate(fs, 1) if f]
    return hybrid.hybrid(spark.createDataFrame(rows, BOX), spark.createDataFrame(fits, FIT), "k", "f", 640, 640, **more)


def test_every_frame_as_the_plain_form(spark, videos):
    out = tracked(spark, videos)
    got = {(r["k"], r["f"]): r for r in out.collect()}
    seen = Counter()
    for k, frames in videos.items():
        for n, (src, x, y, size, turn, adopted, scale) in enumerate(plain(frames, 640, 640), 1):
            r = got.pop((k, n))
            assert (r["src"], r["turn"], r["adopted"]) == (src, turn, adopted), (k, n)
            assert [r["x"], r["y"], r["size"]] == pytest.approx([x, y, size], abs=1e-9), (k, n)
            assert r["mpp"] == (None if scale is None else pytest.approx(0.45 / scale))
            seen.update({src: 1, f"turn {turn}": 1, "adopted": adopted})
    assert not got
    assert all(seen[s] for s in ("none", "boot", "yolo", "ncc", "reanchor", "adopt", "adopted", "hold", "miss", "reject", "regrind", "turn snap", "turn micro", "turn reject")), seen
    by = {r["k"]: r for r in hybrid.report(out, "k").collect()}
    assert by["v4"]["status"] == "NO_PLATE_DETECTED" and by["v4"]["coverage"] == 0 and by["v1"]["status"] == "TRACKED"
    for k in ("v1", "v3"):
        want = Counter(p[0] for p in plain(videos[k], 640, 640))
        assert by[k]["coverage"] == pytest.approx(sum(want[s] for s in ("ncc", "yolo", "boot", "regrind")) / 700)


def test_hint_nulls_repeats_and_empty(spark):
    boxes = [("a", n, p, x, 300.0 + (n if p else 0), 50.0, 50.0, 0.9, None) for n in range(1, 9) for p, x in ((0, 100.0), (1, 400.0))]
    boxes += [("a", 9, 0, None, None, None, None, None, None), (None, 1, 0, 5.0, None, 4.0, 4.0, 0.9, 1.0), ("a", 8, 2, 9.0, 9.0, 9.0, None, 0.9, 1.0), ("a", 8, 3, 9.0, 9.0, 9.0, 9.0, None, 1.0)]
    fits = [("a", 9, 405.0, 310.0, 0.8), ("a", 9, 401.0, 310.0, 0.8), ("a", 9, 100.0, 300.0, 0.7), ("a", 9, 1.0, 1.0, None), (None, 1, None, None, 0.9)]
    df, fit = spark.createDataFrame(boxes, BOX), spark.createDataFrame(fits, FIT)
    rows = hybrid.hybrid(df, fit, "k", "f", 640, 640).orderBy("f").collect()
    assert [r["src"] for r in rows if r["k"] == "a"] == ["none"] * 4 + ["boot"] + ["hold"] * 3 + ["ncc"] and rows[-1]["x"] == 401.0 and rows[-1]["score"] == 0.8
    assert [(r["f"], r["src"]) for r in rows if r["k"] is None] == [(1, "none")]
    hinted = hybrid.hybrid(df, fit, "k", "f", 640, 640, hint=(90.0, 300.0)).where("k = 'a' and f = 5").first()
    assert hinted["src"] == "boot" and hinted["x"] == 100.0
    assert hybrid.hybrid(df.limit(0), fit.limit(0), "k", "f", 640, 640).count() == 0
