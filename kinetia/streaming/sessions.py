"""Push sessions as Structured Streaming: steps that don't go forward are dropped, then repetitions are found as frames arrive.

State of a session is a few numbers and the rows that wait for their look-ahead. Rows must arrive in order of time within a
session, as a camera sends them; late ones (not beyond the last one kept) are dropped, which is the only rule for late data.
A session ends by timeout: then its waiting rows are forgotten, as an unfinished repetition is. With a timeout Spark plans
batches without data for as long as any session may time out, so a query triggered by availableNow would never end: such
runs over bounded input take timeout_ms=None, and keep their sessions for the next run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REP = "start_time double, end_time double, duration_s double, rom_m double, mcv_mps double, pcv_mps double"
OUT = f"video_id string, {REP}"
ENDED = f"video_id string, status string, n_frames long, n_reps long, {REP}"
STATE = "n long, phase string, start_t double, start_y double, top double, last_t double, last_y double, last_v double, t array<double>, y array<double>, v array<double>"
SESSION = f"n_frames long, n_reps long, scaled boolean, {STATE}"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def until(timeout_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout


class Machine:
    """The batch rule of squats or deadlifts, a row at a time. A row is judged once the rows it looks ahead to and least_rows rows in all are there."""

    def __init__(self, state: tuple | None, exercise: str, thresh: float, band: float, confirm: int, min_s: float, min_rom: float, step: float, least_rows: int):
        n, self.phase, t0, y0, self.top, *last, t, y, v = state or (0, "idle", 0.0, 0.0, -math.inf, 0.0, 0.0, 0.0, [], [], [])
        self.n, self.first, self.last = n, (t0, y0), tuple(last)
        self.waiting = list(zip(t, y, v))
        self.lift, self.thresh, self.band, self.confirm, self.min_s, self.min_rom, self.step, self.least_rows = exercise == "deadlift", thresh, band, confirm, min_s, min_rom, step, least_rows

    def push(self, t: float, y: float, v: float) -> list[tuple]:
        if self.waiting and t - self.waiting[-1][0] <= self.step:
            return []
        self.waiting.append((t, y, v))
        out = []
        while len(self.waiting) > max(2, self.confirm + 1) and self.n + len(self.waiting) >= self.least_rows:
            out += self.judge()
        return out

    def judge(self) -> list[tuple]:
        (t, y, v), ahead, out = self.waiting[0], [x[2] for x in self.waiting[1 : self.confirm + 1]], []
        if self.phase == "up":
            self.top = max(self.top, v)
        if self.n:  # the first row changes no state
            if self.phase == "idle":
                if self.lift and v > self.thresh and ahead[0] > self.thresh:
                    self.phase, self.first, self.top = "up", self.last[:2], max(self.last[2], v)
                elif not self.lift and v < -self.thresh:
                    self.phase = "down"
            elif self.phase == "down":
                if v >= -self.band and min(ahead) > self.band:
                    self.phase, self.first, self.top = "up", (t, y), v
            elif (v < self.band and ahead[0] < self.band) if self.lift else (v <= self.band and max(ahead) < -self.band):
                self.phase = "idle"
                took, rom = t - self.first[0], abs(y - self.first[1])
                if took >= self.min_s and rom >= self.min_rom:
                    out.append((self.first[0], t, took, rom, rom / took, self.top))
        self.n, self.last = self.n + 1, self.waiting.pop(0)
        return out

    def state(self) -> tuple:
        t, y, v = ([x[i] for x in self.waiting] for i in range(3))
        return (self.n, self.phase, *self.first, self.top, *self.last, t, y, v)


def repetitions(frames: DataFrame, exercise: str = "squat", thresh: float = 0.08, band: float = 0.02, confirm: int = 3, min_s: float = 0.20, min_rom: float = 0.12, step: float = 0.001, least_rows: int = 10, timeout_ms: int | None = 60_000) -> DataFrame:
    """Repetitions of a stream of (video_id, t, y, v), squats or deadlifts, as folds.repetitions finds them in a table."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine, out = Machine(state.get if state.exists else None, exercise, thresh, band, confirm, min_s, min_rom, step, least_rows), []
        for f in parts:
            for row in f.sort_values("t")[["t", "y", "v"]].itertuples(index=False):
                out += [(key[0], *rep) for rep in machine.push(*row)]
        state.update(machine.state())
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=names(OUT))

    return frames.groupBy("video_id").applyInPandasWithState(run, OUT, STATE, "append", until(timeout_ms))


def lifecycle(actions: DataFrame, exercise: str = "squat", least_frames: int = 5, timeout_ms: int | None = 60_000, **rule) -> DataFrame:
    """Sessions that are begun, fed and ended: a stream of (video_id, seq, action, t, y, v), action being init, frame or finalize, in order of seq within a batch and from batch to batch.

    A row comes for each repetition when it is found (status null), and one for each finalize: NOT_INITIALIZED where no session is open, NO_PLATE_DETECTED where none of its frames
    had a position (y null: no scale yet; such frames count, but take part in nothing), TOO_FEW_FRAMES below least_frames with a position, else OK, with the numbers of frames and
    repetitions. Frames outside a session are dropped, a second init begins anew, and a session without news for timeout_ms is forgotten. rule: thresholds as in repetitions()."""
    rule = {"thresh": 0.08, "band": 0.02, "confirm": 3, "min_s": 0.20, "min_rom": 0.12, "step": 0.001, "least_rows": 10} | rule

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n_all, n_reps, scaled, *inner = state.get if state.exists else (0, 0, False)
        machine, out = Machine(tuple(inner), exercise, **rule) if inner else None, []
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        for action, t, y, v in rows[["action", "t", "y", "v"]].itertuples(index=False):
            if action == "init":
                machine, n_all, n_reps, scaled = Machine(None, exercise, **rule), 0, 0, False
            elif action == "frame" and machine is not None:
                n_all += 1
                if y == y and y is not None:
                    scaled = True
                    found = machine.push(t, y, v)
                    n_reps += len(found)
                    out += [(key[0], None, None, None, *rep) for rep in found]
            elif action == "finalize":
                seen = 0 if machine is None else machine.n + len(machine.waiting)
                status = "NOT_INITIALIZED" if machine is None else "NO_PLATE_DETECTED" if not scaled else "TOO_FEW_FRAMES" if seen < least_frames else "OK"
                out.append((key[0], status, n_all if machine else 0, n_reps if machine else 0, *[None] * 6))
                machine = None
        if machine is not None:
            state.update((n_all, n_reps, scaled, *machine.state()))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names(ENDED)).astype({"n_frames": "Int64", "n_reps": "Int64"} | dict.fromkeys(names(REP), float))

    return actions.groupBy("video_id").applyInPandasWithState(run, ENDED, SESSION, "append", until(timeout_ms))


def statuses(frames: DataFrame, least: int = 5) -> DataFrame:
    """(video_id, n_frames, status) of each session so far, a native streaming count: TOO_FEW_FRAMES before least frames have come. A session without frames has no row: it isn't begun."""
    n = frames.groupBy("video_id").agg(F.count("*").alias("n_frames"))
    return n.withColumn("status", F.when(F.col("n_frames") < least, "TOO_FEW_FRAMES").otherwise("OK"))
