"""Ordered folds: logic whose next state depends on the rows before.

A fold runs per key inside ``applyInPandas``; keys are sessions, tracks or maps, and rows come in one
sort.  The same step functions serve the streaming operators.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame

from fathomline.functions.ship import shipped


def fold(df: DataFrame, keys: list[str], order: list[str], step: Callable[[Iterable, dict], Iterable[tuple]], schema: str) -> DataFrame:
    """``step`` gets the rows of a key in order and an empty state and yields output rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(step(pdf.sort_values(order, kind="stable").itertuples(index=False), {}))
        names = [c.split()[0] for c in schema.split(",")]
        return pd.DataFrame(rows, columns=names)

    return shipped(df).groupBy(*keys).applyInPandas(run, schema)


def keyframe_step(move: float = 0.5, turn_deg: float = 5.0):
    """A row becomes a keyframe when it moved or turned enough since the last keyframe."""

    def step(rows, state):
        last = None
        for r in rows:
            if last is not None:
                d = math.dist((r.x, r.y, r.z), (last.x, last.y, last.z))
                turn = abs((r.yaw - last.yaw + 180) % 360 - 180)
                if d <= move and turn <= turn_deg:
                    continue
            last = r
            yield (r.key, r.ts, r.x, r.y, r.z, r.yaw)

    return step


def select_keyframes(poses: DataFrame, move: float = 0.5, turn_deg: float = 5.0) -> DataFrame:
    """poses (key, ts, x, y, z, yaw) -> the keyframes among them."""
    return fold(poses, ["key"], ["ts"], keyframe_step(move, turn_deg), "key long, ts double, x double, y double, z double, yaw double")


def hysteresis_step(on: int = 10, off: int = 10):
    """Standby after ``on`` stable times, active again after ``off`` missing ones; repeated times count once
    and a time that runs back starts anew."""

    def step(rows, state):
        standby, run, last = False, 0, None
        for r in rows:
            if last is not None and r.ts < last - 1e-6:
                standby, run = False, 0
            elif last is not None and abs(r.ts - last) <= 1e-6:
                yield (r.key, r.seq, standby)
                continue
            last = r.ts
            wanted = bool(r.stable) != standby
            run = run + 1 if wanted else 0
            if run >= (off if standby else on):
                standby, run = not standby, 0
            yield (r.key, r.seq, standby)

    return step


def schedule_detection(rows: DataFrame, on: int = 10, off: int = 10) -> DataFrame:
    """rows (key, seq, ts, stable) -> key, seq, standby."""
    return fold(rows, ["key"], ["seq"], hysteresis_step(on, off), "key string, seq long, standby boolean")


def confirm_step(hits: int):
    def step(rows, state):
        n = 0
        for r in rows:
            n += 1
            if n == hits:
                yield (r.key, r.seq, n)

    return step


def confirmed(rows: DataFrame, hits: int = 5) -> DataFrame:
    """rows (key, seq): the row at which a key has been seen ``hits`` times."""
    return fold(rows, ["key"], ["seq"], confirm_step(hits), "key string, seq long, hits long")


def axis_mean(angles: list[float]) -> float:
    """Mean of undirected axes, in degrees of [0, 180)."""
    s, c = sum(math.sin(math.radians(2 * a)) for a in angles), sum(math.cos(math.radians(2 * a)) for a in angles)
    return math.degrees(math.atan2(s, c)) / 2 % 180


def axis_gap(a: float, b: float) -> float:
    d = (a - b) % 180
    return min(d, 180 - d)


def stability_step(window: int = 8, replace: int = 5, size_gate: float = 3.0, move_gate: float = 3.0, angle_gate: float = 13.0, reference: str = "last"):
    """Stable mean after ``window`` accepted frames; ``replace`` outliers in a row that agree among
    themselves take the place of the window; a missing frame clears the outliers."""

    def agrees(r, q) -> bool:
        straight = abs(r[2] - q[2]) + abs(r[3] - q[3])
        swapped = abs(r[2] - q[3]) + abs(r[3] - q[2])
        turn = axis_gap(r[4], q[4])
        sides = (straight <= size_gate and turn <= angle_gate) or (swapped <= size_gate and axis_gap(r[4] + 90, q[4]) <= angle_gate)
        return sides and math.dist(r[:2], q[:2]) <= move_gate

    def aligned(r, q):
        if abs(r[2] - q[3]) + abs(r[3] - q[2]) < abs(r[2] - q[2]) + abs(r[3] - q[3]) and axis_gap(r[4] + 90, q[4]) <= angle_gate:
            return (r[0], r[1], r[3], r[2], (r[4] + 90) % 180)
        return r

    def mean(xs):
        return (*(sum(x[k] for x in xs) / len(xs) for k in range(4)), axis_mean([x[4] for x in xs]))

    def step(rows, state):
        kept, odd, stable = [], [], None
        for r in rows:
            if r.cx is None or r.cx != r.cx:
                odd = []
                yield (r.key, r.seq, "missing", *(stable or (None,) * 5))
                continue
            x = (r.cx, r.cy, r.w, r.l, r.angle)
            against = (kept[-1] if reference == "last" else mean(kept)) if kept else None
            if against is None or agrees(x, against):
                kept = [*kept, aligned(x, against) if against else x][-window:]
                odd, what = [], "accepted"
            else:
                odd = [*odd, aligned(x, odd[-1])] if odd and agrees(x, odd[-1]) else [x]
                what = "outlier"
                if len(odd) >= replace:
                    kept, odd, what = odd[-window:], [], "replaced"
            if len(kept) >= window or what == "replaced":
                stable = mean(kept)
            yield (r.key, r.seq, what, *(stable or (None,) * 5))

    return step


STABILITY_SCHEMA = "key string, seq long, state string, cx double, cy double, w double, l double, angle double"


def stable_berths(rows: DataFrame, **options) -> DataFrame:
    """rows (key, seq, cx, cy, w, l, angle) -> state and stable geometry at each row."""
    return fold(rows, ["key"], ["seq"], stability_step(**options), STABILITY_SCHEMA)


def rate_gate_step(interval: float):
    def step(rows, state):
        last = None
        for r in rows:
            if last is None or r.ts - last >= interval:
                last = r.ts
                yield (r.key, r.ts)

    return step


def rate_limited(rows: DataFrame, interval: float = 0.5) -> DataFrame:
    """rows (key, ts): those at least ``interval`` after the last one passed."""
    return fold(rows, ["key"], ["ts"], rate_gate_step(interval), "key string, ts double")


def lru_step(budget: int):
    """A cache of tiles by bytes; the least recently used unpinned tile goes first."""

    def step(rows, state):
        sizes: dict[str, int] = {}
        for r in rows:
            hit = r.tile in sizes
            size = sizes.pop(r.tile, int(r.size))
            sizes[r.tile] = size
            gone = []
            while sum(sizes.values()) > budget:
                victim = next((t for t in sizes if t != r.tile and not (r.pinned or "").split(",").count(t)), None)
                if victim is None:
                    break
                gone.append(victim)
                del sizes[victim]
            yield (r.key, r.seq, r.tile, hit, ",".join(gone), ",".join(sizes))

    return step


def lru_trace(rows: DataFrame, budget: int) -> DataFrame:
    """rows (key, seq, tile, size, pinned) -> hit, evicted and resident tiles at each access."""
    return fold(rows, ["key"], ["seq"], lru_step(budget), "key string, seq long, tile string, hit boolean, evicted string, resident string")


#: Fixed value: observations are counted up to here.
MOST_OBSERVATIONS = 2**32 - 1


class BerthStore:
    """Berths of a map met in order: each joins the nearest known one of its kind, weighted by observations."""

    NAMES = ("id", "kind", "x", "y", "w", "l", "angle", "n")

    def __init__(self, known: list[list] | None = None, gate: float = 1.5, angle_gate: float = 20.0, size_gate: float = 0.35):
        self.known = [dict(zip(self.NAMES, k, strict=True)) for k in known or []]
        self.gate, self.angle_gate, self.size_gate = gate, angle_gate, size_gate

    def records(self) -> list[list]:
        return [[b[c] for c in self.NAMES] for b in self.known]

    def observe(self, r) -> dict | None:
        """The record that the row went to; rows that are not finite or have no size go nowhere."""
        if not all(math.isfinite(v) for v in (r.cx, r.cy, r.w, r.l, r.angle)) or r.w <= 0 or r.l <= 0:
            return None
        best, best_d = None, self.gate
        for b in self.known:
            d = math.hypot(r.cx - b["x"], r.cy - b["y"])
            close = abs(r.w - b["w"]) <= self.size_gate * b["w"] and abs(r.l - b["l"]) <= self.size_gate * b["l"]
            if b["kind"] == r.kind and d <= best_d and close and axis_gap(r.angle, b["angle"]) <= self.angle_gate and (best is None or d < best_d):
                best, best_d = b, d
        if best is None:
            best = {"id": r.id, "kind": r.kind, "x": r.cx, "y": r.cy, "w": r.w, "l": r.l, "angle": r.angle % 180, "n": r.n}
            self.known.append(best)
            return best
        share = r.n / (best["n"] + r.n)
        for k, v in (("x", r.cx), ("y", r.cy), ("w", r.w), ("l", r.l)):
            best[k] += (v - best[k]) * share
        turn = (r.angle - best["angle"] + 90) % 180 - 90
        best["angle"] = (best["angle"] + turn * share) % 180
        best["n"] = min(best["n"] + r.n, MOST_OBSERVATIONS)
        return best


def merge_step(**options):
    def step(rows, state):
        store, key = BerthStore(**options), None
        for r in rows:
            key = r.key
            store.observe(r)
        for b in store.records():
            yield (key, *b)

    return step


def merged_berths(rows: DataFrame, **options) -> DataFrame:
    """rows (key, seq, id, kind, cx, cy, w, l, angle, n) -> the merged berths of each key."""
    return fold(rows, ["key"], ["seq"], merge_step(**options), "key string, id long, kind int, cx double, cy double, w double, l double, angle double, n long")


class WorldLine:
    """A line of the world that holds once it was seen ``confirm`` times alike, and for good after ``lock`` times."""

    def __init__(self, confirm: int = 3, lock: int = 6, angle_gate: float = 8.0, offset_gate: float = 1.0):
        self.confirm, self.lock, self.angle_gate, self.offset_gate = confirm, lock, angle_gate, offset_gate
        self.line, self.seen, self.locked = None, 0, False
        self.other, self.others = None, 0  # a line that may take its place

    def _alike(self, a: tuple, b: tuple) -> bool:
        dx, dy = b[2] - b[0], b[3] - b[1]
        turn = axis_gap(math.degrees(math.atan2(a[3] - a[1], a[2] - a[0])), math.degrees(math.atan2(dy, dx)))
        off = (dx * ((a[1] + a[3]) / 2 - b[1]) - dy * ((a[0] + a[2]) / 2 - b[0])) / math.hypot(dx, dy)
        return turn <= self.angle_gate and abs(off) <= self.offset_gate

    def observe(self, line: tuple) -> None:
        if self.locked:
            return
        if not all(map(math.isfinite, line)) or math.hypot(line[2] - line[0], line[3] - line[1]) <= 1e-3:
            self.other, self.others, self.seen = None, 0, 0
        elif self.line is not None and self._alike(line, self.line):
            self.other, self.others, self.seen = None, 0, self.seen + 1
            self.locked = self.seen >= self.lock
        else:
            self.seen = 0
            again = self.other is not None and self._alike(line, self.other)
            self.other, self.others = (self.other, self.others + 1) if again else (line, 1)
            if self.others >= self.confirm:
                self.line, self.seen, self.other, self.others = self.other, self.confirm, None, 0


def line_step(**options):
    def step(rows, state):
        world = WorldLine(**options)
        for r in rows:
            world.observe((r.x1, r.y1, r.x2, r.y2))
            yield (r.key, r.seq, *(world.line or (None,) * 4), world.locked)

    return step


def world_lines(rows: DataFrame, **options) -> DataFrame:
    """rows (key, seq, x1, y1, x2, y2) -> the line that holds after each row, and whether it is locked."""
    return fold(rows, ["key"], ["seq"], line_step(**options), "key string, seq long, x1 double, y1 double, x2 double, y2 double, locked boolean")
