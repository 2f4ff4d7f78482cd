"""Moving things among the clusters of successive frames: association by registration, confirmation, removal."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.ship import shipped
from fathomline.operators.registration import nearest, thin

#: Points of a cluster that are compared, reach of a match, least matches and their share, ratio of sizes and gap of boxes.
POINTS, REACH, LEAST, SHARE, RATIO, GAP = 64, 1.5, 8, 0.35, 0.15, 4.0
#: Ratio and gaps at which a confirmed and a suspicious track are found again, and frames a track may miss.
AGAIN_RATIO, AGAIN_CONFIRMED, AGAIN_SUSPICIOUS, MISSED = 0.35, 1.5, 0.5, 6
#: Motion that counts as none, fastest velocity, speeds of a moving thing and of a steady one, frames that make it so, and marks that confirm.
STILL, FASTEST, MOVING, STEADY, STEADY_FRAMES, MARKS = 0.15, 5.0, 1.0, 0.5, 5, 4


@dataclass
class Track:
    points: np.ndarray
    count: int
    velocity: np.ndarray = field(default_factory=lambda: np.zeros(3))
    marks: int = 0
    confirmed: bool = False
    steady: int = 0
    missed: int = 0


def box_gap(a: np.ndarray, b: np.ndarray) -> float:
    """Distance between the bounding boxes of two clouds."""
    return float(np.linalg.norm(np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))))


def offset_between(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Mean offset of the matched points and the error that is left; None with too few matches before or after."""
    least = max(LEAST, math.ceil(SHARE * len(source)))
    at, _ = nearest(target, source, REACH)
    if (at >= 0).sum() < least:
        return None
    move = (target[at[at >= 0]] - source[at >= 0]).mean(axis=0)
    at, d = nearest(target, source + move, REACH)
    return (move, float(np.sqrt(np.mean(d[at >= 0] ** 2)))) if (at >= 0).sum() >= least else None


class DynamicTracker:
    def __init__(self):
        self.tracks: dict[int, Track] = {}
        self.following = 0

    def advance(self, clusters: list[tuple[int, np.ndarray]], dt: float) -> list[tuple[int, int, bool, bool]]:
        """clusters (id, points) -> (id, track, moving, confirmed); a confirmed track stays so."""
        ids, full = [c for c, _ in clusters], [np.asarray(p, float) for _, p in clusters]
        thinned = [thin(p, POINTS) for p in full]
        ahead = {k: t.points + t.velocity * dt for k, t in self.tracks.items()}
        ratio = lambda k, j: min(self.tracks[k].count, len(full[j])) / max(self.tracks[k].count, len(full[j]))
        found: dict[int, list] = {}
        for k, own in ahead.items():
            for j, p in enumerate(full):
                if ratio(k, j) >= RATIO and box_gap(own, p) <= GAP and (r := offset_between(own, thinned[j])) is not None:
                    found.setdefault(k, []).append((r[1], j, r[0]))
        taken: dict[int, tuple[int, np.ndarray]] = {}  # cluster -> track, offset
        for k in sorted(found, key=lambda k: min(x[0] for x in found[k])):
            for _, j, move in sorted(found[k], key=lambda x: x[:2]):
                if j not in taken:
                    taken[j] = (k, move)
                    break
        held = {k for k, _ in taken.values()}
        for k, own in ahead.items():  # those that registration lost
            t = self.tracks[k]
            reach = AGAIN_CONFIRMED if t.confirmed else AGAIN_SUSPICIOUS if t.marks >= 2 else -1.0
            near = [(box_gap(own, p), j) for j, p in enumerate(full) if k not in held and j not in taken and ratio(k, j) >= AGAIN_RATIO]
            near = [x for x in near if x[0] <= reach]
            if near:
                j = min(near)[1]
                taken[j] = (k, full[j].mean(axis=0) - own.mean(axis=0))
                held.add(k)
        out = []
        for j, p in enumerate(full):
            if j not in taken:
                k = self.following
                self.following += 1
                self.tracks[k] = Track(thinned[j], len(p))
                out.append((ids[j], k, False, False))
                continue
            k, move = taken[j]
            out.append((ids[j], k, self._moved(self.tracks[k], move, dt), self.tracks[k].confirmed))
            self.tracks[k].points, self.tracks[k].count, self.tracks[k].missed = thinned[j], len(p), 0
            held.add(k)
        for k in [k for k in ahead if k not in held]:
            self.tracks[k].missed += 1
            if self.tracks[k].missed > MISSED:
                del self.tracks[k]
        return out

    @staticmethod
    def _moved(t: Track, move: np.ndarray, dt: float) -> bool:
        """Takes a frame's motion into the track: whether it moves now."""
        before, total = t.velocity, t.velocity * dt + move
        if np.linalg.norm(total) <= STILL or dt <= 0:
            t.velocity = before / 2
        else:
            v = (before + total / dt) / 2
            speed = float(np.linalg.norm(v))
            t.velocity = v * min(1.0, FASTEST / speed) if speed > 0 else v
        speed, last = float(np.linalg.norm(t.velocity)), float(np.linalg.norm(before))
        same = speed >= STEADY and last > 0 and float(t.velocity @ before) / (speed * last) >= 0.5
        t.steady = t.steady + 1 if same else 0
        moving = speed > MOVING or t.steady >= STEADY_FRAMES
        t.marks = min(MARKS, t.marks + 1) if moving else max(0, t.marks - 1)
        t.confirmed = t.confirmed or t.marks >= MARKS
        return moving


def dynamic_clusters(points: DataFrame) -> DataFrame:
    """points (key, frame, ts, cluster, x, y, z) -> key, frame, cluster, track, moving, confirmed: a session is one fold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tracker, last, out = DynamicTracker(), None, []
        for (ts, frame), f in pdf.sort_values(["ts", "frame", "cluster", "x", "y", "z"]).groupby(["ts", "frame"], sort=True):
            clusters = [(int(c), g[["x", "y", "z"]].to_numpy(float)) for c, g in f.groupby("cluster", sort=True)]
            found = tracker.advance(clusters, 0.0 if last is None else float(ts) - last)
            last = float(ts)
            out += [(pdf.key.iloc[0], int(frame), *r) for r in found]
        return pd.DataFrame(out, columns=["key", "frame", "cluster", "track", "moving", "confirmed"])

    return shipped(points).groupBy("key").applyInPandas(run, "key long, frame long, cluster long, track long, moving boolean, confirmed boolean")


def without_moving(points: DataFrame) -> DataFrame:
    """The points of clusters that are not confirmed as moving."""
    gone = dynamic_clusters(points).filter(F.col("confirmed")).select("key", "frame", "cluster")
    return points.join(gone, ["key", "frame", "cluster"], "left_anti")
