"""NumPy kernels for iterative geometry, one frame or session at a time."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fathomline.functions.ship import shipped
from fathomline.operators.registration import nearest


def rect_polygon(cx: float, cy: float, w: float, l: float, angle: float) -> np.ndarray:
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    corners = np.array([(-w / 2, -l / 2), (w / 2, -l / 2), (w / 2, l / 2), (-w / 2, l / 2)])
    return corners @ np.array([[c, s], [-s, c]]) + (cx, cy)


def area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def clip(subject: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Intersection of convex polygons given counter-clockwise."""
    for a, b in zip(by, np.roll(by, -1, axis=0), strict=True):
        if not len(subject):
            break
        side = (b[0] - a[0]) * (subject[:, 1] - a[1]) - (b[1] - a[1]) * (subject[:, 0] - a[0])
        out = []
        for k in range(len(subject)):
            p, q, sp, sq = subject[k], subject[(k + 1) % len(subject)], side[k], side[(k + 1) % len(subject)]
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                out.append(p + (q - p) * sp / (sp - sq))
        subject = np.array(out) if out else np.zeros((0, 2))
    return subject


def rect_iou(a: tuple, b: tuple) -> float:
    p, q = rect_polygon(*a), rect_polygon(*b)
    c = clip(p, q)
    common = area(c) if len(c) > 2 else 0.0
    return common / (area(p) + area(q) - common)


def rect_ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap of many pairs of rectangles (cx, cy, w, l, angle) at once.

    The common part of two convex outlines has as corners those of either that lie in the other, and the
    crossings of their edges; ordered around their middle they give its area.
    """

    def corners(r):
        c, s = np.cos(np.radians(r[:, 4])), np.sin(np.radians(r[:, 4]))
        u, v = r[:, 2:3] / 2 * (-1, 1, 1, -1), r[:, 3:4] / 2 * (-1, -1, 1, 1)
        return np.stack([r[:, :1] + u * c[:, None] - v * s[:, None], r[:, 1:2] + u * s[:, None] + v * c[:, None]], axis=2)

    def inside(p, r):
        c, s = np.cos(np.radians(r[:, 4]))[:, None], np.sin(np.radians(r[:, 4]))[:, None]
        d = p - r[:, None, :2]
        u, v = d[..., 0] * c + d[..., 1] * s, d[..., 1] * c - d[..., 0] * s
        return (abs(u) <= r[:, 2:3] / 2 + 1e-9) & (abs(v) <= r[:, 3:4] / 2 + 1e-9)

    if not len(a):
        return np.zeros(0)
    p, q = corners(a), corners(b)
    e, f = np.roll(p, -1, axis=1) - p, np.roll(q, -1, axis=1) - q
    cross = lambda x, y: x[..., 0] * y[..., 1] - x[..., 1] * y[..., 0]
    span = cross(e[:, :, None], f[:, None])
    gap = q[:, None] - p[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(gap, f[:, None]) / span, cross(gap, e[:, :, None]) / span
    met = (abs(span) > 1e-12) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    points = np.concatenate([p, q, (p[:, :, None] + np.where(met, t, 0)[..., None] * e[:, :, None]).reshape(len(a), 16, 2)], axis=1)
    ok = np.concatenate([inside(p, b), inside(q, a), met.reshape(len(a), 16)], axis=1)
    n = np.maximum(ok.sum(axis=1), 1)
    middle = (points * ok[..., None]).sum(axis=1) / n[:, None]
    d = np.where(ok[..., None], points - middle[:, None], 0.0)
    order = np.argsort(np.where(ok, np.arctan2(d[..., 1], d[..., 0]), np.inf), axis=1, kind="stable")
    d = np.take_along_axis(d, order[..., None], axis=1)
    last = np.arange(24)[None, :] >= ok.sum(axis=1)[:, None]
    d = np.where(last[..., None], d[:, :1], d)  # places that are no corner repeat the first one
    common = abs(cross(d, np.roll(d, -1, axis=1)).sum(axis=1)) / 2 * ok.any(axis=1)
    return common / (a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - common)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull without points on its edges."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    rows = pts.tolist()
    return np.array(half(rows) + half(rows[::-1]))


def smallest_rect(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """The smallest rectangle round points: centre, short and long side, axis of the short side in degrees of [0, 180).

    One of its sides lies along an edge of the hull.
    """
    hull = convex_hull(points)
    if len(hull) < 3:
        middle, span = hull.mean(axis=0), hull[-1] - hull[0]
        return float(middle[0]), float(middle[1]), 0.0, float(np.hypot(*span)), float((math.degrees(math.atan2(span[1], span[0])) + 90) % 180)
    edges = np.roll(hull, -1, axis=0) - hull
    best = None
    for angle in np.unique(np.arctan2(edges[:, 1], edges[:, 0]) % (math.pi / 2)):
        c, s = math.cos(angle), math.sin(angle)
        turned = hull @ np.array([[c, -s], [s, c]])
        low, high = turned.min(axis=0), turned.max(axis=0)
        w, l = high - low
        if best is None or w * l < best[0] - 1e-12:
            x, y = (low + high) / 2
            best = (w * l, c * x - s * y, s * x + c * y, w, l, math.degrees(angle))
    _, cx, cy, w, l, angle = best
    return (float(cx), float(cy), float(w), float(l), angle % 180) if w <= l else (float(cx), float(cy), float(l), float(w), (angle + 90) % 180)


def connected_cells(cells: np.ndarray) -> list[np.ndarray]:
    """The parts of a set of raster cells that touch by side or corner."""
    left, out = set(map(tuple, cells.tolist())), []
    while left:
        part, waiting = [], [left.pop()]
        while waiting:
            u, v = waiting.pop()
            part.append((u, v))
            for near in itertools.product((u - 1, u, u + 1), (v - 1, v, v + 1)):
                if near in left:
                    left.discard(near)
                    waiting.append(near)
        out.append(np.array(sorted(part), float))
    return sorted(out, key=lambda p: p[0].tolist())


def suppress(boxes: list[tuple], scores: list[float], iou: float = 0.35, centre: float = 1.0, most: int | None = None) -> list[int]:
    """Greedy suppression by score: indices kept."""
    kept: list[int] = []
    for k in sorted(range(len(boxes)), key=lambda k: (-scores[k], k)):
        if all(math.dist(boxes[k][:2], boxes[j][:2]) >= centre and rect_iou(boxes[k], boxes[j]) <= iou for j in kept):
            kept.append(k)
            if most and len(kept) >= most:
                break
    return kept


def fit_plane(points: np.ndarray, tolerance: float = 0.08, tilt_deg: float = 20.0, least: int = 80, rounds: int = 200, seed: int = 42) -> tuple[float, float, float, float] | None:
    """Upward unit normal and offset of the plane with the most inliers, refined by least squares; None without one."""
    if len(points) < max(3, least):
        return None
    rng = np.random.default_rng(seed)
    best, best_n = None, 0
    steep = math.cos(math.radians(tilt_deg))
    for _ in range(rounds):
        a, b, c = points[rng.choice(len(points), 3, replace=False)]
        n = np.cross(b - a, c - a)
        size = np.linalg.norm(n)
        if size < 1e-9 or abs(n[2]) / size < steep:
            continue
        n = n / size * np.sign(n[2])
        inside = np.abs(points @ n - a @ n) <= tolerance
        if inside.sum() > best_n:
            best, best_n = inside, int(inside.sum())
    if best is None or best_n < least:
        return None
    centre = points[best].mean(axis=0)
    n = np.linalg.eigh(np.cov((points[best] - centre).T))[1][:, 0]
    n = n * (1 if n[2] >= 0 else -1)
    return None if n[2] < steep else (float(n[0]), float(n[1]), float(n[2]), float(-centre @ n))


def neighbour_counts(points: np.ndarray, asked: np.ndarray, radius: float) -> np.ndarray:
    """How many points lie within the radius of each asked one; points meet by grid cells."""
    low = np.floor(points.min(axis=0) / radius).astype(np.int64) - 2
    cells, own = (np.floor(x / radius).astype(np.int64) - low for x in (points, asked))
    span = np.maximum(cells.max(axis=0), own.max(axis=0)) + 3
    weight = np.array([span[1] * span[2], span[2], 1])
    order = np.argsort(cells @ weight, kind="stable")
    key, out = (cells @ weight)[order], np.zeros(len(asked), np.int64)
    for shift in itertools.product((-1, 0, 1), repeat=3):
        want = (own + shift) @ weight
        lo, hi = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
        n = hi - lo
        who = np.repeat(np.arange(len(asked)), n)
        at = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        out += np.bincount(who[np.linalg.norm(asked[who] - points[at], axis=1) <= radius], minlength=len(asked))
    return out


def remove_water(frames: DataFrame, clearance: float = 0.25, band: float = 1.0, radius: float = 0.35, neighbours: int = 2, fallback: int = 15, **plane) -> DataFrame:
    """frames (key, frame, ts, x, y, z) -> the points above the water; a lost plane is remembered for some frames."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, known, age = [], None, 0
        for _, f in pdf.sort_values("ts", kind="stable").groupby("frame", sort=False):
            p = f[["x", "y", "z"]].to_numpy(float)
            ok = np.isfinite(p).all(axis=1)
            found = fit_plane(p[ok], **plane)
            if found is not None:
                known, age = found, 0
            elif known is not None:
                age += 1
                if age > fallback:
                    known = None
            if known is None:
                out.append(f[ok])
                continue
            h = p @ np.array(known[:3]) + known[3]
            keep = ok & (h > clearance)
            low = keep & (h <= clearance + band)
            if neighbours > 0 and low.any():
                counts = neighbour_counts(p[keep], p[low], radius) - 1
                keep[np.flatnonzero(low)[counts < neighbours]] = False
            out.append(f[keep])
        return pd.concat(out)[["key", "frame", "ts", "x", "y", "z"]]

    return shipped(frames).groupBy("key").applyInPandas(run, "key long, frame long, ts double, x double, y double, z double")


def rigid_fit_2d(source: np.ndarray, target: np.ndarray) -> tuple[float, float, float]:
    """Angle and translation that carry source onto target with the least squares."""
    a, b = source.mean(axis=0), target.mean(axis=0)
    s, t = source - a, target - b
    yaw = math.atan2(float((s[:, 0] * t[:, 1] - s[:, 1] * t[:, 0]).sum()), float((s * t).sum()))
    c, n = math.cos(yaw), math.sin(yaw)
    return yaw, float(b[0] - (c * a[0] - n * a[1])), float(b[1] - (n * a[0] + c * a[1]))


def icp_2d(source: np.ndarray, target: np.ndarray, reach: float = 3.0, rounds: int = 20, translation_only: bool = True, start: tuple[float, float] = (0.0, 0.0)) -> dict:
    """Iterated closest points in the plane: yaw, tx, ty, rmse and the share of matched points."""
    yaw, (tx, ty) = 0.0, start
    moved, rmse, match = source + start, math.inf, 0.0
    for _ in range(rounds):
        at, d = nearest(target, moved, reach)
        ok = at >= 0
        match = float(ok.mean()) if len(ok) else 0.0
        if ok.sum() < 3:
            break
        if translation_only:
            dyaw, (dx, dy) = 0.0, np.median(target[at[ok]] - moved[ok], axis=0)
        else:
            dyaw, dx, dy = rigid_fit_2d(moved[ok], target[at[ok]])
        c, s = math.cos(dyaw), math.sin(dyaw)
        moved = moved @ np.array([[c, s], [-s, c]]) + (dx, dy)
        yaw, tx, ty = yaw + dyaw, c * tx - s * ty + dx, s * tx + c * ty + dy
        rmse = float(np.sqrt(np.mean(np.sort(d[ok])[: math.ceil(0.9 * ok.sum())] ** 2)))
        if math.hypot(dx, dy) < 1e-4 and abs(dyaw) < 1e-5:
            break
    return {"yaw": yaw, "tx": float(tx), "ty": float(ty), "rmse": rmse, "match": match}


def common_shift(source: np.ndarray, target: np.ndarray, reach: float, voters: int = 2000, bins: int = 40) -> tuple[float, float]:
    """The shift within ``reach`` that most pairs of a source point (``voters`` of them, at even steps) and a target agree on; twice, finer the second time."""
    votes = source[np.arange(min(voters, len(source))) * len(source) // min(voters, len(source))]
    size, middle, wide = max(1, 2_000_000 // len(target)), np.zeros(2), reach
    for _ in range(2):
        step, seen = wide / bins, np.zeros((2 * bins + 2, 2 * bins + 2))
        for k in range(0, len(votes), size):
            d = (target[None, :, :] - votes[k : k + size, None, :]).reshape(-1, 2) - middle
            at = np.floor(d[(np.abs(d) <= wide).all(axis=1)] / step).astype(np.int64) + bins
            np.add.at(seen, (at[:, 0], at[:, 1]), 1)
        around = seen[:-1, :-1] + seen[1:, :-1] + seen[:-1, 1:] + seen[1:, 1:]  # a shift at the edge of a bin falls on both sides
        best = np.array(np.unravel_index(np.argmax(around), around.shape))
        middle, wide = middle + (best + 1 - bins) * step, 2 * step
    return float(middle[0]), float(middle[1])


def register_maps(points: DataFrame, **options) -> DataFrame:
    """points (key, side 's' or 't', x, y) -> key, yaw, tx, ty, rmse, match by closest points.

    Dense maps hold closest points to the start, so shifts start from the one most pairs agree on as well; the better end counts.
    """

    def solved(s: np.ndarray, t: np.ndarray) -> dict:
        found = icp_2d(s, t, **options)
        if not options.get("translation_only", True):
            return found
        other = icp_2d(s, t, **options, start=common_shift(s, t, options.get("reach", 3.0)))
        return min(found, other, key=lambda r: r["rmse"] + 5.0 * (1 - r["match"]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, t = (pdf.loc[pdf.side == k, ["x", "y"]].to_numpy(float) for k in "st")
        found = solved(s, t) if len(s) and len(t) else {"yaw": 0.0, "tx": 0.0, "ty": 0.0, "rmse": math.inf, "match": 0.0}
        return pd.DataFrame([{"key": pdf.key.iloc[0], **found}])

    return shipped(points).groupBy("key").applyInPandas(run, "key long, yaw double, tx double, ty double, rmse double, match double")


class ConstantVelocityFilter:
    """Position and velocity in three axes; the covariance update keeps its symmetric form."""

    def __init__(self, sigma: float = 1.0, accel: float = 0.5):
        self.x, self.p, self.accel = np.zeros(6), np.eye(6) * sigma, accel

    def predict(self, dt: float) -> None:
        f = np.eye(6)
        f[:3, 3:] = np.eye(3) * dt
        g = np.vstack([np.eye(3) * dt * dt / 2, np.eye(3) * dt])
        self.x = f @ self.x
        self.p = f @ self.p @ f.T + g @ g.T * self.accel**2

    def update(self, z: np.ndarray, sigma: float, gate: float = 36.0) -> bool:
        h = np.hstack([np.eye(3), np.zeros((3, 3))])
        r = np.eye(3) * sigma**2
        s = h @ self.p @ h.T + r
        y = z - h @ self.x
        if float(y @ np.linalg.solve(s, y)) > gate:
            return False
        k = self.p @ h.T @ np.linalg.inv(s)
        a = np.eye(6) - k @ h
        self.x = self.x + k @ y
        self.p = a @ self.p @ a.T + k @ r @ k.T
        return True


class PoseFilter:
    """Position, attitude, velocity and turn rate in twelve states; roll and pitch are frozen at zero.

    The covariance update keeps its symmetric form, and angles are wrapped where they are compared.
    """

    def __init__(self, sigma: float = 1.0, accel: float = 0.5, turn: float = 0.2):
        self.x, self.p, self.accel, self.turn = np.zeros(12), np.eye(12) * sigma, accel, turn

    def _freeze(self) -> None:
        for k in (3, 4, 9, 10):
            self.x[k] = 0.0
            self.p[k, :] = self.p[:, k] = 0.0

    def predict(self, dt: float) -> None:
        f = np.eye(12)
        f[:6, 6:] = np.eye(6) * dt
        g = np.vstack([np.eye(6) * dt * dt / 2, np.eye(6) * dt])
        q = np.diag([self.accel**2] * 3 + [self.turn**2] * 3)
        self.x, self.p = f @ self.x, f @ self.p @ f.T + g @ q @ g.T
        self._freeze()

    def update(self, position: np.ndarray, yaw: float, noise: np.ndarray, gate: float = 36.0) -> bool:
        """A measured position and yaw (radians) with their 4x4 covariance; False where it is too far off."""
        h = np.zeros((4, 12))
        h[:3, :3] = np.eye(3)
        h[3, 5] = 1.0
        y = np.concatenate([position - self.x[:3], [(yaw - self.x[5] + math.pi) % (2 * math.pi) - math.pi]])
        s = h @ self.p @ h.T + noise
        if float(y @ np.linalg.solve(s, y)) > gate:
            return False
        k = self.p @ h.T @ np.linalg.inv(s)
        a = np.eye(12) - k @ h
        self.x = self.x + k @ y
        self.p = a @ self.p @ a.T + k @ noise @ k.T
        self._freeze()
        return True


def smooth_track(rows: DataFrame, sigma: float = 1.0) -> DataFrame:
    """rows (key, ts, x, y, z) -> filtered position and whether the measurement was taken."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f, last, out = ConstantVelocityFilter(), None, []
        for r in pdf.sort_values("ts", kind="stable").itertuples(index=False):
            z = np.array([r.x, r.y, r.z])
            if last is None:
                f.x[:3] = z
                taken = True
            else:
                f.predict(max(r.ts - last, 0.0))
                taken = f.update(z, sigma)
            last = r.ts
            out.append((r.key, r.ts, *f.x[:3], taken))
        return pd.DataFrame(out, columns=["key", "ts", "x", "y", "z", "taken"])

    return shipped(rows).groupBy("key").applyInPandas(run, "key long, ts double, x double, y double, z double, taken boolean")
