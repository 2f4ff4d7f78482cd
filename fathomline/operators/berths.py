"""Rectangles against rectangles: overlap, crossing, suppression, hulls and interval merges."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions import geo
from fathomline.functions.ship import shipped
from fathomline.operators import kernels, spatial


def _candidates(rects: DataFrame, size: float) -> DataFrame:
    """Pairs a.id < b.id whose bounding boxes overlap."""
    c, s = F.abs(F.cos(F.radians("angle"))), F.abs(F.sin(F.radians("angle")))
    hx, hy = F.col("w") / 2 * c + F.col("l") / 2 * s, F.col("w") / 2 * s + F.col("l") / 2 * c
    box = rects.withColumns({"min_x": F.col("cx") - hx, "max_x": F.col("cx") + hx, "min_y": F.col("cy") - hy, "max_y": F.col("cy") + hy})
    return spatial.boxes_overlapping(box, box, size).filter("id < r_id")


def overlapping_rects(rects: DataFrame, least: float, size: float = 25.0) -> DataFrame:
    """rects (id, cx, cy, w, l, angle) -> id, other, iou for pairs of ``least`` overlap or more."""

    def iou(batches):
        for p in batches:
            a, b = p[["cx", "cy", "w", "l", "angle"]].to_numpy(float), p[["r_cx", "r_cy", "r_w", "r_l", "r_angle"]].to_numpy(float)
            yield pd.DataFrame({"id": p.id, "other": p.r_id, "iou": kernels.rect_ious(a, b)})

    return shipped(_candidates(rects, size)).mapInPandas(iou, "id long, other long, iou double").filter(F.col("iou") >= least)


def crossing_outlines(rects: DataFrame, size: float = 25.0) -> DataFrame:
    """Pairs of rectangles of which some two edges cross, touch or overlap, each pair once."""
    pairs = _candidates(rects, size)
    left = geo.rect_corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("l"), F.col("angle"))
    right = geo.rect_corners(F.col("r_cx"), F.col("r_cy"), F.col("r_w"), F.col("r_l"), F.col("r_angle"))
    pairs = pairs.select("id", F.col("r_id").alias("other"), left.alias("p"), right.alias("q"))

    def side(a, b, c):
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    found = F.lit(False)
    for i in range(4):
        for j in range(4):
            a, b, c, e = (F.get("p", F.lit(i)), F.get("p", F.lit((i + 1) % 4)), F.get("q", F.lit(j)), F.get("q", F.lit((j + 1) % 4)))
            lap = F.lit(True)  # edges in one line meet where their boxes do
            for k in ("x", "y"):
                lap = lap & (F.least(a[k], b[k]) <= F.greatest(c[k], e[k])) & (F.least(c[k], e[k]) <= F.greatest(a[k], b[k]))
            found = found | (lap & (side(a, b, c) * side(a, b, e) <= 0) & (side(c, e, a) * side(c, e, b) <= 0))
    return pairs.filter(found).select("id", "other")


def suppressed(rects: DataFrame, iou: float = 0.35, centre: float = 1.0, most: int | None = None) -> DataFrame:
    """rects (key, id, cx, cy, w, l, angle, score): the ids that survive greedy suppression, by key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        boxes = [tuple(x) for x in pdf[["cx", "cy", "w", "l", "angle"]].to_numpy(float)]
        kept = kernels.suppress(boxes, pdf.score.tolist(), iou, centre, most)
        return pd.DataFrame({"key": pdf.key.iloc[0], "id": pdf.id.iloc[kept].to_numpy(), "rank": np.arange(len(kept))})

    return shipped(rects).groupBy("key").applyInPandas(run, T.StructType([rects.schema["key"], rects.schema["id"], T.StructField("rank", T.LongType())]))


#: Points of a key in a batch from which its hull is made there.
PART = 256


def part_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Points of a key by their hull, where a batch has ``PART`` of them; the others in one table."""
    for p in batches:
        n = p.groupby("key")["key"].transform("size")
        yield p[n < PART]
        for key, g in p[n >= PART].groupby("key"):
            h = kernels.convex_hull(g[["x", "y"]].to_numpy(float))
            yield pd.DataFrame({"key": key, "x": h[:, 0], "y": h[:, 1]})


def hulls(points: DataFrame) -> DataFrame:
    """points (key, x, y) -> corners and area of each key's convex hull.

    Each task first reduces what it has of a key to that part's hull, where it has ``PART`` points of it: a hull of hulls is the
    hull.  The others go on as they are.
    """

    def run(batches):
        for b in batches:
            lists = b.column("p")
            ends, flat = lists.offsets.to_numpy(), lists.values
            xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1)
            found = [kernels.convex_hull(xy[i:j]) for i, j in itertools.pairwise(ends)]
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "corners": pa.array([len(h) for h in found], pa.int64()), "area": pa.array([kernels.area(h) if len(h) > 2 else 0.0 for h in found], pa.float64())})

    part = shipped(points.select("key", "x", "y")).mapInPandas(part_hulls, "key long, x double, y double")
    return part.groupBy("key").agg(F.collect_list(F.struct("x", "y")).alias("p")).mapInArrow(run, "key long, corners long, area double")


def merged_intervals(intervals: DataFrame, group: list[str], gap: float) -> DataFrame:
    """Intervals (a, z) closer than ``gap`` as one."""
    w = Window.partitionBy(*group).orderBy("a", "z")
    df = intervals.withColumn("_p", F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_s", F.when(F.col("_p").isNull() | (F.col("a") > F.col("_p") + gap), 1).otherwise(0))
    df = df.withColumn("_g", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*group, "_g").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.count("*").alias("parts")).drop("_g")


def extended_edges(edges: DataFrame, points: DataFrame, step: float = 0.2, most: float = 10.0, along: float = 0.2, half: float = 0.5, least: int = 2) -> DataFrame:
    """edges (id, x1, y1, x2, y2), points (x, y) -> id, back, ahead: steps by which each end goes on.

    An end goes on as long as the band across its next place (``along`` each way, ``half`` to each side) holds
    ``least`` points.  Points meet the strips beyond the ends by grid cells; every step is counted, and the unbroken run from the end is taken.
    """
    steps = int(most / step + 1e-9)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    df = edges.withColumn("_len", F.sqrt(dx * dx + dy * dy)).filter("_len > 1e-6").withColumn("ux", dx / F.col("_len")).withColumn("uy", dy / F.col("_len"))
    ends = F.array(F.struct(F.lit(0).alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y"), (-F.col("ux")).alias("ux"), (-F.col("uy")).alias("uy")), F.struct(F.lit(1).alias("end"), F.col("x2").alias("x"), F.col("y2").alias("y"), "ux", "uy"))
    reach = (most + 2 * along) / 2
    strips = df.select("id", F.explode(ends).alias("e")).select("id", "e.end", (F.col("e.x") + F.col("e.ux") * most / 2).alias("cx"), (F.col("e.y") + F.col("e.uy") * most / 2).alias("cy"), F.lit(2 * reach).alias("w"), F.lit(2 * half).alias("l"), F.degrees(F.atan2("e.uy", "e.ux")).alias("angle"))
    hits = spatial.points_in_rects(points.select("x", "y"), strips).withColumn("t", F.col("u") + most / 2)
    first, last = F.greatest(F.ceil((F.col("t") - along) / step), F.lit(1)), F.least(F.floor((F.col("t") + along) / step), F.lit(steps))
    hits = hits.filter(first <= last).select("id", "end", F.explode(F.sequence(first, last)).alias("k")).groupBy("id", "end", "k").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    run = hits.withColumn("r", F.row_number().over(Window.partitionBy("id", "end").orderBy("k"))).filter("r = k").groupBy("id").agg(F.count_if(F.col("end") == 0).alias("back"), F.count_if(F.col("end") == 1).alias("ahead"))
    return edges.select("id").join(run, "id", "left").select("id", F.coalesce("back", F.lit(0)).alias("back"), F.coalesce("ahead", F.lit(0)).alias("ahead"))


def raster_candidates(cells: DataFrame, size: float, x0: float, y0: float, most: int = 12) -> DataFrame:
    """cells (key, u, v) of a raster -> the rectangles of berth size round its connected parts, largest first, near copies suppressed.

    A key's raster is bounded by its extent; parts of five cells or fewer are left out.
    """

    def run(key, pdf):
        found = []
        for part in kernels.connected_cells(pdf[["u", "v"]].to_numpy()):
            if len(part) <= 5:
                continue
            cx, cy, w, l, angle = kernels.smallest_rect(part * size + (x0, y0))
            if 7 <= w <= 12 and 8 <= l <= 25 and w * l >= 56:
                found.append((float(len(part)), cx, cy, w, l, angle))
        found.sort(key=lambda f: -f[0])
        kept = kernels.suppress([f[1:] for f in found], [f[0] for f in found], 0.35, 1.0, most)
        return pd.DataFrame([(key[0], k, *found[j][1:], int(found[j][0])) for k, j in enumerate(kept)], columns=["key", "rank", "cx", "cy", "w", "l", "angle", "cells"])

    return shipped(cells.select("key", "u", "v")).groupBy("key").applyInPandas(run, "key long, rank long, cx double, cy double, w double, l double, angle double, cells long")


# --- berths along a line in the world -----------------------------------------------------------
def _from_line(x, y, line: tuple):
    """Distance to the left of a line (x1, y1, x2, y2); exact where the line lies along an axis, so that equal distances stay equal."""
    x1, y1, x2, y2 = line
    n = F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
    return (x2 - x1) / n * (y - y1) - (y2 - y1) / n * (x - x1)


def _middles(cx, cy, w, l, angle) -> list[tuple]:
    """Middles of the four edges, counter-clockwise from the near one."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return [(cx + s * l / 2, cy - c * l / 2), (cx + c * w / 2, cy + s * w / 2), (cx - s * l / 2, cy + c * l / 2), (cx - c * w / 2, cy - s * w / 2)]


def line_side(berths: DataFrame, lines: DataFrame, near: float = 2.0, clear: float = 0.2) -> DataFrame:
    """berths (key, cx, cy, w, l, angle, kind), lines (key, x1, y1, x2, y2) -> lines with ``side``: where most U-shaped berths near it lie (1 left, -1 right, 0 undecided)."""
    df = berths.filter("kind = 1").join(lines, "key")
    line = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    gap = F.least(*[F.abs(_from_line(x, y, line)) for x, y in _middles(*[F.col(c) for c in ("cx", "cy", "w", "l", "angle")])])
    d = _from_line(F.col("cx"), F.col("cy"), line)
    votes = df.filter(gap <= near).groupBy("key").agg((F.count_if(d > clear) - F.count_if(d < -clear)).alias("_votes"))
    return lines.join(votes, "key", "left").withColumn("side", F.coalesce(F.signum("_votes"), F.lit(0.0)).cast("int")).drop("_votes")


def aligned_berths(berths: DataFrame, lines: DataFrame, most: float = 5.0, clear: float = 0.2) -> DataFrame:
    """U-shaped berths (kind 1) laid along the line of their key, and mirrored to its expected side; the others as they are.

    The edge whose middle is nearest to the line, within ``most``, comes to lie on it.  lines: key, x1, y1, x2, y2, side.
    """
    line = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    df = berths.join(lines, "key", "left")
    gaps = F.array(*[F.abs(_from_line(x, y, line)) for x, y in _middles(*[F.col(c) for c in ("cx", "cy", "w", "l", "angle")])])
    df = df.withColumn("_gaps", gaps).withColumn("_edge", F.array_position("_gaps", F.array_min("_gaps")).cast("int") - 1)
    fits = (F.col("kind") == 1) & (F.col("w") > 1e-3) & (F.col("l") > 1e-3) & (F.array_min("_gaps") <= most)
    df = df.withColumn("aligned", F.coalesce(fits, F.lit(False)))
    along = F.degrees(F.atan2(line[3] - line[1], line[2] - line[0]))
    df = df.withColumn("_angle", geo.angle_180(along - F.when(F.col("_edge") % 2 == 0, 0.0).otherwise(90.0)))
    turned = _middles(F.col("cx"), F.col("cy"), F.col("w"), F.col("l"), F.col("_angle"))
    pick = lambda k: F.get(F.array(*[m[k] for m in turned]), F.col("_edge"))
    n = F.sqrt((line[2] - line[0]) * (line[2] - line[0]) + (line[3] - line[1]) * (line[3] - line[1]))
    nx, ny = (line[1] - line[3]) / n, (line[2] - line[0]) / n
    df = df.withColumn("_off", _from_line(pick(0), pick(1), line)).withColumn("_x", F.col("cx") - F.col("_off") * nx).withColumn("_y", F.col("cy") - F.col("_off") * ny)
    d = _from_line(F.col("_x"), F.col("_y"), line)
    wrong = (F.col("side") != 0) & (F.abs(d) > clear) & (F.signum(d).cast("int") != F.col("side"))
    df = df.withColumn("_wrong", F.coalesce(wrong, F.lit(False))).withColumn("_d", F.when(F.col("_wrong"), 2 * d).otherwise(0.0))
    known = F.when(F.col("opening_edge").between(0, 3), F.col("opening_edge")).otherwise(F.col("_edge"))
    new = {"cx": F.col("_x") - F.col("_d") * nx, "cy": F.col("_y") - F.col("_d") * ny, "angle": F.col("_angle"), "opening_edge": F.when(F.col("_wrong"), geo.opposite_edge(known)).otherwise(known)}
    out = [F.when(F.col("aligned"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in berths.columns]
    return df.select(*out, "aligned")
