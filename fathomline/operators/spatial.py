"""Grid-accelerated spatial joins and components.

All of them turn a distance or containment test into an equality join on grid cells of bounded
fan-out; the exact test follows on the pairs that share a cell.
"""

from __future__ import annotations

import functools
import itertools
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import geo
from fathomline.operators import neighbours


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def near_cells(cells: list[Column], reach: int = 1) -> Column:
    """All cells within ``reach`` in each dimension, as an array of structs c0, c1, ..."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    out = F.transform(steps, lambda d: F.struct((cells[0] + d).alias("c0")))
    for k in range(1, len(cells)):
        out = _product(out, steps, cells[k], k)
    return out


def _product(have: Column, steps: Column, centre: Column, k: int) -> Column:
    return F.flatten(F.transform(have, lambda s: F.transform(steps, lambda d: F.struct(*[s[f"c{j}"].alias(f"c{j}") for j in range(k)], (centre + d).alias(f"c{k}")))))


def radius_join(left: DataFrame, right: DataFrame, radius: float, dims: tuple[str, ...] = ("x", "y", "z"), by: tuple[str, ...] = (), prefix: str = "r_") -> DataFrame:
    """All pairs within ``radius``: the right side has one cell, the left side looks into its neighbours."""
    names = [f"_c{k}" for k in range(len(dims))]
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    r = r.withColumns({n: cell(F.col(prefix + d), radius) for n, d in zip(names, dims, strict=True)})
    l = left.withColumn("_n", F.explode(near_cells([cell(F.col(d), radius) for d in dims])))
    cond = l["_n.c0"] == r["_c0"]
    for k in range(1, len(dims)):
        cond = cond & (l[f"_n.c{k}"] == r[f"_c{k}"])
    for b in by:
        cond = cond & (l[b] == r[prefix + b])
    d2 = sum(((F.col(d) - F.col(prefix + d)) * (F.col(d) - F.col(prefix + d)) for d in dims[1:]), (F.col(dims[0]) - F.col(prefix + dims[0])) * (F.col(dims[0]) - F.col(prefix + dims[0])))
    return l.join(r, cond).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).drop("_n", *names)


def radius_pairs(points: DataFrame, radius: float, index: str, dims: tuple[str, ...] = ("x", "y", "z"), by: tuple[str, ...] = (), prefix: str = "r_") -> DataFrame:
    """All pairs of one table within ``radius``, each once with the lower index first.

    A point looks into its own cell and one half of the cells around, so a pair of cells meets once.
    """
    names = [f"_c{k}" for k in range(len(dims))]
    cells = [cell(F.col(d), radius) for d in dims]
    zero = (0,) * len(dims)
    half = [s for s in itertools.product((-1, 0, 1), repeat=len(dims)) if s >= zero]
    looks = F.array(*[F.struct(*[(c + o).alias(f"c{k}") for k, (c, o) in enumerate(zip(cells, s, strict=True))], F.lit(s == zero).alias("own")) for s in half])
    kept = points.select(*by, index, *dims)
    l = kept.withColumn("_n", F.explode(looks))
    r = kept.select(*[F.col(c).alias(prefix + c) for c in kept.columns]).withColumns({n: cell(F.col(prefix + d), radius) for n, d in zip(names, dims, strict=True)})
    cond = F.lit(True)
    for k, n in enumerate(names):
        cond = cond & (F.col(f"_n.c{k}") == F.col(n))
    for b in by:
        cond = cond & (F.col(b) == F.col(prefix + b))
    d2 = sum(((F.col(d) - F.col(prefix + d)) * (F.col(d) - F.col(prefix + d)) for d in dims[1:]), (F.col(dims[0]) - F.col(prefix + dims[0])) * (F.col(dims[0]) - F.col(prefix + dims[0])))
    found = l.join(r, cond).withColumn("d2", d2).filter((F.col("d2") <= radius * radius) & (~F.col("_n.own") | (F.col(index) < F.col(prefix + index))))
    low, high = F.least(index, prefix + index), F.greatest(index, prefix + index)
    return found.select(*by, low.alias(index), high.alias(prefix + index), "d2")


#: Halvings of the cells in which ``knn`` looks for crowds.
LEVELS = 12


def knn(left: DataFrame, right: DataFrame, k: int, reach: float, left_id: str, right_id: str, dims: tuple[str, ...] = ("x", "y", "z"), by: tuple[str, ...] = (), prefix: str = "r_") -> DataFrame:
    """The k nearest within ``reach``; ties to the lower id.  A cloud without ``by`` goes through ``neighbours``, groups by cells.

    Equal places of the left side ask once, and of equal places of the right side only the k lowest ids can be among
    the nearest.  A place takes the finest cell around it that holds k points: the k-th distance to those bounds its ball, and
    only cells that the ball meets are looked into.  Places without such a cell look as far as ``reach``.
    """
    if not by:
        return neighbours.knn(left, right, k, reach, right_id, dims, prefix)
    here, cells = [*by, *dims], [f"_c{j}" for j in range(len(dims))]
    there = [prefix + c for c in here]
    levels = F.explode(F.array(*[F.struct(F.lit(j).alias("level"), F.lit(reach / 2**j).alias("size")) for j in range(LEVELS)]))
    dealt = lambda df, names: df.withColumn("_l", levels).withColumns({c: F.floor(F.col(n) / F.col("_l.size")).cast("long") for c, n in zip(cells, names, strict=True)})
    d2 = sum(((F.col(d) - F.col(prefix + d)) * (F.col(d) - F.col(prefix + d)) for d in dims[1:]), (F.col(dims[0]) - F.col(prefix + dims[0])) * (F.col(dims[0]) - F.col(prefix + dims[0])))
    first = F.row_number().over(Window.partitionBy(*there).orderBy(prefix + right_id))
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns]).dropna(subset=there).withColumn("_first", first).filter(F.col("_first") <= k).drop("_first")
    r = dealt(r, there[len(by) :]).select("*", F.col("_l.level").alias("_level")).drop("_l")
    q = left.select(*here).dropna().distinct()
    crowds = r.groupBy(*[F.col(prefix + b).alias(b) for b in by], "_level", *cells).agg(F.count("*").alias("_crowd")).filter(F.col("_crowd") >= k).drop("_crowd")
    fine = dealt(q, list(dims)).select("*", F.col("_l.level").alias("_level"), F.col("_l.size").alias("_size")).drop("_l").join(crowds, [*by, "_level", *cells])
    fine = fine.groupBy(*here).agg(F.max(F.struct("_level", "_size", *cells)).alias("_own")).select(*here, "_own.*")
    meets = functools.reduce(lambda a, b: a & b, [F.col(f"_l.{c}") == F.col(f"_r.{c}") for c in ("_level", *cells)] + [F.col(b) == F.col(prefix + b) for b in by])
    joined = lambda l: l.alias("_l").join(r.alias("_r").hint("merge"), meets).withColumn("d2", d2)
    near = joined(fine).select(*here, F.col("_l._level").alias("_level"), "_size", "d2").withColumn("_rank", F.row_number().over(Window.partitionBy(*here).orderBy("d2")))
    bound = near.filter(F.col("_rank") == k).select(*here, "_level", "_size", F.least("d2", F.lit(reach * reach)).alias("_bound"))
    asks = q.join(bound, here, "left").fillna({"_level": 0, "_size": reach, "_bound": reach * reach})
    ball = F.sqrt("_bound") * (1 + 1e-9)
    for c, d in zip(cells, dims, strict=True):
        ends = [F.floor((F.col(d) + sign * ball) / F.col("_size")).cast("long") for sign in (-1, 1)]
        asks = asks.withColumn(c, F.explode(F.sequence(*ends)))
    found = joined(asks).filter(F.col("d2") <= F.col("_bound")).select(*here, *[c for c in r.columns if c not in ("_level", *cells)], "d2")
    w = Window.partitionBy(*here).orderBy("d2", prefix + right_id)
    found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return left.join(found, here).select(*left.columns, *[prefix + c for c in right.columns], "d2", "rank")


def statistical_outliers(points: DataFrame, frame: str, index: str, k: int, m: float, reach: float) -> DataFrame:
    """Adds the mean distance to k neighbours and ``kept``: not above mean + m deviations of the frame."""
    near = knn(points, points, k + 1, reach, index, index, by=(frame,)).filter(F.col("d2") > 0)
    mean = near.groupBy(frame, index).agg(F.avg(F.sqrt("d2")).alias("mean_distance"))
    limit = mean.groupBy(frame).agg((F.avg("mean_distance") + m * F.stddev_samp("mean_distance")).alias("limit"))
    return mean.join(limit, frame).withColumn("kept", F.col("mean_distance") <= F.coalesce("limit", F.col("mean_distance")))


def trimmed_match(a: DataFrame, b: DataFrame, by: tuple[str, ...], index: str, reach: float, share: float = 0.9) -> DataFrame:
    """Root mean square of the best ``share`` of nearest distances from a to b, and the share of a that has one within reach."""
    near = radius_join(a.select(*by, index, "x", "y", "z"), b.select(*by, "x", "y", "z"), reach, by=by).groupBy(*by, index).agg(F.min("d2").alias("d2"))
    # the best part by counts of equal distances, so that no group is sorted in one task as rows of its own
    ranked = near.groupBy(*by, "d2").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy("d2").rowsBetween(Window.unboundedPreceding, -1)
    whole = near.groupBy(*by).agg(F.count("*").alias("matched"))
    used = ranked.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0))).join(whole, list(by))
    used = used.withColumn("take", F.greatest(F.lit(0), F.least(F.col("c"), F.ceil(F.col("matched") * share) - F.col("before"))))
    sums = used.groupBy(*by).agg(F.sqrt(F.sum(F.col("take") * F.col("d2")) / F.sum("take")).alias("rmse"), F.first("matched").alias("matched"))
    return a.groupBy(*by).agg(F.count("*").alias("n")).join(sums, list(by), "left").select(*by, "rmse", (F.coalesce("matched", F.lit(0)) / F.col("n")).alias("match"))


def low_outliers(points: DataFrame, frame: str, index: str, height: str, below: float, radius: float, least: int) -> DataFrame:
    """Points under ``below`` stay only with ``least`` neighbours within the radius; higher ones always stay.

    Points are counted by cells whose diagonal is the radius first: only points with fewer than ``least``
    companions in their own cell are joined with others.
    """
    fine = radius / 3**0.5 * (1 - 1e-9)  # the diagonal of such a cell is no longer than the radius
    own = [frame, *[f"_f{k}" for k in range(3)]]
    df = points.withColumns({f"_f{k}": cell(F.col(d), fine) for k, d in enumerate(("x", "y", "z"))})
    crowd = df.groupBy(*own).agg(F.count("*").alias("_crowd"))
    low = df.filter(F.col(height) <= below).join(crowd, own)
    sure = low.filter(F.col("_crowd") > least).select(frame, index)
    rest = low.filter(F.col("_crowd") <= least)
    pairs = radius_join(rest.select(frame, index, "x", "y", "z"), points.select(frame, index, "x", "y", "z"), radius, by=(frame,))
    met = pairs.filter(F.col(index) != F.col("r_" + index)).groupBy(frame, index).agg(F.count("*").alias("near")).filter(F.col("near") >= least)
    kept = sure.unionByName(met.select(frame, index))
    high = points.filter(F.col(height) > below)
    return high.unionByName(points.filter(F.col(height) <= below).join(kept, [frame, index], "left_semi"))


#: Fine cells along a side of a coarse one.
COARSE = 16


def rect_cells(rects: DataFrame, size: float, reach: float, coarse: DataFrame, touch: Callable[[Column, Column, float], Column]) -> DataFrame:
    """The fine cells (_c0, _c1) a rectangle (cx, cy, w, l, angle) widened by ``reach`` touches, inside the coarse cells (_k0, _k1) given.

    ``touch`` says of a cell's middle in the rectangle's frame whether a point of the cell, at most the slack away, can count.
    """
    c, s = F.abs(F.cos(F.radians("angle"))), F.abs(F.sin(F.radians("angle")))
    hx, hy = F.col("w") / 2 * c + F.col("l") / 2 * s + reach, F.col("w") / 2 * s + F.col("l") / 2 * c + reach
    ends = [cell(F.col("cx") - hx, size), cell(F.col("cx") + hx, size), cell(F.col("cy") - hy, size), cell(F.col("cy") + hy, size)]
    df = rects.withColumns({f"_e{k}": e for k, e in enumerate(ends)})
    over = lambda k: F.floor(F.col(f"_e{k}") / COARSE)
    df = df.withColumn("_k0", F.explode(F.sequence(over(0), over(1)))).withColumn("_k1", F.explode(F.sequence(over(2), over(3))))
    df = df.join(coarse, ["_k0", "_k1"], "left_semi")
    for k in (0, 1):
        low, high = F.greatest(f"_e{2 * k}", F.col(f"_k{k}") * COARSE), F.least(f"_e{2 * k + 1}", F.col(f"_k{k}") * COARSE + COARSE - 1)
        df = df.withColumn(f"_c{k}", F.explode(F.sequence(low, high)))
    u, v = geo.rotate_yaw((F.col("_c0") + 0.5) * size - F.col("cx"), (F.col("_c1") + 0.5) * size - F.col("cy"), -F.col("angle"))
    return df.filter(touch(u, v, size * 0.70711 + 1e-6)).drop("_k0", "_k1", *[f"_e{k}" for k in range(4)])


def points_in_rects(points: DataFrame, rects: DataFrame, inset: float = 0.0, size: float = 2.5, margin: float = 0.0, touch: Callable[[Column, Column, float], Column] | None = None, count: str | None = None) -> DataFrame:
    """Pairs of a point and a rectangle (cx, cy, w, l, angle) that holds it; ``margin`` only widens the candidates, ``touch`` narrows them.

    With ``count`` a place (x, y) is paired once, its points are counted in that column.  Rectangles are dealt to
    fine cells only where a coarse cell has points, and never broadcast: there are far more cells than their table's size tells.
    """
    fine = {"_c0": cell(F.col("x"), size), "_c1": cell(F.col("y"), size)}
    coarse = points.select(*[F.floor(fine[f"_c{k}"] / COARSE).alias(f"_k{k}") for k in (0, 1)]).distinct()
    p = points.groupBy("x", "y").agg(F.count("*").alias(count)) if count else points
    if touch is None:
        touch = lambda u, v, slack: (F.abs(u) <= F.col("w") / 2 - inset + margin + slack) & (F.abs(v) <= F.col("l") / 2 - inset + margin + slack)
    r = rect_cells(rects, size, margin, coarse, touch)
    pairs = p.withColumns(fine).hint("merge").join(r, ["_c0", "_c1"]).drop("_c0", "_c1")
    u, v = geo.rotate_yaw(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), -F.col("angle"))
    pairs = pairs.withColumn("u", u).withColumn("v", v)
    if margin:
        return pairs
    return pairs.filter((F.abs("u") <= F.col("w") / 2 - inset) & (F.abs("v") <= F.col("l") / 2 - inset))


def occupancy(points: DataFrame, rects: DataFrame, rect_id: str, inset: float = 0.8, least: int = 100) -> DataFrame:
    counts = points_in_rects(points, rects, inset, count="_n").groupBy(rect_id).agg(F.sum("_n").alias("inside"))
    return rects.join(counts, rect_id, "left").withColumn("inside", F.coalesce("inside", F.lit(0))).withColumn("occupied", F.col("inside") >= least)


def outward_hits(points: DataFrame, rects: DataFrame, rect_id: str, reach: float = 20.0, half: float = 1.0) -> DataFrame:
    """Points in the four strips that leave the middle of each side outwards; height plays no part."""
    across = lambda u, v, slack: (F.abs(u) <= half + slack) & (F.abs(v) <= F.col("l") / 2 + reach + slack)
    along = lambda u, v, slack: (F.abs(v) <= half + slack) & (F.abs(u) <= F.col("w") / 2 + reach + slack)
    pairs = points_in_rects(points, rects, margin=reach, touch=lambda u, v, slack: across(u, v, slack) | along(u, v, slack), count="_n")
    hw, hl, u, v = F.col("w") / 2, F.col("l") / 2, F.col("u"), F.col("v")
    strips = [
        (F.abs(u) <= half) & (v < -hl) & (v >= -hl - reach),
        (F.abs(v) <= half) & (u > hw) & (u <= hw + reach),
        (F.abs(u) <= half) & (v > hl) & (v <= hl + reach),
        (F.abs(v) <= half) & (u < -hw) & (u >= -hw - reach),
    ]
    return pairs.groupBy(rect_id).agg(*[F.sum(F.when(s, F.col("_n")).otherwise(0)).alias(f"hits{k}") for k, s in enumerate(strips)])


def edge_band_counts(points: DataFrame, rects: DataFrame, rect_id: str, band: float = 0.8, along: float = 0.7) -> DataFrame:
    """Points within ``band`` of each edge, over the middle ``along`` of its length."""
    pairs = points_in_rects(points, rects, margin=band, count="_n")
    hw, hl, u, v = F.col("w") / 2, F.col("l") / 2, F.col("u"), F.col("v")
    edges = [
        (F.abs(v + hl) <= band) & (F.abs(u) <= hw * along),
        (F.abs(u - hw) <= band) & (F.abs(v) <= hl * along),
        (F.abs(v - hl) <= band) & (F.abs(u) <= hw * along),
        (F.abs(u + hw) <= band) & (F.abs(v) <= hl * along),
    ]
    return pairs.groupBy(rect_id).agg(*[F.sum(F.when(e, F.col("_n")).otherwise(0)).alias(f"edge{k}") for k, e in enumerate(edges)])


def boxes_overlapping(left: DataFrame, right: DataFrame, size: float, prefix: str = "r_") -> DataFrame:
    """Pairs of boxes (min_x, min_y, max_x, max_y) that overlap, through the tiles they cover; each pair once."""
    cover = lambda a, b, c, d: F.flatten(F.transform(F.sequence(cell(a, size), cell(c, size)), lambda x: F.transform(F.sequence(cell(b, size), cell(d, size)), lambda y: F.struct(x.alias("c0"), y.alias("c1")))))
    l = left.withColumn("_n", F.explode(cover(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"))))
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    r = r.withColumn("_m", F.explode(cover(F.col(prefix + "min_x"), F.col(prefix + "min_y"), F.col(prefix + "max_x"), F.col(prefix + "max_y"))))
    pairs = l.join(r, (l["_n.c0"] == r["_m.c0"]) & (l["_n.c1"] == r["_m.c1"]))
    lap = (F.col("min_x") <= F.col(prefix + "max_x")) & (F.col(prefix + "min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col(prefix + "max_y")) & (F.col(prefix + "min_y") <= F.col("max_y"))
    # the cell that holds the lower left corner of the overlap names the pair
    first = (F.col("_n.c0") == cell(F.greatest("min_x", F.col(prefix + "min_x")), size)) & (F.col("_n.c1") == cell(F.greatest("min_y", F.col(prefix + "min_y")), size))
    return pairs.filter(lap & first).drop("_n", "_m")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node), edges (a, b) -> node, component: the smallest node reachable.

    Hooking to the smallest neighbour and pointer jumping; lineage is cut by checkpoints in the folder
    that spark.checkpoint.dir names.  A label only ever falls, so the rounds end.
    """
    spark = nodes.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp())
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct().checkpoint()
    labels = nodes.select("node", F.col("node").alias("component")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        seen = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        root = seen.groupBy("was").agg(F.min("component").alias("to"))
        hooked = seen.join(root, "was").select("node", "was", F.least("component", "to").alias("component"))
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = hooked.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("up", "component")).alias("component")).checkpoint()
        labels = after.select("node", "component")
        if after.filter("component <> was").isEmpty():
            return labels
