"""Queries of registration, tracking, morphology and view helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import digest, geo
from fathomline.operators import berths, dynamics, registration, spatial, tracking
from fathomline.plans.catalog import r6
from fathomline.plans.catalog_aggregates import AROUND, GRID, bev, spread
from fathomline.plans.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = with_views(sql)
        return fn

    return register


def clusters(spark, d) -> DataFrame:
    """A unit's events of a day as the clusters of a frame."""
    n = view(spark, d, "nav")
    place = ((F.col("value") * 0.5).alias("x"), (F.col("yaw_deg") * 0.1).alias("y"), (1.0 + F.col("value") % 10).alias("size"))
    return n.select(F.col("unit").cast("string").alias("key"), F.floor(F.col("ts") / 86400.0).alias("frame"), "id", *place, (F.col("sensor") == "error").alias("locked"))


@query("join13_cluster_tracks")
def join13(spark, d):
    return tracking.track_clusters(clusters(spark, d))


@query("str20_track_lifetimes")
def str20(spark, d):
    return tracking.track_clusters(clusters(spark, d)).groupBy("key", "track").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("seen"))


@query("agg15_normal_equations", """WITH p AS (SELECT label, x, y, z, x + 0.1e0 * y AS u, y - 0.05e0 AS v, z + 0.02e0 * x AS w FROM vec), e AS (SELECT *, u - x AS a, v - y AS b, w - z AS c FROM p)
 SELECT label, round(sum(y*y + z*z), 6) AS h00, round(-sum(x*y), 6) AS h01, round(-sum(x*z), 6) AS h02, round(sum(x*x + z*z), 6) AS h11, round(-sum(y*z), 6) AS h12, round(sum(x*x + y*y), 6) AS h22,
 round(sum(b*z - c*y), 6) AS g0, round(sum(c*x - a*z), 6) AS g1, round(sum(a*y - b*x), 6) AS g2, round(-sum(a), 6) AS g3, round(-sum(b), 6) AS g4, round(-sum(c), 6) AS g5, round(sum(a*a + b*b + c*c), 6) AS cost FROM e GROUP BY label""")
def agg15(spark, d):
    v = view(spark, d, "vec").withColumns({"u": F.col("x") + 0.1 * F.col("y"), "v": F.col("y") - 0.05, "w": F.col("z") + 0.02 * F.col("x")})
    s = registration.normal_equation_sums(v, ["label"])
    return s.select("label", *[r6(c).alias(c) for c in ("h00", "h01", "h02", "h11", "h12", "h22", *[f"g{k}" for k in range(6)], "cost")])


TRIM = """{n} AS (SELECT a.label, a.vec_id, min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d2 FROM {a} a JOIN {b} b ON a.label = b.label AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.04e0 GROUP BY 1, 2),
 {n}r AS (SELECT label, d2, row_number() OVER (PARTITION BY label ORDER BY d2) AS r, count(*) OVER (PARTITION BY label) AS m FROM {n}),
 {n}s AS (SELECT label, sqrt(avg(d2)) AS rmse, max(m) AS m FROM {n}r WHERE r <= ceil(0.9e0 * m) GROUP BY label), {n}t AS (SELECT c.label, rmse, coalesce(m, 0) / c.n AS match FROM (SELECT label, count(*) * 1e0 AS n FROM {a} GROUP BY label) c LEFT JOIN {n}s s ON s.label = c.label)"""


@query("agg17b_trimmed_both_ways", "WITH ev AS (SELECT * FROM vec WHERE vec_id % 2 = 0), od AS (SELECT * FROM vec WHERE vec_id % 2 = 1), " + TRIM.format(n="f", a="ev", b="od") + ", " + TRIM.format(n="g", a="od", b="ev")
 + " SELECT ft.label, round(sqrt((ft.rmse * ft.rmse + gt.rmse * gt.rmse) / 2e0), 6) AS rmse, round((ft.match + gt.match) / 2e0, 6) AS match FROM ft JOIN gt ON ft.label = gt.label")
def agg17b(spark, d):
    v = view(spark, d, "vec")
    even, odd = v.filter("vec_id % 2 = 0"), v.filter("vec_id % 2 = 1")
    ahead = spatial.trimmed_match(even, odd, ("label",), "vec_id", 0.2)
    back = spatial.trimmed_match(odd, even, ("label",), "vec_id", 0.2).select("label", F.col("rmse").alias("rmse2"), F.col("match").alias("match2"))
    return ahead.join(back, "label").select("label", r6(F.sqrt((F.col("rmse") ** 2 + F.col("rmse2") ** 2) / 2)).alias("rmse"), r6((F.col("match") + F.col("match2")) / 2).alias("match"))


def both_sides(spark, d, yaw: float, tx: float, ty: float, tz: float) -> DataFrame:
    """Each label's points as the target, and as a source that this motion carries onto it."""
    v = view(spark, d, "vec").withColumn("idx", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    t = v.select(F.col("label").cast("long").alias("key"), F.lit("t").alias("side"), "idx", F.col("vec_id").cast("double").alias("ts"), (F.col("x") * 40).alias("x"), (F.col("y") * 40).alias("y"), (F.col("z") * 40).alias("z"))
    x, y = geo.rotate_yaw(F.col("x") - tx, F.col("y") - ty, F.lit(-yaw))
    return t.unionByName(t.withColumns({"side": F.lit("s"), "_x": x, "_y": y, "z": F.col("z") - tz}).drop("x", "y").withColumnsRenamed({"_x": "x", "_y": "y"}))


def truth(*values: str) -> str:
    return "SELECT CAST(label AS BIGINT) AS key, " + ", ".join(values) + " FROM vec GROUP BY label"


@query("ker10_map_registration", truth("3.0e0 AS yaw", "0.4e0 AS tx", "-0.3e0 AS ty", "0.2e0 AS tz", "count(*) AS matches"))
def ker10(spark, d):
    found = registration.register_clouds(both_sides(spark, d, 3.0, 0.4, -0.3, 0.2))
    return found.select("key", *[F.round(c, 3).alias(c) for c in ("yaw", "tx", "ty", "tz")], "matches")


@query("srt08_first_guess", truth("2.0e0 AS tx", "-1.0e0 AS ty", "true AS accepted", "count(*) - count(*) AS fresh"))
def srt08(spark, d):
    found = registration.stitch_maps(both_sides(spark, d, 0.0, 2.0, -1.0, 0.0))
    return found.select("key", F.round("tx", 4).alias("tx"), F.round("ty", 4).alias("ty"), "accepted", "fresh")


@query("srt06_tile_order", """WITH t AS (SELECT DISTINCT kind AS lod, CAST(floor(cx / 50e0) AS BIGINT) AS tile_x, CAST(floor(cy / 50e0) AS BIGINT) AS tile_y FROM berths)
 SELECT lod, tile_x, tile_y, row_number() OVER (PARTITION BY lod ORDER BY tile_x, tile_y) AS request FROM t""")
def srt06(spark, d):
    t = view(spark, d, "berths").select(F.col("kind").alias("lod"), geo.tile_index(F.col("cx"), 0.0, 50.0).alias("tile_x"), geo.tile_index(F.col("cy"), 0.0, 50.0).alias("tile_y")).distinct()
    return t.withColumn("request", F.row_number().over(Window.partitionBy("lod").orderBy("tile_x", "tile_y")).cast("long"))


ERODED = f"er AS (SELECT u + dx AS u, v + dy AS v FROM g, {AROUND} GROUP BY 1, 2 HAVING count(*) = 9)"
OPENED = f"op AS (SELECT DISTINCT u + dx AS u, v + dy AS v FROM er, {AROUND})"


def eroded(cells: DataFrame) -> DataFrame:
    return spread(cells).groupBy("u", "v").agg(F.count("*").alias("n")).filter("n = 9").drop("n")


@query("ker02c_open", f"WITH {GRID}, {ERODED}, {OPENED} SELECT u, v FROM op")
def ker02c(spark, d):
    return spread(eroded(bev(spark, d))).distinct()


@query("ker02d_close", f"WITH {GRID}, di AS (SELECT DISTINCT u + dx AS u, v + dy AS v FROM g, {AROUND}) SELECT u + dx AS u, v + dy AS v FROM di, {AROUND} GROUP BY 1, 2 HAVING count(*) = 9")
def ker02d(spark, d):
    return eroded(spread(bev(spark, d)).distinct())


@query("ker02e_subtract", f"WITH {GRID}, {ERODED}, {OPENED} SELECT u, v FROM g EXCEPT SELECT u, v FROM op")
def ker02e(spark, d):
    cells = bev(spark, d)
    return cells.join(spread(eroded(cells)).distinct(), ["u", "v"], "left_anti")


@query("scl15_line_berths", """SELECT id, (angle + 90e0) % 180e0 AS angle, (opening_edge + 2) % 4 AS wall_edge, [CASE WHEN (opening_edge + 2) % 4 = k THEN hits ELSE 0 END FOR k IN [0, 1, 2, 3]] AS edge_points, round(sqrt(cx * cx + cy * cy), 6) AS distance FROM berths""")
def scl15(spark, d):
    b = view(spark, d, "berths")
    wall = geo.opposite_edge(F.col("opening_edge"))
    points = F.array(*[F.when(wall == k, F.col("hits")).otherwise(F.lit(0)) for k in range(4)])
    return b.select("id", geo.angle_180(F.col("angle") - 90).alias("angle"), wall.alias("wall_edge"), points.alias("edge_points"), r6(F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2)).alias("distance"))


@query("scl36_view_pan", """SELECT id, round(cx - hits * 2e0 * 60e0 * 1.6e0 / 1280e0, 6) AS x, round(cy + hits * 2e0 * 60e0 / 800e0, 6) AS y, round(cx + hits * 2e0 * greatest(1e0, abs(cy)) * tan(radians(22.5e0)) / 800e0, 6) AS px FROM berths""")
def scl36(spark, d):
    x, y = geo.pan_orthographic(F.col("cx"), F.col("cy"), F.col("hits"), F.col("hits"), 60.0, 1.6, 1280, 800)
    px, _ = geo.pan_perspective(F.col("cx"), F.col("cy"), F.col("hits"), F.col("hits"), F.col("cy"), 800)
    return view(spark, d, "berths").select("id", r6(x).alias("x"), r6(y).alias("y"), r6(px).alias("px"))


@query("scl26_geometry_digest")
def scl26(spark, d):
    b = view(spark, d, "berths").select("id", "ts", "cx", "cy", F.col("w").cast("double").alias("w"), F.col("l").cast("double").alias("l"), "angle", "opening_edge", "kind")
    return digest.geometry_digest(b)


@query("ker05_edge_extension", """WITH t AS (SELECT id, CASE WHEN x > cx THEN 1 ELSE 0 END AS e, abs(x - cx) - w / 2e0 AS t FROM berths JOIN pts ON abs(y - cy) <= 1.0137e0 AND abs(x - cx) - w / 2e0 BETWEEN -0.5e0 AND 10.5e0),
 k AS (SELECT id, e, k FROM t, (SELECT unnest(range(1, 11)) AS k) WHERE abs(t - k) <= 0.4137e0 GROUP BY 1, 2, 3 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY id, e ORDER BY k) AS n FROM k)
 SELECT b.id, count(*) FILTER (WHERE e = 0 AND k = n) AS back, count(*) FILTER (WHERE e = 1 AND k = n) AS ahead FROM berths b LEFT JOIN r ON r.id = b.id GROUP BY b.id""")
def ker05(spark, d):
    b = view(spark, d, "berths")
    edges = b.select("id", (F.col("cx") - F.col("w") / 2).alias("x1"), F.col("cy").alias("y1"), (F.col("cx") + F.col("w") / 2).alias("x2"), F.col("cy").alias("y2"))
    return berths.extended_edges(edges, view(spark, d, "pts"), step=1.0, most=10.0, along=0.4137, half=1.0137, least=2)


@query("ker03_raster_candidates")
def ker03(spark, d):
    p = view(spark, d, "pts")
    cells = p.select(F.col("kf").alias("key"), geo.floor_int(F.col("x") / 2).alias("u"), geo.floor_int(F.col("y") / 2).alias("v")).distinct()
    found = berths.raster_candidates(cells, 2.0, 0.0, 0.0)
    return found.select("key", "rank", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "w", "l")], F.round("angle", 2).alias("angle"), "cells")


@query("join14_dynamic_clusters")
def join14(spark, d):
    """Strips of a keyframe's points as its clusters, fifty keyframes a session."""
    p = view(spark, d, "pts")
    parts = p.select(F.floor(F.col("kf") / 50).alias("key"), F.col("kf").alias("frame"), (F.col("kf") * 0.1).alias("ts"), F.floor(F.col("x") / 50).alias("cluster"), "x", "y", "z")
    return dynamics.dynamic_clusters(parts)


@query("str10_berths_along_a_line", """WITH m AS (SELECT session, avg(cy) AS m FROM berths GROUP BY session), b AS (SELECT b.*, m.m, abs(cy - cos(radians(angle)) * l / 2e0 - m.m) AS g0, abs(cy + sin(radians(angle)) * w / 2e0 - m.m) AS g1, abs(cy + cos(radians(angle)) * l / 2e0 - m.m) AS g2, abs(cy - sin(radians(angle)) * w / 2e0 - m.m) AS g3 FROM berths b JOIN m ON m.session = b.session),
 e AS (SELECT *, CASE least(g0, g1, g2, g3) WHEN g0 THEN 0 WHEN g1 THEN 1 WHEN g2 THEN 2 ELSE 3 END AS edge, kind = 1 AND least(g0, g1, g2, g3) <= 20e0 AS ok FROM b)
 SELECT id, ok AS aligned, round(CASE WHEN NOT ok THEN cy WHEN edge = 0 THEN m + l / 2e0 WHEN edge = 1 THEN m - w / 2e0 WHEN edge = 2 THEN m - l / 2e0 ELSE m + w / 2e0 END, 4) AS cy, CASE WHEN NOT ok THEN angle WHEN edge % 2 = 0 THEN 0e0 ELSE 90e0 END AS angle FROM e""")
def str10(spark, d):
    b = view(spark, d, "berths").withColumnRenamed("session", "key")
    ends = {"x1": F.lit(-200.0), "y1": F.col("m"), "x2": F.lit(200.0), "y2": F.col("m"), "side": F.lit(0)}
    lines = b.groupBy("key").agg(F.avg("cy").alias("m")).withColumns(ends).drop("m")
    return berths.aligned_berths(b, lines, most=20.0).select("id", "aligned", F.round("cy", 4).alias("cy"), "angle")
