"""Aggregation, window, ordering, set and scalar queries, each with the SQL that must give equal rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import geo
from fathomline.operators import folds, maps, spatial, temporal
from fathomline.plans.catalog import WORLD, r6, world
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


VOX = "CAST(floor({c} / {s}) AS BIGINT)"


def vox(size: str, cols: str = "x y z") -> str:
    return ", ".join(VOX.format(c=c, s=size) + f" AS v{c}" for c in cols.split())


# --- aggregations ------------------------------------------------------------------------------
TILED = f"""WITH {WORLD}, t AS (SELECT *, CAST(floor(wx / 50e0) AS BIGINT) AS tile_x, CAST(floor(wy / 50e0) AS BIGINT) AS tile_y FROM wpts),
 l AS (SELECT * FROM t, (SELECT 0 AS lod, 1.0e0 AS voxel UNION ALL SELECT 1, 0.3e0 UNION ALL SELECT 2, 0.1e0) x),
 v AS (SELECT *, row_number() OVER (PARTITION BY lod, tile_x, tile_y, floor((wx - tile_x * 50e0) / voxel), floor((wy - tile_y * 50e0) / voxel), floor(wz / voxel) ORDER BY kf, idx) AS rn FROM l),
 tiles AS (SELECT * FROM v WHERE rn = 1) """


@query("agg01_tile_voxels", TILED + "SELECT lod, tile_x, tile_y, kf, idx FROM tiles")
def agg01(spark, d):
    return maps.build_tiles(world(spark, d)).select("lod", "tile_x", "tile_y", "kf", "idx")


@query("agg02_display_voxels", f"""SELECT kf, idx FROM (SELECT kf, idx, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY kf, idx) AS rn FROM (SELECT kf, idx, {vox('0.3e0')} FROM pts)) WHERE rn = 1""")
def agg02(spark, d):
    return maps.first_per_voxel(view(spark, d, "pts"), 0.3, [], ["kf", "idx"]).select("kf", "idx")


@query("agg03_voxel_centroids", f"SELECT kf, vx, vy, vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM (SELECT kf, x, y, z, {vox('5e0')} FROM pts) GROUP BY kf, vx, vy, vz")
def agg03(spark, d):
    c = maps.voxel_centroids(view(spark, d, "pts"), 5.0, ["kf"])
    return c.select("kf", "vx", "vy", "vz", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"), "n")


@query("agg04_distinct_voxels", f"SELECT kf, count(*) AS voxels FROM (SELECT DISTINCT kf, {vox('2e0')} FROM pts) GROUP BY kf")
def agg04(spark, d):
    return maps.distinct_voxels(view(spark, d, "pts"), 2.0, ["kf"])


@query("agg05_cell_statistics", """SELECT CAST(floor(x / 10e0) AS BIGINT) AS cx, CAST(floor(y / 10e0) AS BIGINT) AS cy, count(*) AS n, count(DISTINCT kf) AS keyframes, round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z FROM pts GROUP BY 1, 2""")
def agg05(spark, d):
    c = maps.cell_statistics(view(spark, d, "pts"), 10.0)
    return c.select("cx", "cy", "n", "keyframes", F.round("sum_x", 4).alias("sum_x"), F.round("sum_y", 4).alias("sum_y"), r6("min_z").alias("min_z"), r6("max_z").alias("max_z"))


BITS = """b AS (SELECT cx, cy, cz, (vx - 32 * cx) + 32 * (vy - 32 * cy) + 1024 * (vz - 10 * cz) AS bit FROM (SELECT vx, vy, vz, CAST(floor(vx / 32e0) AS BIGINT) AS cx, CAST(floor(vy / 32e0) AS BIGINT) AS cy, CAST(floor(vz / 10e0) AS BIGINT) AS cz
 FROM (SELECT CAST(floor(x / 0.5e0) AS BIGINT) AS vx, CAST(floor(y / 0.5e0) AS BIGINT) AS vy, CAST(floor(z / 0.5e0) AS BIGINT) AS vz FROM pts)))"""


@query("agg06_occupancy_bitmap", f"WITH {BITS} SELECT cx, cy, cz, CAST(bit // 8 AS INT) AS byte, bit_or(CAST(1 << CAST(bit % 8 AS INT) AS INT)) AS bits FROM b GROUP BY 1, 2, 3, 4")
def agg06(spark, d):
    return maps.occupancy_bytes(view(spark, d, "pts"), 0.5)


@query("agg06b_occupancy_chunks", f"""WITH {BITS}, y AS (SELECT cx, cy, cz, bit // 8 AS byte, bit_or(1 << CAST(bit % 8 AS INT)) AS bits FROM b GROUP BY 1, 2, 3, 4)
 SELECT cx, cy, cz, 1280 AS size, CAST(sum(bit_count(bits)) AS BIGINT) AS voxels FROM y GROUP BY 1, 2, 3""")
def agg06b(spark, d):
    c = maps.occupancy_chunks(view(spark, d, "pts"), 0.5)
    nibbles = F.array_remove(F.split(F.hex("bits"), ""), "")
    ones = F.aggregate(nibbles, F.lit(0).cast("long"), lambda a, x: a + F.bit_count(F.conv(x, 16, 10).cast("long")))
    return c.select("cx", "cy", "cz", F.length("bits").alias("size"), ones.alias("voxels"))


@query("agg08_tile_catalogue", TILED + """SELECT lod, tile_x, tile_y, count(*) AS point_count, round(min(wx), 4) AS min_x, round(max(wx), 4) AS max_x, round(min(wy), 4) AS min_y, round(max(wy), 4) AS max_y, round(min(wz), 4) AS min_z, round(max(wz), 4) AS max_z,
 count(*) * 13 AS byte_size, 'L' || lod || '/tile_' || tile_x || '_' || tile_y || '.tilebin' AS path FROM tiles GROUP BY lod, tile_x, tile_y""")
def agg08(spark, d):
    c = maps.tile_catalogue(maps.build_tiles(world(spark, d)))
    return c.select("lod", "tile_x", "tile_y", "point_count", *[F.round(f"{m}_{a}", 4).alias(f"{m}_{a}") for a in "xyz" for m in ("min", "max")], "byte_size", "path")


@query("agg08b_lod_rollup", TILED + "SELECT lod, tile_x, tile_y, count(*) AS n FROM tiles GROUP BY ROLLUP (lod, tile_x, tile_y)")
def agg08b(spark, d):
    return maps.build_tiles(world(spark, d)).rollup("lod", "tile_x", "tile_y").agg(F.count("*").alias("n"))


@query("agg09_stable_cells", """SELECT CAST(floor(x / 20e0) AS BIGINT) AS cx, CAST(floor(y / 20e0) AS BIGINT) AS cy, round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y, count(DISTINCT kf) AS keyframes FROM pts GROUP BY 1, 2 HAVING count(DISTINCT kf) >= 40""")
def agg09(spark, d):
    c = maps.cell_statistics(view(spark, d, "pts"), 20.0).filter("keyframes >= 40")
    return c.select("cx", "cy", F.round("mean_x", 4).alias("mean_x"), F.round("mean_y", 4).alias("mean_y"), "keyframes")


@query("agg10_stable_regions", """WITH RECURSIVE cells AS (SELECT CAST(floor(x / 10e0) AS BIGINT) AS cx, CAST(floor(y / 10e0) AS BIGINT) AS cy, count(*) AS n, count(DISTINCT kf) AS k FROM pts GROUP BY 1, 2 HAVING count(DISTINCT kf) >= 4),
 r AS (SELECT cx, cy, cx * 2147483648 + cy AS label FROM cells UNION SELECT c.cx, c.cy, r.label FROM r JOIN cells c ON abs(c.cx - r.cx) <= 1 AND abs(c.cy - r.cy) <= 1),
 m AS (SELECT cx, cy, min(label) AS label FROM r GROUP BY 1, 2)
 SELECT label AS component, count(*) AS cells, CAST(sum(n) AS BIGINT) AS points, count(*) * 100e0 AS area, min(k) AS min_seen, max(k) AS max_seen FROM m JOIN cells USING (cx, cy) GROUP BY label HAVING count(*) >= 2""")
def agg10(spark, d):
    return maps.stable_regions(view(spark, d, "pts"), 10.0, 4, 2).select("component", "cells", "points", "area", "min_seen", "max_seen")


@query("agg11_euclidean_clusters", """WITH RECURSIVE p AS (SELECT * FROM vec), e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.0025e0),
 r AS (SELECT vec_id AS n, vec_id AS lab FROM p UNION SELECT e.b, r.lab FROM r JOIN e ON r.n = e.a), m AS (SELECT n, min(lab) AS lab FROM r GROUP BY n)
 SELECT lab AS component, count(*) AS size, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(min(z), 6) AS min_z FROM m JOIN p ON p.vec_id = m.n GROUP BY lab HAVING count(*) >= 2""")
def agg11(spark, d):
    v = view(spark, d, "vec").select("vec_id", "x", "y", "z")
    pairs = spatial.radius_pairs(v, 0.05, "vec_id").select(F.col("vec_id").alias("a"), F.col("r_vec_id").alias("b"))
    labels = spatial.connected_components(v.select(F.col("vec_id").alias("node")), pairs)
    c = v.join(labels, v.vec_id == labels.node).groupBy("component").agg(F.count("*").alias("size"), r6(F.avg("x")).alias("cx"), r6(F.avg("y")).alias("cy"), r6(F.min("z")).alias("min_z"))
    return c.filter("size >= 2")


@query("agg13_plane_moments", "SELECT kf, round(sum(x*x), 3) AS xx, round(sum(x*y), 3) AS xy, round(sum(x*z), 3) AS xz, round(sum(z*z), 3) AS zz, count(*) AS n FROM pts GROUP BY kf")
def agg13(spark, d):
    p = view(spark, d, "pts")
    m = {"xx": ("x", "x"), "xy": ("x", "y"), "xz": ("x", "z"), "zz": ("z", "z")}
    return p.groupBy("kf").agg(*[F.round(F.sum(F.col(a) * F.col(b)), 3).alias(k) for k, (a, b) in m.items()], F.count("*").alias("n"))


@query("agg14_knn_density", """SELECT vec_id, round(sum(d2), 6) AS density, count(*) AS n FROM (SELECT a.vec_id, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.vec_id) AS r FROM vec a, vec b WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.04e0) WHERE r <= 10 GROUP BY vec_id""")
def agg14(spark, d):
    v = view(spark, d, "vec").select("vec_id", "x", "y", "z")
    return spatial.knn(v, v, 10, 0.2, "vec_id", "vec_id").groupBy("vec_id").agg(r6(F.sum("d2")).alias("density"), F.count("*").alias("n"))


@query("agg16_quantiles", "SELECT kf, round(quantile_cont(z, 0.5), 6) AS median, round(quantile_cont(x, 0.9), 6) AS p90 FROM pts GROUP BY kf")
def agg16(spark, d):
    return view(spark, d, "pts").groupBy("kf").agg(r6(F.percentile("z", 0.5)).alias("median"), r6(F.percentile("x", 0.9)).alias("p90"))


@query("agg17_trimmed_rmse", """WITH d AS (SELECT kf, abs(z - 0.5e0) AS e, row_number() OVER (PARTITION BY kf ORDER BY abs(z - 0.5e0), idx) AS r, count(*) OVER (PARTITION BY kf) AS n FROM pts)
 SELECT kf, round(sqrt(avg(e * e)), 6) AS rmse, count(*) AS used FROM d WHERE r <= ceil(0.9e0 * n) GROUP BY kf""")
def agg17(spark, d):
    w = Window.partitionBy("kf")
    e = view(spark, d, "pts").withColumn("e", F.abs(F.col("z") - 0.5))
    e = e.withColumn("r", F.row_number().over(w.orderBy("e", "idx"))).withColumn("n", F.count("*").over(w)).filter(F.col("r") <= F.ceil(0.9 * F.col("n")))
    return e.groupBy("kf").agg(r6(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rmse"), F.count("*").alias("used"))


@query("agg18_axis_mean", "SELECT session, round(((degrees(atan2(sum(sin(radians(2 * angle))), sum(cos(radians(2 * angle))))) / 2e0) + 180e0) % 180e0, 5) AS angle, round(avg(w), 5) AS w FROM berths GROUP BY session")
def agg18(spark, d):
    b = view(spark, d, "berths")
    axis = F.degrees(F.atan2(F.sum(F.sin(F.radians(2 * F.col("angle")))), F.sum(F.cos(F.radians(2 * F.col("angle")))))) / 2
    return b.groupBy("session").agg(F.round(geo.angle_180(axis), 5).alias("angle"), F.round(F.avg("w"), 5).alias("w"))


@query("agg19_weighted_merge", "SELECT session, kind, round(sum(cx * hits) / sum(hits), 5) AS cx, round(sum(l * hits) / sum(hits), 5) AS l, CAST(sum(hits) AS BIGINT) AS n FROM berths GROUP BY session, kind")
def agg19(spark, d):
    weighted = lambda c: F.round(F.sum(F.col(c) * F.col("hits")) / F.sum("hits"), 5).alias(c)
    return view(spark, d, "berths").groupBy("session", "kind").agg(weighted("cx"), weighted("l"), F.sum("hits").alias("n"))


@query("agg20_confidence", "SELECT id, round((hits + 2 * (hits % 7) + (hits % 5)) / (1e0 + hits), 6) AS confidence FROM berths")
def agg20(spark, d):
    edges = F.array("hits", 2 * (F.col("hits") % 7), F.col("hits") % 5)
    return view(spark, d, "berths").select("id", r6(F.aggregate(edges, F.lit(0).cast("int"), lambda a, x: a + x) / (1.0 + F.col("hits"))).alias("confidence"))


@query("agg21_packet_rates", "SELECT CAST(floor(ts / 21600e0) AS BIGINT) AS slot, sensor, count(*) AS packets, round(count(*) / 21600e0, 8) AS rate FROM frames GROUP BY 1, 2")
def agg21(spark, d):
    return view(spark, d, "frames").groupBy(F.floor(F.col("ts") / 21600.0).alias("slot"), "sensor").agg(F.count("*").alias("packets"), F.round(F.count("*") / 21600.0, 8).alias("rate"))


@query("agg22_procrustes", """WITH p AS (SELECT label, x, y, 0.8e0 * x - 0.6e0 * y + 0.1e0 * z AS tx, 0.6e0 * x + 0.8e0 * y AS ty FROM vec),
 c AS (SELECT *, x - avg(x) OVER w AS sx, y - avg(y) OVER w AS sy, tx - avg(tx) OVER w AS ux, ty - avg(ty) OVER w AS uy FROM p WINDOW w AS (PARTITION BY label))
 SELECT label, round(atan2(sum(sx * uy - sy * ux), sum(sx * ux + sy * uy)), 6) AS yaw FROM c GROUP BY label""")
def agg22(spark, d):
    p = view(spark, d, "vec").select("label", "x", "y", (0.8 * F.col("x") - 0.6 * F.col("y") + 0.1 * F.col("z")).alias("tx"), (0.6 * F.col("x") + 0.8 * F.col("y")).alias("ty"))
    n = F.count("*")
    cov = lambda a, b: F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n
    return p.groupBy("label").agg(r6(F.atan2(cov("x", "ty") - cov("y", "tx"), cov("x", "tx") + cov("y", "ty"))).alias("yaw"))


@query("agg23_shape_pca", """WITH m AS (SELECT label, covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(y, y) AS c FROM vec GROUP BY label)
 SELECT label, round((a + c) / 2e0 + sqrt((a - c) * (a - c) / 4e0 + b * b), 8) AS major, round((a + c) / 2e0 - sqrt((a - c) * (a - c) / 4e0 + b * b), 8) AS minor FROM m""")
def agg23(spark, d):
    m = view(spark, d, "vec").groupBy("label").agg(F.covar_pop("x", "x").alias("a"), F.covar_pop("x", "y").alias("b"), F.covar_pop("y", "y").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    root = F.sqrt((a - c) * (a - c) / 4 + b * b)
    return m.select("label", F.round((a + c) / 2 + root, 8).alias("major"), F.round((a + c) / 2 - root, 8).alias("minor"))


@query("agg24_bearing_profile", "SELECT kf, CAST(floor(degrees(atan2(y, x)) / 5e0) AS BIGINT) AS bin, round(min(z), 6) AS ceiling, count(*) AS n FROM pts GROUP BY 1, 2")
def agg24(spark, d):
    bin_ = geo.floor_int(F.degrees(F.atan2("y", "x")) / 5)
    return view(spark, d, "pts").groupBy("kf", bin_.alias("bin")).agg(r6(F.min("z")).alias("ceiling"), F.count("*").alias("n"))


@query("agg25_fitness", "SELECT kf, count(*) FILTER (WHERE z * z <= 0.5e0) AS inliers, round(avg(z * z), 6) AS fitness FROM pts GROUP BY kf")
def agg25(spark, d):
    z2 = F.col("z") * F.col("z")
    return view(spark, d, "pts").groupBy("kf").agg(F.count_if(z2 <= 0.5).alias("inliers"), r6(F.avg(z2)).alias("fitness"))


@query("agg26_last_per_voxel", f"SELECT kf, idx FROM (SELECT kf, idx, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY kf DESC, idx DESC) AS rn FROM (SELECT kf, idx, {vox('1e0')} FROM pts)) WHERE rn = 1")
def agg26(spark, d):
    return maps.last_per_voxel(view(spark, d, "pts"), 1.0, [], ["kf", "idx"]).select("kf", "idx")


# --- windows -----------------------------------------------------------------------------------
@query("win01_centred_median", "SELECT id, round(quantile_cont(value, 0.5) OVER (PARTITION BY sensor, unit ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS median FROM nav")
def win01(spark, d):
    return temporal.centred_median(view(spark, d, "nav"), ["sensor", "unit"], "ts", "value").select("id", r6("median").alias("median"))


NEIGHBOUR = """n AS (SELECT id, value, [lag(value, 2) OVER w, lag(value, 1) OVER w, lead(value, 1) OVER w, lead(value, 2) OVER w] AS a FROM nav WINDOW w AS (PARTITION BY sensor, unit ORDER BY ts)),
 m AS (SELECT id, value, list_median(list_filter(a, lambda x: x IS NOT NULL)) AS med FROM n)"""


@query("win03_outlier_flags", f"WITH {NEIGHBOUR} SELECT id, abs(value - med) > 30e0 AS outlier FROM m")
def win03(spark, d):
    n = temporal.neighbour_median(view(spark, d, "nav"), ["sensor", "unit"], "ts", "value")
    return n.select("id", (F.abs(F.col("value") - F.col("neighbour_median")) > 30.0).alias("outlier"))


@query("win02_angle_unwrap", """SELECT id, round(yaw_deg + 360e0 * sum(t) OVER (PARTITION BY sensor, unit ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS unwrapped FROM
 (SELECT *, coalesce(floor((lag(yaw_deg) OVER (PARTITION BY sensor, unit ORDER BY ts) - yaw_deg) / 360e0 + 0.5e0), 0) AS t FROM nav)""")
def win02(spark, d):
    return temporal.unwrap_degrees(view(spark, d, "nav"), ["sensor", "unit"], "ts", "yaw_deg").select("id", F.round("unwrapped", 4).alias("unwrapped"))


@query("win05_clock_repair", """SELECT seq, round(sum(CASE WHEN p IS NULL THEN 0e0 WHEN ts - p > 1000e0 AND ts - p < 30000e0 THEN ts - p ELSE 5000e0 END) OVER (PARTITION BY sensor, unit ORDER BY seq ROWS UNBOUNDED PRECEDING), 3) AS clock FROM (SELECT *, lag(ts) OVER (PARTITION BY sensor, unit ORDER BY seq) AS p FROM frames)""")
def win05(spark, d):
    return temporal.repaired_clock(view(spark, d, "frames"), ["sensor", "unit"], "seq", "ts", 1000.0, 30000.0, 5000.0).select("seq", F.round("clock", 3).alias("clock"))


RM = "(6378137e0 * (1 - 0.0066943799901413165e0) / pow(1 - 0.0066943799901413165e0 * pow(sin(radians(lat)), 2), 1.5e0))"
RN = "(6378137e0 / sqrt(1 - 0.0066943799901413165e0 * pow(sin(radians(lat)), 2)))"


@query("win06_incremental_enu", f"""SELECT id, round(sum(e) OVER w, 3) AS east, round(sum(n) OVER w, 3) AS north, round(sum(u) OVER w, 3) AS up FROM (SELECT id, sensor, unit, ts, coalesce(radians(lon - lag(lon) OVER v) * ({RN} + alt) * cos(radians(lat)), 0e0) AS e,
 coalesce(radians(lat - lag(lat) OVER v) * ({RM} + alt), 0e0) AS n, coalesce(alt - lag(alt) OVER v, 0e0) AS u FROM nav WINDOW v AS (PARTITION BY sensor, unit ORDER BY ts)) WINDOW w AS (PARTITION BY sensor, unit ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def win06(spark, d):
    v = Window.partitionBy("sensor", "unit").orderBy("ts")
    w = v.rowsBetween(Window.unboundedPreceding, 0)
    step = lambda c: F.col(c) - F.lag(c).over(v)
    n = view(spark, d, "nav")
    n = n.withColumn("e", F.coalesce(F.radians(step("lon")) * (geo.prime_vertical_radius(F.col("lat")) + F.col("alt")) * F.cos(F.radians("lat")), F.lit(0.0)))
    n = n.withColumn("n", F.coalesce(F.radians(step("lat")) * (geo.meridian_radius(F.col("lat")) + F.col("alt")), F.lit(0.0))).withColumn("u", F.coalesce(step("alt"), F.lit(0.0)))
    return n.select("id", *[F.round(F.sum(c).over(w), 3).alias(k) for c, k in (("e", "east"), ("n", "north"), ("u", "up"))])


@query("win07_odometry_delta", """SELECT kf, round(sqrt(pow(tx - lag(tx) OVER w, 2) + pow(ty - lag(ty) OVER w, 2)), 5) AS moved, coalesce(sqrt(pow(tx - lag(tx) OVER w, 2) + pow(ty - lag(ty) OVER w, 2)) > 30e0, false) AS jump FROM kfs WINDOW w AS (PARTITION BY map ORDER BY ts)""")
def win07(spark, d):
    w = Window.partitionBy("map").orderBy("ts")
    dx, dy = F.col("tx") - F.lag("tx").over(w), F.col("ty") - F.lag("ty").over(w)
    moved = F.sqrt(dx * dx + dy * dy)
    return view(spark, d, "kfs").select("kf", F.round(moved, 5).alias("moved"), F.coalesce(moved > 30.0, F.lit(False)).alias("jump"))


@query("win08_keyframe_selection", """WITH RECURSIVE p AS (SELECT unit AS key, ts, lat * 1e5 AS x, alt AS y, row_number() OVER (PARTITION BY unit ORDER BY ts) AS r FROM nav),
 s AS (SELECT key, r, ts, x, y, x AS lx, y AS ly, true AS kept FROM p WHERE r = 1 UNION ALL SELECT p.key, p.r, p.ts, p.x, p.y, CASE WHEN sqrt(pow(p.x - s.lx, 2) + pow(p.y - s.ly, 2)) > 20e0 THEN p.x ELSE s.lx END, CASE WHEN sqrt(pow(p.x - s.lx, 2) + pow(p.y - s.ly, 2)) > 20e0 THEN p.y ELSE s.ly END, sqrt(pow(p.x - s.lx, 2) + pow(p.y - s.ly, 2)) > 20e0 FROM s JOIN p ON p.key = s.key AND p.r = s.r + 1)
 SELECT key, CAST(floor(ts) AS BIGINT) AS ts FROM s WHERE kept""")
def win08(spark, d):
    p = view(spark, d, "nav").select(F.col("unit").alias("key"), "ts", (F.col("lat") * 1e5).alias("x"), F.col("alt").alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("yaw"))
    return folds.select_keyframes(p, 20.0, 5.0).select("key", F.floor("ts").alias("ts"))


@query("win09_retention", "SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY sensor, unit ORDER BY ts DESC) AS r, max(ts) OVER (PARTITION BY sensor, unit) - ts AS age FROM frames) WHERE r <= 20 AND age <= 360000e0")
def win09(spark, d):
    w = Window.partitionBy("sensor", "unit")
    f = view(spark, d, "frames").withColumn("r", F.row_number().over(w.orderBy(F.desc("ts")))).withColumn("age", F.max("ts").over(w) - F.col("ts"))
    return f.filter("r <= 20 AND age <= 360000").select("seq")


@query("win10_size_smoothing", "SELECT id, round(least(w, 1.1e0 * avg(w) OVER (PARTITION BY session ORDER BY id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), 6) AS w FROM berths")
def win10(spark, d):
    w = Window.partitionBy("session").orderBy("id").rowsBetween(-9, 0)
    return view(spark, d, "berths").select("id", r6(F.least(F.col("w"), 1.1 * F.avg("w").over(w))).alias("w"))


@query("win11_longest_gap", "SELECT kf, round(max(g), 6) AS gap FROM (SELECT kf, x - lag(x) OVER (PARTITION BY kf ORDER BY x, idx) AS g FROM pts) GROUP BY kf")
def win11(spark, d):
    w = Window.partitionBy("kf").orderBy("x", "idx")
    return view(spark, d, "pts").withColumn("g", F.col("x") - F.lag("x").over(w)).groupBy("kf").agg(r6(F.max("g")).alias("gap"))


@query("win12_frame_split", "SELECT id, CAST(sum(CASE WHEN yaw_deg < p THEN 1 ELSE 0 END) OVER (PARTITION BY sensor, unit ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS frame FROM (SELECT *, lag(yaw_deg) OVER (PARTITION BY sensor, unit ORDER BY id) AS p FROM nav)")
def win12(spark, d):
    w = Window.partitionBy("sensor", "unit").orderBy("id")
    return temporal.islands(view(spark, d, "nav"), ["sensor", "unit"], ["id"], F.col("yaw_deg") < F.lag("yaw_deg").over(w), "frame").select("id", "frame")


@query("win13_ema", """SELECT session, round(list_reduce(list(w ORDER BY id), lambda a, x: a + 0.35e0 * (x - a)), 6) AS w FROM berths GROUP BY session""")
def win13(spark, d):
    b = view(spark, d, "berths").groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "w"))), lambda s: s["w"].cast("double")).alias("a"))
    return b.select("session", r6(temporal.ema(F.col("a"), 0.35)).alias("w"))


@query("win14_packet_numbers", "SELECT id, CAST(floor(r / 10e0) AS BIGINT) AS packet, r % 10 AS slot FROM (SELECT id, session, row_number() OVER (PARTITION BY session ORDER BY id) - 1 AS r FROM berths)")
def win14(spark, d):
    r = (F.row_number().over(Window.partitionBy("session").orderBy("id")) - 1).cast("long")
    return view(spark, d, "berths").withColumn("r", r).select("id", F.floor(F.col("r") / 10).alias("packet"), (F.col("r") % 10).alias("slot"))


@query("win15_hole_profile", """WITH b AS (SELECT kf, CAST(floor(x / 10e0) AS BIGINT) AS bin, min(z) AS h FROM pts GROUP BY 1, 2), c AS (SELECT *, max(h) OVER (PARTITION BY kf ORDER BY bin ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS ceiling FROM b),
 o AS (SELECT *, h > -0.6e0 AND ceiling - h < 0.5e0 AS open, bin - row_number() OVER (PARTITION BY kf, h > -0.6e0 AND ceiling - h < 0.5e0 ORDER BY bin) AS run FROM c)
 SELECT kf, min(bin) AS first_bin, count(*) AS bins, round(max(h), 6) AS top FROM o WHERE open GROUP BY kf, run""")
def win15(spark, d):
    b = view(spark, d, "pts").groupBy("kf", geo.floor_int(F.col("x") / 10).alias("bin")).agg(F.min("z").alias("h"))
    c = b.withColumn("ceiling", F.max("h").over(Window.partitionBy("kf").orderBy("bin").rowsBetween(-8, 8)))
    o = c.filter((F.col("h") > -0.6) & (F.col("ceiling") - F.col("h") < 0.5))
    o = o.withColumn("run", F.col("bin") - F.row_number().over(Window.partitionBy("kf").orderBy("bin")))
    return o.groupBy("kf", "run").agg(F.min("bin").alias("first_bin"), F.count("*").alias("bins"), r6(F.max("h")).alias("top")).drop("run")


@query("win16_motion_heading", """SELECT kf, other FROM (SELECT a.kf, b.kf AS other, row_number() OVER (PARTITION BY a.kf ORDER BY b.ts DESC) AS r FROM kfs a JOIN kfs b ON a.map = b.map AND b.ts < a.ts AND pow(a.tx - b.tx, 2) + pow(a.ty - b.ty, 2) >= 900e0) WHERE r = 1""")
def win16(spark, d):
    k = view(spark, d, "kfs").select("kf", "map", "ts", "tx", "ty")
    b = k.select(F.col("kf").alias("other"), F.col("map").alias("m2"), F.col("ts").alias("t2"), F.col("tx").alias("x2"), F.col("ty").alias("y2"))  # 500 keyframes a map
    return temporal.last_apart(k.join(b, (F.col("m2") == F.col("map")) & (F.col("t2") < F.col("ts"))), "kf", "other", "t2", F.col("tx") - F.col("x2"), F.col("ty") - F.col("y2"), 900.0)


# --- sorts, limits and sets --------------------------------------------------------------------
@query("srt01_map_order", "SELECT session, CAST(row_number() OVER (ORDER BY first, session) AS BIGINT) AS rank FROM (SELECT session, min(ts) AS first FROM berths GROUP BY session)")
def srt01(spark, d):
    m = view(spark, d, "berths").groupBy("session").agg(F.min("ts").alias("first"))
    return m.select("session", F.row_number().over(Window.orderBy("first", "session")).cast("long").alias("rank"))


@query("srt03_top_candidates", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY session ORDER BY w * l DESC, id) AS r FROM berths) WHERE r <= 12")
def srt03(spark, d):
    r = F.row_number().over(Window.partitionBy("session").orderBy(F.desc(F.col("w") * F.col("l")), "id"))
    return view(spark, d, "berths").withColumn("r", r).filter("r <= 12").select("id")


@query("srt04_best_per_side", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY session, cy > 0 ORDER BY hits DESC, id) AS r FROM berths) WHERE r = 1")
def srt04(spark, d):
    return view(spark, d, "berths").groupBy("session", F.col("cy") > 0).agg(F.min_by("id", F.struct(-F.col("hits"), "id")).alias("id")).select("id")


@query("srt05_nearest_per_side", "SELECT kf, idx FROM (SELECT kf, idx, row_number() OVER (PARTITION BY kf, y >= 0 ORDER BY x*x + y*y, idx) AS r FROM pts WHERE x*x + y*y <= 10000e0) WHERE r <= 3")
def srt05(spark, d):
    c2 = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    p = view(spark, d, "pts").filter(c2 <= 10000.0).withColumn("r", F.row_number().over(Window.partitionBy("kf", F.col("y") >= 0).orderBy(c2, "idx")))
    return p.filter("r <= 3").select("kf", "idx")


@query("srt09_registration_cap", "SELECT kf, idx FROM (SELECT kf, idx, count(*) OVER (PARTITION BY kf) AS n FROM pts) WHERE idx = 0 OR floor(idx * 60e0 / n) <> floor((idx - 1) * 60e0 / n)")
def srt09(spark, d):
    p = view(spark, d, "pts")
    p = p.join(p.groupBy("kf").agg(F.count("*").alias("n")), "kf")
    at = lambda i: F.floor(i * 60.0 / F.col("n"))
    return p.filter((F.col("idx") == 0) | (at(F.col("idx")) != at(F.col("idx") - 1))).select("kf", "idx")


@query("srt11_second_highest", """WITH a AS (SELECT kf, arg_max(struct_pack(idx := idx, x := x, y := y, z := z), struct_pack(z := z, i := -idx)) AS t FROM pts GROUP BY kf)
 SELECT p.kf, arg_max(p.idx, struct_pack(z := p.z, i := -p.idx)) AS idx FROM pts p JOIN a ON p.kf = a.kf WHERE pow(p.x - t.x, 2) + pow(p.y - t.y, 2) >= 900e0 GROUP BY p.kf""")
def srt11(spark, d):
    p = view(spark, d, "pts")
    order = F.struct("z", -F.col("idx"))
    top = p.groupBy("kf").agg(F.max_by(F.struct(F.col("x").alias("tx"), F.col("y").alias("ty")), order).alias("t"))
    far = p.join(top, "kf").filter((F.col("x") - F.col("t.tx")) ** 2 + (F.col("y") - F.col("t.ty")) ** 2 >= 900.0)
    return far.groupBy("kf").agg(F.max_by("idx", order).alias("idx"))


@query("set01_sensor_union", "SELECT sensor, count(*) AS n FROM (SELECT sensor, ts FROM frames WHERE generation = 0 UNION ALL SELECT sensor, ts FROM frames WHERE generation = 1) GROUP BY sensor")
def set01(spark, d):
    f = view(spark, d, "frames").select("sensor", "ts", "generation")
    return f.filter("generation = 0").unionByName(f.filter("generation = 1")).groupBy("sensor").agg(F.count("*").alias("n"))


@query("set02_append_maps", "SELECT id, CAST(row_number() OVER (ORDER BY session, ts, id) - 1 AS BIGINT) AS new_id FROM berths")
def set02(spark, d):
    return maps.append_maps(view(spark, d, "berths"), ["session"], ["ts", "id"]).select("id", "new_id")


VIEWPORT = "a AS (SELECT DISTINCT CAST(floor(cx / 50e0) AS BIGINT) AS tile_x, CAST(floor(cy / 50e0) AS BIGINT) AS tile_y FROM berths WHERE opening_edge = 0)"
RING = "e AS (SELECT DISTINCT tile_x + dx AS tile_x, tile_y + dy AS tile_y FROM a, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy))"


def active(spark, d, ring=0):
    b = view(spark, d, "berths").filter("opening_edge = 0").selectExpr("cx AS min_x", "cy AS min_y", "cx AS max_x", "cy AS max_y")
    return maps.viewport_tiles(b, ring=ring)


@query("set03_prefetch_tiles", f"WITH {VIEWPORT}, {RING} SELECT * FROM e EXCEPT SELECT * FROM a")
def set03(spark, d):
    return active(spark, d, 1).join(active(spark, d), ["tile_x", "tile_y"], "left_anti")


@query("set04_ring_expansion", f"WITH {VIEWPORT}, {RING} SELECT * FROM e")
def set04(spark, d):
    return active(spark, d, 1)


@query("set05_two_lod_choice", """WITH f AS (SELECT DISTINCT CAST(floor(x / 10e0) AS BIGINT) AS cx, CAST(floor(y / 10e0) AS BIGINT) AS cy FROM pts WHERE z > 2.5e0), c AS (SELECT DISTINCT CAST(floor(x / 10e0) AS BIGINT) AS cx, CAST(floor(y / 10e0) AS BIGINT) AS cy FROM pts)
 SELECT coalesce(f.cx, c.cx) AS cx, coalesce(f.cy, c.cy) AS cy, CASE WHEN f.cx IS NOT NULL THEN 'fine' ELSE 'coarse' END AS lod FROM f FULL OUTER JOIN c ON f.cx = c.cx AND f.cy = c.cy""")
def set05(spark, d):
    p = view(spark, d, "pts")
    cells = lambda w: p.filter(w).select(geo.floor_int(F.col("x") / 10).alias("cx"), geo.floor_int(F.col("y") / 10).alias("cy")).distinct()
    fine, coarse = cells("z > 2.5").withColumn("f", F.lit("fine")), cells("true")
    return fine.join(coarse, ["cx", "cy"], "full_outer").select("cx", "cy", F.coalesce("f", F.lit("coarse")).alias("lod"))


@query("set06_merge_unless_near", """WITH a AS (SELECT * FROM berths WHERE id % 2 = 0), b AS (SELECT * FROM berths WHERE id % 2 = 1) SELECT id FROM b UNION ALL SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE pow(a.cx-b.cx, 2) + pow(a.cy-b.cy, 2) <= 25e0)""")
def set06(spark, d):
    b = view(spark, d, "berths")
    realtime, library = b.filter("id % 2 = 1"), b.filter("id % 2 = 0")
    known = spatial.radius_join(library, realtime, 5.0, ("cx", "cy")).select("id").distinct()
    return realtime.select("id").unionByName(library.join(known, "id", "left_anti").select("id"))


# --- scalars -----------------------------------------------------------------------------------
@query("scl01_tile_index", "SELECT id, CAST(floor(cx / 50e0) AS BIGINT) AS tx, CAST(floor((cy - 3e0) / 50e0) AS BIGINT) AS ty, CAST(floor(floor(cx) / 7e0) AS BIGINT) AS fd FROM berths")
def scl01(spark, d):
    return view(spark, d, "berths").select("id", geo.tile_index(F.col("cx"), 0.0, 50.0).alias("tx"), geo.tile_index(F.col("cy"), 3.0, 50.0).alias("ty"), geo.floor_div(F.floor("cx"), 7).alias("fd"))


@query("scl02_lod_for_view", "SELECT id, CASE WHEN t >= 1e0 THEN 0 WHEN t >= 0.3e0 THEN 1 ELSE 2 END AS lod FROM (SELECT id, greatest(0.02e0, 4e0 * (hits * 8e0) / 800e0) AS t FROM berths)")
def scl02(spark, d):
    return maps.choose_lod(view(spark, d, "berths").withColumn("h", F.col("hits") * 8.0), "h", 800).select("id", "lod")


@query("scl04_geodetic_to_enu", """WITH c AS (SELECT id, radians(lat) AS la, radians(lon) AS lo, alt, 6378137e0 / sqrt(1 - 0.0066943799901413165e0 * pow(sin(radians(lat)), 2)) AS n FROM nav),
 o AS (SELECT radians(35.4e0) AS la0, radians(119.5e0) AS lo0, 6378137e0 / sqrt(1 - 0.0066943799901413165e0 * pow(sin(radians(35.4e0)), 2)) AS n0),
 d AS (SELECT id, la0, lo0, (n + alt) * cos(la) * cos(lo) - (n0 + 2) * cos(la0) * cos(lo0) AS dx, (n + alt) * cos(la) * sin(lo) - (n0 + 2) * cos(la0) * sin(lo0) AS dy, (n * (1 - 0.0066943799901413165e0) + alt) * sin(la) - (n0 * (1 - 0.0066943799901413165e0) + 2) * sin(la0) AS dz FROM c, o)
 SELECT id, round(-sin(lo0) * dx + cos(lo0) * dy, 3) AS east, round(-sin(la0) * cos(lo0) * dx - sin(la0) * sin(lo0) * dy + cos(la0) * dz, 3) AS north, round(cos(la0) * cos(lo0) * dx + cos(la0) * sin(lo0) * dy + sin(la0) * dz, 3) AS up FROM d""")
def scl04(spark, d):
    e, n, u = geo.geodetic_to_enu(F.col("lat"), F.col("lon"), F.col("alt"), 35.4, 119.5, 2.0)
    return view(spark, d, "nav").select("id", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"), F.round(u, 3).alias("up"))


@query("scl05_enu_to_geodetic", f"SELECT id, round(lat + degrees(12.5e0 / ({RM} + alt)), 9) AS lat2, round(lon + degrees(-7e0 / (({RN} + alt) * cos(radians(lat)))), 9) AS lon2, round(alt - 3e0, 6) AS alt2 FROM nav")
def scl05(spark, d):
    la, lo, al = geo.enu_to_geodetic(F.lit(-7.0), F.lit(12.5), F.lit(3.0), F.col("lat"), F.col("lon"), F.col("alt"))
    return view(spark, d, "nav").select("id", F.round(la, 9).alias("lat2"), F.round(lo, 9).alias("lon2"), r6(al).alias("alt2"))


@query("scl06_equirectangular", "SELECT id, round(sqrt(pow((119.5e0 - lon) * 111320e0 * cos(radians((lat + 35.4e0) / 2e0)), 2) + pow((35.4e0 - lat) * 111320e0, 2)), 4) AS m FROM nav")
def scl06(spark, d):
    return view(spark, d, "nav").select("id", F.round(geo.equirectangular(F.col("lat"), F.col("lon"), F.lit(35.4), F.lit(119.5)), 4).alias("m"))


@query("scl07_euler_rotation", "SELECT id, round(cos(radians(10e0)) * cos(radians(yaw_deg)), 6) AS r00, round(-sin(radians(10e0)), 6) AS r20, round(sin(radians(5e0)) * cos(radians(10e0)), 6) AS r21 FROM nav")
def scl07(spark, d):
    m = geo.euler_matrix(F.lit(5.0), F.lit(10.0), F.col("yaw_deg"))
    return view(spark, d, "nav").select("id", r6(m[0][0]).alias("r00"), r6(m[2][0]).alias("r20"), r6(m[2][1]).alias("r21"))


@query("scl08_slerp_yaw", "SELECT kf, round(((yaw_deg + 360e0 + 0.25e0 * 40e0) % 360e0), 4) AS yaw FROM kfs")
def scl08(spark, d):
    q = lambda a: (F.lit(0.0), F.lit(0.0), F.sin(F.radians(a) / 2), F.cos(F.radians(a) / 2))
    s = geo.slerp(q(F.col("yaw_deg")), q(F.col("yaw_deg") + 40.0), F.lit(0.25))
    return view(spark, d, "kfs").select("kf", F.round(F.pmod(F.degrees(2 * F.atan2(s[2], s[3])), F.lit(360.0)), 4).alias("yaw"))


@query("scl10_angles", "SELECT id, round((angle * 3e0 + 900e0) % 180e0, 6) AS a180, round((angle * 3e0 + 90e0 + 900e0) % 180e0 - 90e0, 6) AS a90, round(least((angle + 143e0) % 180e0, 180e0 - (angle + 143e0) % 180e0), 6) AS gap FROM berths")
def scl10(spark, d):
    a = F.col("angle")
    return view(spark, d, "berths").select("id", r6(geo.angle_180(a * 3)).alias("a180"), r6(geo.angle_90(a * 3)).alias("a90"), r6(geo.axis_difference(a, F.lit(37.0))).alias("gap"))


@query("scl11_rect_corners", "SELECT id, k, round(cx + w * sx * cos(radians(angle)) - l * sy * sin(radians(angle)), 4) AS x, round(cy + w * sx * sin(radians(angle)) + l * sy * cos(radians(angle)), 4) AS y FROM berths, (SELECT unnest([0, 1, 2, 3]) AS k, unnest([-0.5e0, 0.5e0, 0.5e0, -0.5e0]) AS sx, unnest([-0.5e0, -0.5e0, 0.5e0, 0.5e0]) AS sy)")
def scl11(spark, d):
    c = geo.rect_corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("l"), F.col("angle"))
    return view(spark, d, "berths").select("id", F.posexplode(c).alias("k", "c")).select("id", "k", F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y"))


@query("scl13_axis_swap", "SELECT id, l AS w, w AS l, (angle + 90e0) % 180e0 AS angle, (opening_edge + 3) % 4 AS edge, (opening_edge + 2) % 4 AS opposite FROM berths")
def scl13(spark, d):
    w, l, a, e = geo.swap_axes(F.col("w"), F.col("l"), F.col("angle"), F.col("opening_edge"))
    return view(spark, d, "berths").select("id", w.alias("w"), l.alias("l"), a.alias("angle"), e.alias("edge"), geo.opposite_edge(F.col("opening_edge")).alias("opposite"))


@query("scl14_sparsest_edge", "SELECT id, list_position(a, list_min(a)) - 1 AS edge FROM (SELECT id, [hits % 5, hits % 3, hits % 7, hits % 4] AS a FROM berths)")
def scl14(spark, d):
    h = F.col("hits")
    return view(spark, d, "berths").select("id", geo.sparsest_edge(F.array(h % 5, h % 3, h % 7, h % 4)).alias("edge"))


@query("scl16_cv_rect_angle", "SELECT id, (CASE WHEN w < l THEN angle + 90e0 ELSE angle END) % 180e0 AS a FROM berths")
def scl16(spark, d):
    return view(spark, d, "berths").select("id", geo.cv_rect_angle(F.col("w"), F.col("l"), F.col("angle")).alias("a"))


@query("scl17_segment_distance", """SELECT kf, idx, round(sqrt(pow(x - (-10 + 60 * t), 2) + pow(y - (5 + 20 * t), 2)), 5) AS m FROM (SELECT kf, idx, x, y, least(greatest(((x + 10) * 60 + (y - 5) * 20) / 4000e0, 0e0), 1e0) AS t FROM pts)""")
def scl17(spark, d):
    m = geo.point_segment_distance(F.col("x"), F.col("y"), F.lit(-10.0), F.lit(5.0), F.lit(50.0), F.lit(25.0))
    return view(spark, d, "pts").select("kf", "idx", F.round(m, 5).alias("m"))


@query("scl20_wire_codes", """SELECT id, CAST(floor(lat * 2147483648e0 / 180e0 + 0.5e0) AS BIGINT) AS lat_code, CAST(floor(alt * 10e0 + 0.5e0) AS BIGINT) AS tenths, least(CAST(floor(yaw_deg * 182.04e0 + 0.5e0) AS BIGINT), 65535) AS azimuth FROM nav WHERE alt >= 0""")
def scl20(spark, d):
    n = view(spark, d, "nav").filter("alt >= 0")
    return n.select("id", geo.encode_geo(F.col("lat")).alias("lat_code"), geo.encode_tenths(F.col("alt")).alias("tenths"), geo.encode_azimuth(F.col("yaw_deg")).alias("azimuth"))


@query("scl24_timestamp_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, strftime(ts, 'snapshot_%Y%m%d_%H%M%S') AS name FROM events")
def scl24(spark, d):
    e = view(spark, d, "events")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown"), F.date_format("ts", "'snapshot'_yyyyMMdd_HHmmss").alias("name"))


@query("scl25_cache_key", "SELECT session, sha256('1|50.0|' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS key FROM berths GROUP BY session")
def scl25(spark, d):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",")
    return view(spark, d, "berths").groupBy("session").agg(F.sha2(F.concat(F.lit("1|50.0|"), ids), 256).alias("key"))


@query("scl27_pixel_bearing", "SELECT id, round(degrees(atan((hits * 20e0 - 640e0) / 800e0)), 6) AS bearing, CAST(floor((cx + 200e0) / 0.2e0) AS BIGINT) AS u, CAST(floor((200e0 - cy) / 0.2e0) AS BIGINT) AS v FROM berths")
def scl27(spark, d):
    u, v = geo.world_to_bev(F.col("cx"), F.col("cy"), -200.0, 200.0, 0.2)
    return view(spark, d, "berths").select("id", r6(geo.pixel_bearing(F.col("hits") * 20.0, 640.0, 800.0)).alias("bearing"), u.alias("u"), v.alias("v"))


@query("scl30_addresses", "SELECT seq, '10.0.0.' || port AS ip, '10.0.0.' || port || ':' || sensor AS source FROM frames")
def scl30(spark, d):
    f = view(spark, d, "frames")
    ip = geo.normal_ip(F.concat(F.lit(" ::FFFF:10.0.0."), F.col("port")))
    return f.select("seq", ip.alias("ip"), F.concat(ip, F.lit(":"), "sensor").alias("source"))


@query("scl31_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def scl31(spark, d):
    return view(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("scl35_rebase", "SELECT id, round(cx - 12.5e0, 6) AS cx, round(cy + 4e0, 6) AS cy FROM berths")
def scl35(spark, d):
    return view(spark, d, "berths").select("id", r6(F.col("cx") - 12.5).alias("cx"), r6(F.col("cy") + 4.0).alias("cy"))


# --- rasters, corrections and state that SQL can follow ----------------------------------------
@query("ker01_bev_raster", "SELECT DISTINCT kf, CAST(floor((x + 105e0) / 0.2e0) AS BIGINT) AS u, CAST(floor((105e0 - y) / 0.2e0) AS BIGINT) AS v FROM pts WHERE abs(x) <= 105e0 AND abs(y) <= 105e0")
def ker01(spark, d):
    u, v = geo.world_to_bev(F.col("x"), F.col("y"), -105.0, 105.0, 0.2)
    return view(spark, d, "pts").filter("abs(x) <= 105 AND abs(y) <= 105").select("kf", u.alias("u"), v.alias("v")).distinct()


GRID = "g AS (SELECT DISTINCT CAST(floor(x / 5e0) AS BIGINT) AS u, CAST(floor(y / 5e0) AS BIGINT) AS v FROM pts)"
AROUND = "(SELECT unnest([-1, 0, 1]) AS dx) a, (SELECT unnest([-1, 0, 1]) AS dy) b"


def bev(spark, d):
    return view(spark, d, "pts").select(geo.floor_int(F.col("x") / 5).alias("u"), geo.floor_int(F.col("y") / 5).alias("v")).distinct()


def spread(cells: DataFrame) -> DataFrame:
    return cells.select(F.explode(spatial.near_cells([F.col("u"), F.col("v")])).alias("n")).select(F.col("n.c0").alias("u"), F.col("n.c1").alias("v"))


@query("ker02_dilate", f"WITH {GRID} SELECT DISTINCT u + dx AS u, v + dy AS v FROM g, {AROUND}")
def ker02(spark, d):
    return spread(bev(spark, d)).distinct()


@query("ker02b_erode", f"WITH {GRID} SELECT u + dx AS u, v + dy AS v FROM g, {AROUND} GROUP BY 1, 2 HAVING count(*) = 9")
def ker02b(spark, d):
    return spread(bev(spark, d)).groupBy("u", "v").agg(F.count("*").alias("n")).filter("n = 9").drop("n")


@query("ker04_hough_votes", f"WITH {GRID} SELECT t AS theta, CAST(floor((u * cos(radians(t)) + v * sin(radians(t))) / 2e0 + 1e-9) AS BIGINT) AS rho, count(*) AS votes FROM g, (SELECT unnest(range(0, 180, 15)) AS t) GROUP BY 1, 2")
def ker04(spark, d):
    t = bev(spark, d).withColumn("theta", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(165).cast("long"), F.lit(15).cast("long"))))
    rho = geo.floor_int((F.col("u") * F.cos(F.radians("theta")) + F.col("v") * F.sin(F.radians("theta"))) / 2 + 1e-9)
    return t.groupBy("theta", rho.alias("rho")).agg(F.count("*").alias("votes"))


@query("ker08_ship_metrics", "SELECT id, round(sqrt(cx * cx + cy * cy), 5) AS distance, round(degrees(atan2(cy, cx)), 5) AS bearing FROM berths")
def ker08(spark, d):
    return view(spark, d, "berths").select("id", F.round(F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2), 5).alias("distance"), F.round(F.degrees(F.atan2("cy", "cx")), 5).alias("bearing"))


@query("ker15_drift_correction", f"""WITH {NEIGHBOUR}, ok AS (SELECT n.id, n.ts, n.sensor, n.unit, n.value FROM nav n JOIN m ON n.id = m.id WHERE abs(m.value - m.med) <= 30e0),
 u AS (SELECT id, sensor, unit, ts, NULL AS s, 1 AS ask FROM nav UNION ALL SELECT NULL, sensor, unit, ts, struct_pack(t := ts, v := value), 0 FROM ok),
 w AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY sensor, unit ORDER BY ts, ask ROWS UNBOUNDED PRECEDING) AS p, last_value(s IGNORE NULLS) OVER (PARTITION BY sensor, unit ORDER BY ts DESC, ask ROWS UNBOUNDED PRECEDING) AS q FROM u),
 e AS (SELECT id, ts, coalesce(p, q) AS p, coalesce(q, p) AS q FROM w WHERE ask = 1)
 SELECT id, round(p.v + (q.v - p.v) * CASE WHEN q.t > p.t THEN (ts - p.t) / (q.t - p.t) ELSE 0e0 END, 4) AS value FROM e""")
def ker15(spark, d):
    n = view(spark, d, "nav")
    ok = temporal.neighbour_median(n, ["sensor", "unit"], "ts", "value").filter(F.abs(F.col("value") - F.col("neighbour_median")) <= 30.0)
    return temporal.bracket(n.select("id", "sensor", "unit", "ts"), ok, ["sensor", "unit"], ["value"], "id").select("id", F.round("value", 4).alias("value"))


@query("ker17_lod_selective_export", TILED + """, c AS (SELECT DISTINCT lod, tile_x, tile_y FROM tiles WHERE lod > 0), n AS (SELECT DISTINCT CAST(floor(cx / 50e0) AS BIGINT) AS tile_x, CAST(floor(cy / 50e0) AS BIGINT) AS tile_y FROM berths WHERE opening_edge = 0)
 SELECT c.lod, c.tile_x, c.tile_y FROM c LEFT JOIN n ON c.tile_x = n.tile_x AND c.tile_y = n.tile_y WHERE c.lod = CASE WHEN n.tile_x IS NOT NULL THEN 2 ELSE 1 END""")
def ker17(spark, d):
    tiles = maps.build_tiles(world(spark, d)).select("lod", "tile_x", "tile_y").filter("lod > 0").distinct()
    near = maps.viewport_tiles(view(spark, d, "berths").filter("opening_edge = 0").selectExpr("cx AS min_x", "cy AS min_y", "cx AS max_x", "cy AS max_y")).withColumn("near", F.lit(True))
    return tiles.join(near, ["tile_x", "tile_y"], "left").filter(F.col("lod") == F.when(F.col("near"), 2).otherwise(1)).select("lod", "tile_x", "tile_y")


@query("ker21_label_back_projection", """SELECT p.vec_id, arg_min(q.label, struct_pack(d := (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z), i := q.vec_id)) AS label FROM vec p JOIN vec q ON q.vec_id % 3 = 0 AND (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z) <= 0.04e0 WHERE p.vec_id % 3 <> 0 GROUP BY p.vec_id""")
def ker21(spark, d):
    v = view(spark, d, "vec")
    near = spatial.knn(v.filter("vec_id % 3 <> 0").select("vec_id", "x", "y", "z"), v.filter("vec_id % 3 = 0"), 1, 0.2, "vec_id", "vec_id")
    return near.select("vec_id", F.col("r_label").alias("label"))


@query("str02_latest_state", "SELECT sensor, arg_max(seq, ts) AS seq FROM frames GROUP BY sensor")
def str02(spark, d):
    return view(spark, d, "frames").groupBy("sensor").agg(F.max_by("seq", "ts").alias("seq"))


@query("str03_dirty_since", "SELECT sensor, max(seq) AS version FROM frames GROUP BY sensor HAVING max(seq) > 100")
def str03(spark, d):
    return view(spark, d, "frames").groupBy("sensor").agg(F.max("seq").alias("version")).filter("version > 100")


@query("str07_newest_per_batch", "SELECT CAST(floor(ts / 600e0) AS BIGINT) AS batch, sensor, arg_max(seq, ts) AS seq FROM frames GROUP BY 1, 2")
def str07(spark, d):
    return view(spark, d, "frames").groupBy(F.floor(F.col("ts") / 600.0).alias("batch"), "sensor").agg(F.max_by("seq", "ts").alias("seq"))


@query("str08_confirmation", "SELECT session AS key, id AS seq, 5 AS hits FROM (SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY id) AS r FROM berths) WHERE r = 5")
def str08(spark, d):
    return folds.confirmed(view(spark, d, "berths").select(F.col("session").alias("key"), F.col("id").alias("seq")), 5)


@query("str13_plane_fallback", "SELECT id, last_value(CASE WHEN valid THEN alt END IGNORE NULLS) OVER (PARTITION BY unit, sensor = 'error' ORDER BY ts ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS plane FROM nav")
def str13(spark, d):
    w = Window.partitionBy("unit", F.col("sensor") == "error").orderBy("ts").rowsBetween(-15, 0)
    return view(spark, d, "nav").select("id", F.last(F.when(F.col("valid"), F.col("alt")), ignorenulls=True).over(w).alias("plane"))


@query("str15_pause_snapshot", "WITH t AS (SELECT min(ts) + 864000e0 AS cut FROM frames) SELECT sensor, arg_max(seq, ts) AS seq FROM frames, t WHERE ts <= cut AND cut - ts <= 3600e0 GROUP BY sensor")
def str15(spark, d):
    f = view(spark, d, "frames")
    at = f.agg((F.min("ts") + 864000.0).alias("at"))
    return f.join(F.broadcast(at), (F.col("ts") <= F.col("at")) & (F.col("at") - F.col("ts") <= 3600.0)).groupBy("sensor").agg(F.max_by("seq", "ts").alias("seq"))


@query("str16_rate_gate", """WITH RECURSIVE p AS (SELECT CAST(unit AS VARCHAR) AS key, ts, row_number() OVER (PARTITION BY unit ORDER BY ts) AS r FROM frames), s AS (SELECT key, r, ts, ts AS last, true AS out FROM p WHERE r = 1 UNION ALL SELECT p.key, p.r, p.ts, CASE WHEN p.ts - s.last >= 7200e0 THEN p.ts ELSE s.last END, p.ts - s.last >= 7200e0 FROM s JOIN p ON p.key = s.key AND p.r = s.r + 1) SELECT key, CAST(floor(ts) AS BIGINT) AS ts FROM s WHERE out""")
def str16(spark, d):
    f = view(spark, d, "frames").select(F.col("unit").cast("string").alias("key"), "ts")
    return folds.rate_limited(f, 7200.0).select("key", F.floor("ts").alias("ts"))


@query("str19_first_valid_anchor", "SELECT sensor, arg_min(id, ts) AS id FROM nav WHERE valid AND ts > 0 AND abs(lat) <= 90 GROUP BY sensor")
def str19(spark, d):
    return view(spark, d, "nav").filter("valid AND ts > 0 AND abs(lat) <= 90").groupBy("sensor").agg(F.min_by("id", "ts").alias("id"))
