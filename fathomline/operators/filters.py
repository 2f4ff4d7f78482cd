"""Predicates, decimation and lookups over packets and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import geo


def decimate(df: DataFrame, index: str, step: int = 2) -> DataFrame:
    return df.filter(F.col(index) % step == 0)


def in_range(x: Column, y: Column, z: Column, least: float, most: float) -> Column:
    r2 = x * x + y * y + z * z
    return (r2 >= least * least) & (r2 <= most * most)


def stride_cap(df: DataFrame, group: list[str], index: str, most: int) -> DataFrame:
    """Every step-th row of a group so that ``most`` remain: one aggregation and a join, no window over a whole group."""
    steps = df.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(most)).alias("_step"))
    return df.join(steps, group).filter(F.col(index) % F.greatest(F.col("_step"), F.lit(1)) == 0).drop("_step")


def azimuth_section(azimuth: Column, start: int, end: int) -> Column:
    """Hundredths of degrees in [start, end), through zero where start > end."""
    a = F.pmod(azimuth, F.lit(36000))
    return (a >= start) & (a < end) if start <= end else (a >= start) | (a < end)


def outside_own_ship(x: Column, y: Column, z: Column, half_x: float = 6.0, half_y: float = 2.5, reach: float = 250.0, low: float = -15.0, high: float = 50.0) -> Column:
    own = (F.abs(x) <= half_x) & (F.abs(y) <= half_y)
    return ~own & (F.abs(x) <= reach) & (F.abs(y) <= reach) & z.between(low, high)


def line_roi(x: Column, y: Column, z: Column, reach: float = 105.0) -> Column:
    own = x.between(-22.0, 12.0) & y.between(-7.0, 7.0)
    return (F.abs(x) <= reach) & (F.abs(y) <= reach) & z.between(-2.0, 2.0) & ~own


def u_roi(x: Column, y: Column, z: Column, reach: float = 80.0) -> Column:
    return (F.abs(x) < reach) & (F.abs(y) < reach) & (z > -4.0) & (z < 10.0)


def above_plane(x: Column, y: Column, z: Column, plane: tuple[float, float, float, float], clearance: float) -> Column:
    nx, ny, nz, d = plane
    h = nx * x + ny * y + nz * z + d
    return geo.finite(x, y, z) & (h > clearance)


def gnss_usable(ts: Column, lat: Column, lon: Column, valid: Column) -> Column:
    return geo.finite(ts, lat, lon) & (ts > 0) & valid & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))


def reference_matches(valid: Column, sync_error: Column, dt: Column, q: tuple[Column, Column, Column, Column], most_error: float) -> Column:
    norm = q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]
    return valid & (sync_error <= most_error) & (F.abs(dt) <= 1e-6) & (F.sqrt(norm) > 1e-12)


#: Limits of an accepted registration.
REGISTRATION_LIMITS = {"overlap": 0.35, "correspondences": 500, "rmse": 1.5, "fitness": 3.0, "translation": 0.75, "dz": 0.15, "roll_pitch_deg": 2.0, "yaw_deg": 15.0, "mahalanobis": 36.0}


def registration_accepted(c: dict[str, Column]) -> Column:
    m = REGISTRATION_LIMITS
    out = (c["correspondences"] >= m["correspondences"]) & (c["overlap"] >= m["overlap"])
    for k in ("rmse", "fitness", "translation", "mahalanobis"):
        out = out & (c[k] <= m[k])
    return out & (F.abs(c["dz"]) <= m["dz"]) & (F.abs(c["roll_pitch_deg"]) <= m["roll_pitch_deg"]) & (F.abs(c["yaw_deg"]) <= m["yaw_deg"])


def route_packets(packets: DataFrame, routes: DataFrame) -> DataFrame:
    """packets (ip, port) against routes (ip, port or null, device): the exact pair, else the address alone."""
    p = packets.withColumn("_ip", geo.normal_ip(F.col("ip")))
    exact = routes.filter("port is not null").select(F.col("ip").alias("_ip"), F.col("port").alias("_port"), F.col("device").alias("_exact"))
    by_ip = routes.filter("port is null").select(F.col("ip").alias("_ip"), F.col("device").alias("_any"))
    df = p.join(exact, (p["_ip"] == exact["_ip"]) & (p["port"] == exact["_port"]), "left").drop(exact["_ip"]).drop("_port")
    df = df.join(by_ip, "_ip", "left")
    return df.withColumn("device", F.coalesce("_exact", "_any")).withColumn("matched", F.col("device").isNotNull()).drop("_ip", "_exact", "_any")


def drop_repeats(df: DataFrame, group: list[str], order: str, digest: str, within: float) -> DataFrame:
    """Drop a row that has the digest of the row before it, less than ``within`` seconds later."""
    w = Window.partitionBy(*group).orderBy(order)
    same = (F.lag(digest).over(w) == F.col(digest)) & (F.col(order) - F.lag(order).over(w) <= within)
    return df.withColumn("_same", F.coalesce(same, F.lit(False))).filter("not _same").drop("_same")


def transform_points(points: DataFrame, calibration: DataFrame, key: str) -> DataFrame:
    """p' = T p with a sensor's row-major 4x4 matrix ``t`` and intensity; calibration has a row a sensor."""
    df = points.join(calibration, key)
    at = lambda i: F.element_at("t", i + 1)
    new = [at(4 * r) * F.col("x") + at(4 * r + 1) * F.col("y") + at(4 * r + 2) * F.col("z") + at(4 * r + 3) for r in range(3)]
    return df.select(*[c for c in points.columns if c not in ("x", "y", "z", "intensity")], new[0].alias("x"), new[1].alias("y"), new[2].alias("z"), F.col("sensor_intensity").alias("intensity"))


def yaw_pose_points(points: DataFrame, poses: DataFrame, key: str) -> DataFrame:
    """Keyframe points into the map frame, poses (key, tx, ty, tz, yaw_deg)."""
    df = points.join(poses, key)
    half = F.radians(F.col("yaw_deg")) / 2
    zero = F.lit(0.0)
    wx, wy, wz = geo.apply_pose(F.col("x"), F.col("y"), F.col("z"), (F.col("tx"), F.col("ty"), F.col("tz")), (zero, zero, F.sin(half), F.cos(half)))
    return df.withColumns({"wx": wx, "wy": wy, "wz": wz})
