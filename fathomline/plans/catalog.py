"""Named queries over the views, each with the SQL that must give equal rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import geo
from fathomline.operators import filters, maps, spatial, temporal
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


def r6(c):
    return F.round(c, 6)


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.yaw_pose_points(view(spark, sf_dir, "pts"), F.broadcast(view(spark, sf_dir, "kfs")), "kf")


#: Points of the map frame, for oracles.
WORLD = """world AS (SELECT p.*, cos(radians(yaw_deg / 2)) AS qw, sin(radians(yaw_deg / 2)) AS qz, tx, ty, tz FROM pts p JOIN kfs k ON p.kf = k.kf),
 wpts AS (SELECT kf, idx, intensity, (1 - 2 * qz * qz / (qz * qz + qw * qw)) * x - 2 * qz * qw / (qz * qz + qw * qw) * y + tx AS wx,
   2 * qz * qw / (qz * qz + qw * qw) * x + (1 - 2 * qz * qz / (qz * qz + qw * qw)) * y + ty AS wy, z + tz AS wz FROM world)"""


# --- sources and scans -------------------------------------------------------------------------
@query("src02_capture_range", "SELECT sensor, round(min(ts), 6) AS first_ts, round(max(ts), 6) AS last_ts, count(*) AS packets FROM frames GROUP BY sensor")
def src02(spark, d):
    return view(spark, d, "frames").groupBy("sensor").agg(r6(F.min("ts")).alias("first_ts"), r6(F.max("ts")).alias("last_ts"), F.count("*").alias("packets"))


@query("src03_seek_preroll", """WITH b AS (SELECT min(ts) + 86400e0 AS target FROM frames)
 SELECT seq, CASE WHEN ts + 1e-9 >= target THEN 'play' ELSE 'warm' END AS phase FROM frames, b WHERE ts + 1e-9 >= target - 3600e0 AND ts < target + 7200e0""")
def src03(spark, d):
    frames = view(spark, d, "frames")
    target = frames.agg(F.min("ts")).first()[0] + 86400.0
    return temporal.seek_with_preroll(frames.filter(F.col("ts") < target + 7200.0), target, 3600.0).select("seq", "phase")


@query("src04_playback_schedule", """SELECT seq, round(sum(step) OVER (PARTITION BY sensor, unit ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS due FROM
 (SELECT seq, sensor, unit, greatest(coalesce(ts - lag(ts) OVER (PARTITION BY sensor, unit ORDER BY seq), 0e0), 0e0) / 2e0 AS step FROM frames)""")
def src04(spark, d):
    return temporal.playback_schedule(view(spark, d, "frames"), ["sensor", "unit"], "seq", "ts", 2.0).select("seq", F.round("due", 4).alias("due"))


@query("src10_latest_calibration", "SELECT sensor, arg_max(seq, ts) AS seq, round(max(ts), 6) AS ts FROM frames GROUP BY sensor")
def src10(spark, d):
    return view(spark, d, "frames").groupBy("sensor").agg(F.max_by("seq", "ts").alias("seq"), r6(F.max("ts")).alias("ts"))


@query("src11_block_azimuth_steps", """SELECT id, (coalesce(lead(az) OVER (PARTITION BY sensor, unit ORDER BY id), az) - az + 36000) % 36000 AS step
 FROM (SELECT id, sensor, unit, CAST(floor(yaw_deg * 100e0) AS BIGINT) AS az FROM nav)""")
def src11(spark, d):
    az = view(spark, d, "nav").withColumn("az", geo.floor_int(F.col("yaw_deg") * 100))
    nxt = F.coalesce(F.lead("az").over(Window.partitionBy("sensor", "unit").orderBy("id")), F.col("az"))
    return az.select("id", F.pmod(nxt - F.col("az"), F.lit(36000)).alias("step"))


@query("src13_nav_packet_accept", """SELECT count(*) AS accepted FROM documents WHERE octet_length(encode(text)) >= 96 AND substr(text, 3, 1) = 'e'""")
def src13(spark, d):
    t = view(spark, d, "documents")
    return t.filter((F.octet_length("text") >= 96) & (F.substring("text", 3, 1) == "e")).agg(F.count("*").alias("accepted"))


@query("src15_rtp_gaps", """SELECT sensor, CAST(sum(CASE WHEN seq <> p + 1 THEN 1 ELSE 0 END) AS BIGINT) AS gaps, CAST(sum(CASE WHEN seq <> p + 1 THEN seq - p - 1 ELSE 0 END) AS BIGINT) AS missing
 FROM (SELECT sensor, seq, lag(seq) OVER (PARTITION BY sensor, unit ORDER BY seq) AS p FROM frames) GROUP BY sensor""")
def src15(spark, d):
    f = view(spark, d, "frames").withColumn("p", F.lag("seq").over(Window.partitionBy("sensor", "unit").orderBy("seq")))
    jump = F.col("seq") != F.col("p") + 1
    return f.groupBy("sensor").agg(F.sum(F.when(jump, 1).otherwise(0)).alias("gaps"), F.sum(F.when(jump, F.col("seq") - F.col("p") - 1).otherwise(0)).alias("missing"))


@query("src24_chunked_cloud", """SELECT kf, CAST(floor(idx / ceil(n / 7e0)) AS BIGINT) AS chunk, count(*) AS points, round(sum(x), 4) AS sum_x
 FROM (SELECT *, count(*) OVER (PARTITION BY kf) AS n FROM pts) GROUP BY 1, 2""")
def src24(spark, d):
    p = view(spark, d, "pts")
    sizes = p.groupBy("kf").agg(F.ceil(F.count("*") / 7).alias("size"))
    return p.join(sizes, "kf").groupBy("kf", F.floor(F.col("idx") / F.col("size")).alias("chunk")).agg(F.count("*").alias("points"), F.round(F.sum("x"), 4).alias("sum_x"))


@query("src25_merge_captures", """SELECT sensor, count(*) AS packets, CAST(sum(CASE WHEN ts < p THEN 1 ELSE 0 END) AS BIGINT) AS out_of_order, round(max(ts) - min(ts), 4) AS span
 FROM (SELECT sensor, ts, lag(ts) OVER (PARTITION BY sensor, unit ORDER BY seq) AS p FROM frames) GROUP BY sensor""")
def src25(spark, d):
    f = view(spark, d, "frames").withColumn("p", F.lag("ts").over(Window.partitionBy("sensor", "unit").orderBy("seq")))
    return f.groupBy("sensor").agg(F.count("*").alias("packets"), F.sum(F.when(F.col("ts") < F.col("p"), 1).otherwise(0)).alias("out_of_order"), F.round(F.max("ts") - F.min("ts"), 4).alias("span"))


@query("src32_restore_candidates", """SELECT name, rank FROM (SELECT lower(c_name) AS name, CAST(row_number() OVER (ORDER BY c_custkey <> 17, c_acctbal DESC, c_custkey) AS BIGINT) AS rank FROM customer) WHERE rank <= 20""")
def src32(spark, d):
    c = view(spark, d, "customer").withColumn("name", F.lower("c_name"))
    one = c.groupBy("name").agg(F.min_by(F.struct("c_custkey", "c_acctbal"), F.struct(F.col("c_custkey") != 17, -F.col("c_acctbal"), "c_custkey")).alias("r")).select("name", "r.*")
    top = one.orderBy(F.col("c_custkey") != 17, F.desc("c_acctbal"), "c_custkey").limit(20)
    return top.select("name", F.row_number().over(Window.orderBy(F.col("c_custkey") != 17, F.desc("c_acctbal"), "c_custkey")).cast("long").alias("rank"))


@query("src34_point_dump", "SELECT kf, count(*) AS written, count(*) FILTER (WHERE NOT (abs(z) < 4e0)) AS skipped FROM pts GROUP BY kf")
def src34(spark, d):
    return view(spark, d, "pts").groupBy("kf").agg(F.count("*").alias("written"), F.count_if(~(F.abs("z") < 4.0)).alias("skipped"))


# --- filters -----------------------------------------------------------------------------------
@query("flt01_packet_routing", """WITH routes AS (SELECT CAST(s_suppkey AS BIGINT) AS port, s_nationkey AS ip, s_name AS device FROM supplier)
 SELECT coalesce(e.device, CASE WHEN f.generation = 1 THEN 'any' END) AS device, count(*) AS packets FROM frames f LEFT JOIN routes e ON f.port = e.port AND f.generation = e.ip GROUP BY 1""")
def flt01(spark, d):
    f = view(spark, d, "frames").withColumn("ip", F.concat(F.lit("::FFFF:10.0.0."), F.col("generation")))
    s = view(spark, d, "supplier")
    exact = s.select(F.concat(F.lit("10.0.0."), F.col("s_nationkey")).alias("ip"), F.col("s_suppkey").alias("port"), F.col("s_name").alias("device"))
    routes = exact.unionByName(s.limit(1).select(F.lit("10.0.0.1").alias("ip"), F.lit(None).cast("long").alias("port"), F.lit("any").alias("device")))
    return filters.route_packets(f, routes).groupBy("device").agg(F.count("*").alias("packets"))


@query("flt02_generation_guard", "SELECT seq FROM frames WHERE generation = 2")
def flt02(spark, d):
    return view(spark, d, "frames").filter("generation = 2").select("seq")


@query("flt03_finite_points", "SELECT kf, count(*) AS n FROM pts WHERE isfinite(x) AND isfinite(y) AND isfinite(z) GROUP BY kf")
def flt03(spark, d):
    return view(spark, d, "pts").filter(geo.finite(F.col("x"), F.col("y"), F.col("z"))).groupBy("kf").agg(F.count("*").alias("n"))


@query("flt04_range_decimated", "SELECT kf, idx FROM pts WHERE idx % 2 = 0 AND x*x + y*y + z*z BETWEEN 4e0 AND 6400e0")
def flt04(spark, d):
    p = filters.decimate(view(spark, d, "pts"), "idx")
    return p.filter(filters.in_range(F.col("x"), F.col("y"), F.col("z"), 2.0, 80.0)).select("kf", "idx")


@query("flt05_stride_cap", "SELECT kf, idx FROM (SELECT kf, idx, count(*) OVER (PARTITION BY kf) AS n FROM pts) WHERE idx % CAST(ceil(n / 50e0) AS BIGINT) = 0")
def flt05(spark, d):
    return filters.stride_cap(view(spark, d, "pts"), ["kf"], "idx", 50).select("kf", "idx")


@query("flt06_azimuth_section", """SELECT id FROM (SELECT id, value, CAST(floor(yaw_deg * 100e0) AS BIGINT) % 36000 AS az FROM nav) WHERE (az >= 30000 OR az < 6000) AND value BETWEEN 5e0 AND 60e0""")
def flt06(spark, d):
    az = geo.floor_int(F.col("yaw_deg") * 100)
    return view(spark, d, "nav").filter(filters.azimuth_section(az, 30000, 6000) & F.col("value").between(5.0, 60.0)).select("id")


@query("flt07_own_ship_exclusion", "SELECT kf, idx FROM pts WHERE NOT (abs(x) <= 6e0 AND abs(y) <= 2.5e0) AND abs(x) <= 250e0 AND abs(y) <= 250e0 AND z BETWEEN -15e0 AND 50e0")
def flt07(spark, d):
    return view(spark, d, "pts").filter(filters.outside_own_ship(F.col("x"), F.col("y"), F.col("z"))).select("kf", "idx")


@query("flt08_line_roi", "SELECT kf, idx FROM pts WHERE abs(x) <= 105e0 AND abs(y) <= 105e0 AND z BETWEEN -2e0 AND 2e0 AND NOT (x BETWEEN -22e0 AND 12e0 AND y BETWEEN -7e0 AND 7e0)")
def flt08(spark, d):
    return view(spark, d, "pts").filter(filters.line_roi(F.col("x"), F.col("y"), F.col("z"))).select("kf", "idx")


@query("flt09_u_roi", "SELECT kf, idx FROM pts WHERE abs(x) < 80e0 AND abs(y) < 80e0 AND z > -4e0 AND z < 10e0")
def flt09(spark, d):
    return view(spark, d, "pts").filter(filters.u_roi(F.col("x"), F.col("y"), F.col("z"))).select("kf", "idx")


@query("flt10_above_water_plane", "SELECT kf, idx FROM pts WHERE -0.08e0 * x + 0.04e0 * y + 0.996e0 * z + 0.1e0 > 0.25e0")
def flt10(spark, d):
    return view(spark, d, "pts").filter(filters.above_plane(F.col("x"), F.col("y"), F.col("z"), (-0.08, 0.04, 0.996, 0.1), 0.25)).select("kf", "idx")


@query("flt11_low_outliers", """WITH low AS (SELECT p.kf, p.idx, count(q.idx) AS near FROM pts p JOIN pts q ON p.kf = q.kf AND p.idx <> q.idx AND (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z) <= 9e0 WHERE p.z <= 1e0 GROUP BY 1, 2)
 SELECT kf, idx FROM pts WHERE z > 1e0 UNION ALL SELECT kf, idx FROM low WHERE near >= 2""")
def flt11(spark, d):
    return spatial.low_outliers(view(spark, d, "pts"), "kf", "idx", "z", 1.0, 3.0, 2).select("kf", "idx")


@query("flt13_gnss_usable", "SELECT id FROM nav WHERE ts > 0 AND valid AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0)")
def flt13(spark, d):
    return view(spark, d, "nav").filter(filters.gnss_usable(F.col("ts"), F.col("lat"), F.col("lon"), F.col("valid"))).select("id")


@query("flt15_record_validation", "SELECT id, (w > 0 AND l > 0 AND w <= 12 AND l <= 25 AND angle >= 0 AND angle < 180 AND kind IN (1, 2)) AS valid FROM berths")
def flt15(spark, d):
    b = view(spark, d, "berths")
    return b.select("id", ((F.col("w") > 0) & (F.col("l") > 0) & (F.col("w") <= 12) & (F.col("l") <= 25) & (F.col("angle") >= 0) & (F.col("angle") < 180) & F.col("kind").isin(1, 2)).alias("valid"))


@query("flt16_berth_size", "SELECT id FROM berths WHERE w BETWEEN 7e0 AND 12e0 AND l BETWEEN 8e0 AND 25e0 AND w * l >= 56e0")
def flt16(spark, d):
    return view(spark, d, "berths").filter("w BETWEEN 7 AND 12 AND l BETWEEN 8 AND 25 AND w * l >= 56").select("id")


@query("flt19_repeated_frames", """SELECT seq FROM (SELECT seq, generation, ts, lag(generation) OVER w AS g, lag(ts) OVER w AS t FROM frames WINDOW w AS (PARTITION BY sensor, unit ORDER BY ts)) WHERE NOT coalesce(g = generation AND ts - t <= 9000e0, false)""")
def flt19(spark, d):
    return filters.drop_repeats(view(spark, d, "frames"), ["sensor", "unit"], "ts", "generation", 9000.0).select("seq")


@query("flt20_registration_gate", """SELECT o_orderkey AS id FROM orders WHERE o_custkey >= 500 AND (o_custkey % 100) / 100e0 >= 0.35e0 AND o_totalprice % 3e0 <= 1.5e0 AND (o_orderkey % 50) / 10e0 <= 3e0
 AND (o_orderkey % 90) / 100e0 <= 0.75e0 AND (o_custkey % 30) / 100e0 <= 0.15e0 AND (o_custkey % 4) <= 2 AND (o_orderkey % 31) <= 15 AND (o_custkey % 40) <= 36""")
def flt20(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = {"correspondences": c, "overlap": (c % 100) / 100, "rmse": F.col("o_totalprice") % 3.0, "fitness": (k % 50) / 10, "translation": (k % 90) / 100, "dz": (c % 30) / 100, "roll_pitch_deg": c % 4, "yaw_deg": k % 31, "mahalanobis": c % 40}
    return view(spark, d, "orders").filter(filters.registration_accepted(m)).select(k.alias("id"))


@query("flt21_extrinsics", "SELECT kf, idx, round(-y + 1.5e0, 6) AS x, round(x - 0.5e0, 6) AS y, round(z + 2e0, 6) AS z, 90 AS intensity FROM pts WHERE kf % 2 = 0")
def flt21(spark, d):
    cal = spark.createDataFrame([(0, [0.0, -1.0, 0.0, 1.5, 1.0, 0.0, 0.0, -0.5, 0.0, 0.0, 1.0, 2.0, 0.0, 0.0, 0.0, 1.0], 90)], "sensor long, t array<double>, sensor_intensity int")
    p = view(spark, d, "pts").withColumn("sensor", F.col("kf") % 2)
    return filters.transform_points(p, F.broadcast(cal), "sensor").select("kf", "idx", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"), "intensity")


@query("flt22_pose_projection", f"WITH {WORLD} SELECT kf, idx, round(wx, 5) AS wx, round(wy, 5) AS wy, round(wz, 5) AS wz FROM wpts")
def flt22(spark, d):
    return world(spark, d).select("kf", "idx", F.round("wx", 5).alias("wx"), F.round("wy", 5).alias("wy"), F.round("wz", 5).alias("wz"))


@query("flt23_camera_projection", "SELECT kf, idx, CAST(floor(800e0 * y / x + 640e0) AS BIGINT) AS u, CAST(floor(-800e0 * z / x + 360e0) AS BIGINT) AS v FROM pts WHERE x > 1e0 AND floor(800e0 * y / x + 640e0) BETWEEN 0 AND 1279 AND floor(-800e0 * z / x + 360e0) BETWEEN 0 AND 719")
def flt23(spark, d):
    u, v = geo.floor_int(800.0 * F.col("y") / F.col("x") + 640.0), geo.floor_int(-800.0 * F.col("z") / F.col("x") + 360.0)
    p = view(spark, d, "pts").filter("x > 1").select("kf", "idx", u.alias("u"), v.alias("v"))
    return p.filter("u BETWEEN 0 AND 1279 AND v BETWEEN 0 AND 719")


# --- joins -------------------------------------------------------------------------------------
NEAREST = """SELECT a.seq, arg_min(b.seq, struct_pack(g := abs(a.ts - b.ts), s := b.seq)) AS match FROM a LEFT JOIN b ON a.unit = b.unit AND abs(a.ts - b.ts) <= {tol} GROUP BY a.seq"""


@query("join01_dimension_lookup", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def join01(spark, d):
    c, n, r = (view(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query("join02_nearest_in_time", "WITH a AS (SELECT * FROM frames WHERE sensor = 'click'), b AS (SELECT * FROM frames WHERE sensor = 'view') " + NEAREST.format(tol="1800e0"))
def join02(spark, d):
    f = view(spark, d, "frames")
    return temporal.nearest_in_time(f.filter("sensor = 'click'"), f.filter("sensor = 'view'"), 1800.0, "seq", by=("unit",)).select("seq", F.col("r_seq").alias("match"))


@query("join03_fallback_latest", """WITH a AS (SELECT * FROM frames WHERE sensor = 'click'), b AS (SELECT * FROM frames WHERE sensor = 'view'),
 n AS (""" + NEAREST.format(tol="450e0") + """), l AS (SELECT a.seq, arg_max(b.seq, b.ts) AS latest FROM a JOIN b ON a.unit = b.unit AND b.ts <= a.ts AND a.ts - b.ts <= 9000e0 GROUP BY a.seq)
 SELECT n.seq, coalesce(n.match, l.latest) AS match FROM n LEFT JOIN l ON n.seq = l.seq WHERE coalesce(n.match, l.latest) IS NOT NULL""")
def join03(spark, d):
    f = view(spark, d, "frames")
    left, right = f.filter("sensor = 'click'"), f.filter("sensor = 'view'")
    near = temporal.nearest_in_time(left, right, 450.0, "seq", by=("unit",)).select("seq", "ts", "unit", F.col("r_seq").alias("near"))
    both = temporal.latest_before(near, right.select("ts", "unit", F.col("seq").alias("s")), 9000.0, "seq", by=("unit",))
    return both.select("seq", F.coalesce("near", "r_s").alias("match")).filter("match IS NOT NULL")


@query("join04_tiered_pose", """WITH a AS (SELECT * FROM frames WHERE sensor = 'purchase'), b AS (SELECT * FROM frames WHERE sensor = 'signup'),
 h AS (SELECT a.seq, b.seq AS s, CASE WHEN b.ts <= a.ts AND a.ts - b.ts < 4500e0 THEN 0 WHEN b.ts > a.ts AND b.ts - a.ts <= 9000e0 THEN 1 WHEN a.ts - b.ts BETWEEN 0 AND 18000e0 THEN 2 END AS tier, abs(a.ts - b.ts) AS gap FROM a JOIN b ON a.unit = b.unit AND abs(a.ts - b.ts) <= 18000e0)
 SELECT seq, arg_min(s, struct_pack(t := tier, g := gap, s := s)) AS pose, CAST(min(tier) AS BIGINT) AS tier FROM h WHERE tier IS NOT NULL GROUP BY seq""")
def join04(spark, d):
    f = view(spark, d, "frames")
    a, b = f.filter("sensor = 'purchase'"), f.filter("sensor = 'signup'").select("unit", F.col("ts").alias("pose_ts"), F.col("seq").alias("pose"))
    bucket = lambda c: F.floor(F.col(c) / 18000.0)
    pairs = a.withColumn("_b", F.explode(F.sequence(bucket("ts") - 1, bucket("ts") + 1))).join(b.withColumn("_b", bucket("pose_ts")), ["unit", "_b"])
    age = F.col("ts") - F.col("pose_ts")
    tier = F.when((age >= 0) & (age < 4500.0), 0).when((age < 0) & (age >= -9000.0), 1).when(age.between(0, 18000.0), 2).cast("long")
    best = F.min(F.struct(tier.alias("tier"), F.abs(age).alias("gap"), "pose"))
    return pairs.filter(tier.isNotNull()).groupBy("seq").agg(best.alias("r")).select("seq", "r.pose", "r.tier")


@query("join05_bracket_interpolation", """WITH a AS (SELECT id, ts, unit FROM nav WHERE sensor = 'click'), b AS (SELECT ts, lat, alt, unit FROM nav WHERE sensor = 'view'),
 u AS (SELECT id, ts, unit, NULL AS s, 1 AS ask FROM a UNION ALL SELECT NULL, ts, unit, struct_pack(t := ts, lat := lat, alt := alt), 0 FROM b),
 w AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY unit ORDER BY ts, ask ROWS UNBOUNDED PRECEDING) AS p, last_value(s IGNORE NULLS) OVER (PARTITION BY unit ORDER BY ts DESC, ask ROWS UNBOUNDED PRECEDING) AS q FROM u),
 e AS (SELECT id, ts, coalesce(p, q) AS p, coalesce(q, p) AS q FROM w WHERE ask = 1)
 SELECT id, round(p.alt + (q.alt - p.alt) * CASE WHEN q.t > p.t THEN (ts - p.t) / (q.t - p.t) ELSE 0e0 END, 4) AS alt, round(least(abs(ts - p.t), abs(ts - q.t)), 4) AS gap FROM e""")
def join05(spark, d):
    n = view(spark, d, "nav")
    out = temporal.bracket(n.filter("sensor = 'click'"), n.filter("sensor = 'view'"), ["unit"], ["lat", "alt"], "id")
    return out.select("id", F.round("alt", 4).alias("alt"), F.round("gap", 4).alias("gap"))


RECTS = "SELECT *, cos(radians(angle)) AS c, sin(radians(angle)) AS s FROM berths"
UV = "(x-cx)*c + (y-cy)*s AS u, -(x-cx)*s + (y-cy)*c AS v"


@query("join06_rect_occupancy", f"""WITH b AS ({RECTS}), m AS (SELECT b.id, count(*) AS inside FROM (SELECT b.*, {UV} FROM b, pts) b WHERE abs(u) <= w / 2e0 - 0.8e0 AND abs(v) <= l / 2e0 - 0.8e0 GROUP BY b.id)
 SELECT b.id, coalesce(inside, 0) AS inside, coalesce(inside, 0) >= 100 AS occupied FROM b LEFT JOIN m ON b.id = m.id""")
def join06(spark, d):
    b = view(spark, d, "berths")
    return spatial.occupancy(view(spark, d, "pts").select("x", "y"), b, "id").select("id", "inside", "occupied")


@query("join07_outward_hits", f"""WITH b AS ({RECTS}), m AS (SELECT id, w / 2e0 AS hw, l / 2e0 AS hl, {UV} FROM b, pts),
 s AS (SELECT id, abs(u) <= 1 AND v < -hl AND v >= -hl-20 AS h0, abs(v) <= 1 AND u > hw AND u <= hw+20 AS h1, abs(u) <= 1 AND v > hl AND v <= hl+20 AS h2, abs(v) <= 1 AND u < -hw AND u >= -hw-20 AS h3 FROM m)
 SELECT id, count(*) FILTER (WHERE h0) AS hits0, count(*) FILTER (WHERE h1) AS hits1, count(*) FILTER (WHERE h2) AS hits2, count(*) FILTER (WHERE h3) AS hits3 FROM s GROUP BY id HAVING count(*) FILTER (WHERE h0 OR h1 OR h2 OR h3) > 0""")
def join07(spark, d):
    b = view(spark, d, "berths")
    return spatial.outward_hits(view(spark, d, "pts").select("x", "y"), b, "id").filter("hits0 + hits1 + hits2 + hits3 > 0")


@query("join08_edge_bands", f"""WITH b AS ({RECTS}), m AS (SELECT id, w / 2e0 AS hw, l / 2e0 AS hl, {UV} FROM b, pts),
 s AS (SELECT id, abs(v+hl) <= 0.8e0 AND abs(u) <= hw*0.7e0 AS e0, abs(u-hw) <= 0.8e0 AND abs(v) <= hl*0.7e0 AS e1, abs(v-hl) <= 0.8e0 AND abs(u) <= hw*0.7e0 AS e2, abs(u+hw) <= 0.8e0 AND abs(v) <= hl*0.7e0 AS e3 FROM m)
 SELECT id, count(*) FILTER (WHERE e0) AS edge0, count(*) FILTER (WHERE e1) AS edge1, count(*) FILTER (WHERE e2) AS edge2, count(*) FILTER (WHERE e3) AS edge3 FROM s GROUP BY id HAVING count(*) FILTER (WHERE e0 OR e1 OR e2 OR e3) > 0""")
def join08(spark, d):
    b = view(spark, d, "berths")
    return spatial.edge_band_counts(view(spark, d, "pts").select("x", "y"), b, "id").filter("edge0 + edge1 + edge2 + edge3 > 0")


BOX = "id, cx - w AS min_x, cy - l AS min_y, cx + w AS max_x, cy + l AS max_y"


def boxes(spark, d, half: int) -> DataFrame:
    return view(spark, d, "berths").filter(f"kind = {half}").selectExpr("id", "cx - w AS min_x", "cy - l AS min_y", "cx + w AS max_x", "cy + l AS max_y")


@query("join09_box_overlap", f"""WITH a AS (SELECT {BOX} FROM berths WHERE kind = 1), b AS (SELECT {BOX} FROM berths WHERE kind = 2)
 SELECT a.id, b.id AS other FROM a JOIN b ON a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y""")
def join09(spark, d):
    return spatial.boxes_overlapping(boxes(spark, d, 1), boxes(spark, d, 2), 25.0).select("id", F.col("r_id").alias("other"))


@query("join11_knn", """SELECT vec_id, other, CAST(rank AS BIGINT) AS rank, round(d2, 6) AS d2 FROM (SELECT a.vec_id, b.vec_id AS other, d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY d2, b.vec_id) AS rank
 FROM (SELECT a.vec_id AS i, b.vec_id AS j, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM vec a, vec b) p JOIN vec a ON a.vec_id = p.i JOIN vec b ON b.vec_id = p.j WHERE d2 <= 0.04e0) WHERE rank <= 5""")
def join11(spark, d):
    v = view(spark, d, "vec").select("vec_id", "x", "y", "z")
    return spatial.knn(v, v, 5, 0.2, "vec_id", "vec_id").select("vec_id", F.col("r_vec_id").alias("other"), F.col("rank").cast("long").alias("rank"), r6("d2").alias("d2"))


@query("join12_radius_join", "SELECT a.kf, a.idx, b.idx AS other FROM pts a JOIN pts b ON a.kf = b.kf AND a.idx < b.idx AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 2.25e0")
def join12(spark, d):
    p = view(spark, d, "pts").select("kf", "idx", "x", "y", "z")
    return spatial.radius_pairs(p, 1.5, "idx", by=("kf",)).select("kf", "idx", F.col("r_idx").alias("other"))


@query("join15_candidate_match", """WITH a AS (SELECT * FROM berths WHERE id % 2 = 0), b AS (SELECT * FROM berths WHERE id % 2 = 1)
 SELECT id, other FROM (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy), b.id) AS r FROM a JOIN b ON (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy) <= 900e0
   AND abs(a.w - b.w) <= 0.35e0 * b.w AND abs(a.l - b.l) <= 0.35e0 * b.l AND least((a.angle - b.angle + 360e0) % 180e0, 180e0 - (a.angle - b.angle + 360e0) % 180e0) <= 60e0) WHERE r = 1""")
def join15(spark, d):
    b = view(spark, d, "berths")
    pairs = spatial.radius_join(b.filter("id % 2 = 0"), b.filter("id % 2 = 1"), 30.0, ("cx", "cy"))
    ok = (F.abs(F.col("w") - F.col("r_w")) <= 0.35 * F.col("r_w")) & (F.abs(F.col("l") - F.col("r_l")) <= 0.35 * F.col("r_l")) & (geo.axis_difference(F.col("angle"), F.col("r_angle")) <= 60)
    return pairs.filter(ok).groupBy("id").agg(F.min_by("r_id", F.struct("d2", "r_id")).alias("other"))


@query("join16_anti_join", """WITH a AS (SELECT * FROM berths WHERE id % 2 = 0), b AS (SELECT * FROM berths WHERE id % 2 = 1) SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy) <= 9e0)""")
def join16(spark, d):
    b = view(spark, d, "berths")
    known = spatial.radius_join(b.filter("id % 2 = 0"), b.filter("id % 2 = 1"), 3.0, ("cx", "cy")).select("id").distinct()
    return b.filter("id % 2 = 0").join(known, "id", "left_anti").select("id")


@query("join18_temporal_overlap", """WITH s AS (SELECT sensor, min(ts) AS a, max(ts) AS z FROM frames GROUP BY sensor) SELECT f.seq FROM frames f, (SELECT z - 86400e0 AS cut FROM s WHERE sensor = 'view') WHERE f.sensor = 'click' AND f.ts > cut""")
def join18(spark, d):
    f = view(spark, d, "frames")
    end = f.filter("sensor = 'view'").agg((F.max("ts") - 86400.0).alias("cut"))
    return f.filter("sensor = 'click'").join(F.broadcast(end), F.col("ts") > F.col("cut")).select("seq")


@query("join19_source_ranges", "SELECT k.kf, coalesce(r.s_nationkey, 90) AS intensity FROM kfs k LEFT JOIN supplier r ON k.kf >= 2 * r.s_suppkey AND k.kf < 2 * r.s_suppkey + 2")
def join19(spark, d):
    r = view(spark, d, "supplier").withColumn("first", 2 * F.col("s_suppkey"))
    each = r.select(F.explode(F.sequence("first", F.col("first") + 1)).alias("kf"), "s_nationkey")
    return view(spark, d, "kfs").join(each, "kf", "left").select("kf", F.coalesce("s_nationkey", F.lit(90)).alias("intensity"))
