"""Further queries: gates, epochs, message caps, associations and map exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import geo
from fathomline.operators import filters, maps, spatial, temporal
from fathomline.plans.catalog import r6
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


D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"


@query("flt12_statistical_outliers", f"""WITH n AS (SELECT a.vec_id, sqrt({D2}) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {D2}, b.vec_id) AS r FROM vec a JOIN vec b ON {D2} <= 0.09e0),
 m AS (SELECT vec_id, avg(d) AS mean FROM n WHERE r <= 13 AND d > 0 GROUP BY vec_id), l AS (SELECT avg(mean) + stddev_samp(mean) AS cut FROM m) SELECT vec_id, round(mean, 6) AS mean_distance, mean <= cut AS kept FROM m, l""")
def flt12(spark, d):
    v = view(spark, d, "vec").select("vec_id", "x", "y", "z").withColumn("frame", F.lit(0))
    return spatial.statistical_outliers(v, "frame", "vec_id", 12, 1.0, 0.3).select("vec_id", r6("mean_distance").alias("mean_distance"), "kept")


@query("flt14_reference_match", "SELECT id FROM nav WHERE valid AND value / 1000e0 <= 0.05e0 AND abs((id % 3) * 1e-6) <= 1e-6")
def flt14(spark, d):
    q = (F.lit(0.0), F.lit(0.0), F.lit(0.6), F.lit(0.8))
    return view(spark, d, "nav").filter(filters.reference_matches(F.col("valid"), F.col("value") / 1000.0, (F.col("id") % 3) * 1e-6, q, 0.05)).select("id")


@query("flt17_point_in_inset_rect", "SELECT kf, idx FROM (SELECT kf, idx, (x-5)*cos(radians(30e0)) + (y+3)*sin(radians(30e0)) AS u, -(x-5)*sin(radians(30e0)) + (y+3)*cos(radians(30e0)) AS v FROM pts) WHERE abs(u) <= 19.2e0 AND abs(v) <= 29.2e0")
def flt17(spark, d):
    inside = geo.in_rect(F.col("x"), F.col("y"), F.lit(5.0), F.lit(-3.0), F.lit(40.0), F.lit(60.0), F.lit(30.0), 0.8)
    return view(spark, d, "pts").filter(inside).select("kf", "idx")


@query("flt18_request_currency", "SELECT seq FROM frames WHERE generation = 1 AND port % 4 = 2 AND sensor <> 'error'")
def flt18(spark, d):
    return view(spark, d, "frames").filter("generation = 1 AND port % 4 = 2 AND sensor <> 'error'").select("seq")


@query("agg07_accumulated_bitmap", """SELECT CAST(floor(x / 16e0) AS BIGINT) AS cx, kf, bit_or(CAST(1 << CAST(CAST(floor(y / 10e0) AS BIGINT) + 8 AS INT) AS BIGINT)) AS seen FROM pts GROUP BY 1, 2""")
def agg07(spark, d):
    bit = F.expr("shiftleft(1L, CAST(floor(y / 10) AS INT) + 8)")
    return view(spark, d, "pts").groupBy(geo.floor_int(F.col("x") / 16).alias("cx"), "kf").agg(F.bit_or(bit).alias("seen"))


@query("agg12_small_clusters", """WITH RECURSIVE p AS (SELECT * FROM vec), e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON """ + D2 + """ <= 0.0064e0),
 r AS (SELECT vec_id AS n, vec_id AS lab FROM p UNION SELECT e.b, r.lab FROM r JOIN e ON r.n = e.a), m AS (SELECT n, min(lab) AS lab FROM r GROUP BY n) SELECT lab AS component, count(*) AS size, count(*) < 3 AS small FROM m GROUP BY lab""")
def agg12(spark, d):
    v = view(spark, d, "vec").select("vec_id", "x", "y", "z")
    pairs = spatial.radius_pairs(v, 0.08, "vec_id").select(F.col("vec_id").alias("a"), F.col("r_vec_id").alias("b"))
    labels = spatial.connected_components(v.select(F.col("vec_id").alias("node")), pairs)
    return labels.groupBy("component").agg(F.count("*").alias("size")).withColumn("small", F.col("size") < 3)


@query("win04_clamped_interpolation", """WITH k AS (SELECT kf, map, ts, tx FROM kfs WHERE tx > 0), u AS (SELECT kf, map, ts, NULL AS s, 1 AS ask FROM kfs UNION ALL SELECT NULL, map, ts, struct_pack(t := ts, v := tx), 0 FROM k),
 w AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY map ORDER BY ts, ask ROWS UNBOUNDED PRECEDING) AS p, last_value(s IGNORE NULLS) OVER (PARTITION BY map ORDER BY ts DESC, ask ROWS UNBOUNDED PRECEDING) AS q FROM u), e AS (SELECT kf, ts, coalesce(p, q) AS p, coalesce(q, p) AS q FROM w WHERE ask = 1)
 SELECT kf, round(p.v + (q.v - p.v) * CASE WHEN q.t > p.t THEN (ts - p.t) / (q.t - p.t) ELSE 0e0 END, 4) AS tx FROM e""")
def win04(spark, d):
    k = view(spark, d, "kfs")
    return temporal.bracket(k.select("map", "kf", "ts"), k.filter("tx > 0"), ["map"], ["tx"], "kf").select("kf", F.round("tx", 4).alias("tx"))


@query("srt02_region_order", "SELECT session, CAST(row_number() OVER (ORDER BY count(*) DESC, sum(hits) DESC, session) AS BIGINT) AS rank FROM berths GROUP BY session")
def srt02(spark, d):
    g = view(spark, d, "berths").groupBy("session").agg(F.count("*").alias("n"), F.sum("hits").alias("h"))
    return g.select("session", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("h"), "session")).cast("long").alias("rank"))


@query("srt07_lod_roles", "SELECT lod, CASE WHEN rn = 1 THEN 'berth' WHEN rn = 2 THEN 'background' ELSE 'none' END AS role FROM (SELECT lod, row_number() OVER (ORDER BY voxel) AS rn FROM (SELECT 0 AS lod, 1.0e0 AS voxel UNION ALL SELECT 1, 0.3e0 UNION ALL SELECT 2, 0.1e0))")
def srt07(spark, d):
    lods = spark.createDataFrame([(k, v) for k, v in maps.LODS], "lod int, voxel double").withColumn("rn", F.row_number().over(Window.orderBy("voxel")))
    return lods.select("lod", F.when(F.col("rn") == 1, "berth").when(F.col("rn") == 2, "background").otherwise("none").alias("role"))


@query("srt10_message_caps", "SELECT session, CAST(floor(r / 10e0) AS BIGINT) AS packet, count(*) AS berths FROM (SELECT session, row_number() OVER (PARTITION BY session ORDER BY id) - 1 AS r FROM berths) WHERE r < 25 GROUP BY 1, 2")
def srt10(spark, d):
    b = view(spark, d, "berths").withColumn("r", F.row_number().over(Window.partitionBy("session").orderBy("id")) - 1).filter("r < 25")
    return b.groupBy("session", F.floor(F.col("r") / 10).alias("packet")).agg(F.count("*").alias("berths"))


@query("scl09_pose_inverse", "SELECT kf, round(cos(radians(yaw_deg)) * (10 - tx) + sin(radians(yaw_deg)) * (20 - ty), 5) AS x, round(-sin(radians(yaw_deg)) * (10 - tx) + cos(radians(yaw_deg)) * (20 - ty), 5) AS y FROM kfs")
def scl09(spark, d):
    half = F.radians(F.col("yaw_deg")) / 2
    x, y, _ = geo.inverse_apply_pose(F.lit(10.0), F.lit(20.0), F.lit(0.0), (F.col("tx"), F.col("ty"), F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half)))
    return view(spark, d, "kfs").select("kf", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


@query("scl12_berth_transform", "SELECT id, round(cx * cos(radians(25e0)) - cy * sin(radians(25e0)) + 3e0, 5) AS cx, round(cx * sin(radians(25e0)) + cy * cos(radians(25e0)) - 2e0, 5) AS cy, (angle + 25e0) % 180e0 AS angle, (CASE WHEN angle + 25e0 >= 180e0 THEN (opening_edge + 2) % 4 ELSE opening_edge END) AS edge FROM berths")
def scl12(spark, d):
    x, y = geo.rotate_yaw(F.col("cx"), F.col("cy"), F.lit(25.0))
    turned = F.col("angle") + 25.0
    edge = F.when(turned >= 180.0, geo.opposite_edge(F.col("opening_edge"))).otherwise(F.col("opening_edge"))
    return view(spark, d, "berths").select("id", F.round(x + 3.0, 5).alias("cx"), F.round(y - 2.0, 5).alias("cy"), geo.angle_180(turned).alias("angle"), edge.alias("edge"))


@query("scl28_bev_round_trip", "SELECT id, round(-200e0 + (floor((cx + 200e0) / 0.2e0) + 0.5e0) * 0.2e0, 6) AS x, round(200e0 - (floor((200e0 - cy) / 0.2e0) + 0.5e0) * 0.2e0, 6) AS y FROM berths")
def scl28(spark, d):
    x, y = geo.bev_to_world(*geo.world_to_bev(F.col("cx"), F.col("cy"), -200.0, 200.0, 0.2), -200.0, 200.0, 0.2)
    return view(spark, d, "berths").select("id", r6(x).alias("x"), r6(y).alias("y"))


@query("scl29_weight_ramp", "SELECT id, least(greatest((hits * 100e0 - 300e0) / 2700e0, 0e0), 1e0) AS weight FROM berths")
def scl29(spark, d):
    return view(spark, d, "berths").select("id", F.least(F.greatest((F.col("hits") * 100.0 - 300.0) / 2700.0, F.lit(0.0)), F.lit(1.0)).alias("weight"))


@query("scl33_compass_to_yaw", "SELECT id, round((450e0 - yaw_deg) % 360e0, 6) AS yaw FROM nav")
def scl33(spark, d):
    return view(spark, d, "nav").select("id", r6(geo.compass_to_yaw(F.col("yaw_deg"))).alias("yaw"))


@query("scl34_config_clamps", "SELECT id, least(greatest(hits, 3), 15) AS frames, greatest(value_, 0.02e0) AS voxel FROM (SELECT id, hits, (hits - 10) / 100e0 AS value_ FROM berths)")
def scl34(spark, d):
    h = F.col("hits")
    return view(spark, d, "berths").select("id", F.least(F.greatest(h, F.lit(3)), F.lit(15)).alias("frames"), F.greatest((h - 10) / 100.0, F.lit(0.02)).alias("voxel"))


@query("ker13_map_overlap", "WITH a AS (SELECT min(ts) AS lo, max(ts) AS hi FROM kfs WHERE tx < 10e0), b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM kfs WHERE tx >= -20e0) SELECT round(greatest(0e0, least(a.hi, b.hi) - greatest(a.lo, b.lo)), 3) AS overlap, (SELECT count(*) FROM kfs k WHERE k.tx >= -20e0 AND k.ts > a.hi) AS kept FROM a, b")
def ker13(spark, d):
    k = view(spark, d, "kfs")
    a = k.filter("tx < 10").agg(F.min("ts").alias("a_lo"), F.max("ts").alias("a_hi"))
    b = k.filter("tx >= -20")
    s = b.join(F.broadcast(a)).groupBy("a_lo", "a_hi").agg(F.min("ts").alias("b_lo"), F.max("ts").alias("b_hi"), F.count_if(F.col("ts") > F.col("a_hi")).alias("kept"))
    lap = F.greatest(F.lit(0.0), F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo"))
    return s.select(F.round(lap, 3).alias("overlap"), "kept")


@query("ker16_virtual_keyframe", "WITH l AS (SELECT min(x) AS ax, max(x) AS zx, min(y) AS ay, max(y) AS zy FROM pts WHERE kf = 3) SELECT kf, idx FROM pts, l WHERE kf <> 3 AND x BETWEEN ax AND zx AND y BETWEEN ay AND zy")
def ker16(spark, d):
    p = view(spark, d, "pts")
    live = p.filter("kf = 3").agg(F.min("x").alias("ax"), F.max("x").alias("zx"), F.min("y").alias("ay"), F.max("y").alias("zy"))
    inside = F.col("x").between(F.col("ax"), F.col("zx")) & F.col("y").between(F.col("ay"), F.col("zy"))
    return p.filter("kf <> 3").join(F.broadcast(live), inside).select("kf", "idx")


@query("str05_rollback_epochs", "SELECT seq, CAST(sum(CASE WHEN generation < p THEN 1 ELSE 0 END) OVER (PARTITION BY sensor, unit ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM (SELECT *, lag(generation) OVER (PARTITION BY sensor, unit ORDER BY seq) AS p FROM frames)")
def str05(spark, d):
    w = Window.partitionBy("sensor", "unit").orderBy("seq")
    return temporal.islands(view(spark, d, "frames"), ["sensor", "unit"], ["seq"], F.col("generation") < F.lag("generation").over(w), "epoch").select("seq", "epoch")


@query("str11_recall_merge", "WITH a AS (SELECT * FROM berths WHERE id % 2 = 0 AND hits >= 5), b AS (SELECT * FROM berths WHERE id % 2 = 1) SELECT id, 'live' AS origin FROM b UNION ALL SELECT id, 'recalled' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.kind <> a.kind AND pow(a.cx-b.cx, 2) + pow(a.cy-b.cy, 2) <= 36e0)")
def str11(spark, d):
    b = view(spark, d, "berths")
    live, known = b.filter("id % 2 = 1"), b.filter("id % 2 = 0 AND hits >= 5")
    met = spatial.radius_join(known, live, 6.0, ("cx", "cy")).filter("kind <> r_kind").select("id").distinct()
    return live.select("id", F.lit("live").alias("origin")).unionByName(known.join(met, "id", "left_anti").select("id", F.lit("recalled").alias("origin")))


@query("str14_overlay_pairing", """WITH r AS (SELECT seq, ts, unit FROM frames WHERE sensor = 'signup'), p AS (SELECT DISTINCT seq, ts, unit FROM frames WHERE sensor = 'purchase') SELECT r.seq, arg_min(p.seq, struct_pack(g := abs(r.ts - p.ts), s := p.seq)) AS pose FROM r JOIN p ON r.unit = p.unit AND abs(r.ts - p.ts) <= 900e0 GROUP BY r.seq""")
def str14(spark, d):
    f = view(spark, d, "frames")
    out = temporal.nearest_in_time(f.filter("sensor = 'signup'"), f.filter("sensor = 'purchase'").dropDuplicates(["unit", "ts"]), 900.0, "seq", by=("unit",))
    return out.filter("r_seq IS NOT NULL").select("seq", F.col("r_seq").alias("pose"))


@query("str04_sensor_fusion", """WITH m AS (SELECT seq, ts, unit FROM frames WHERE sensor = 'view'), h AS (SELECT m.seq, f.sensor, arg_min(f.seq, struct_pack(g := abs(m.ts - f.ts), s := f.seq)) AS match FROM m JOIN frames f ON f.sensor <> 'view' AND m.unit = f.unit AND abs(m.ts - f.ts) <= 1500e0 GROUP BY 1, 2) SELECT seq, count(*) + 1 AS sensors FROM h GROUP BY seq""")
def str04(spark, d):
    f = view(spark, d, "frames")
    others = f.filter("sensor <> 'view'").select("seq", "ts", "sensor", "unit")
    master = f.filter("sensor = 'view'").select("seq", "ts", "unit")
    master = master.withColumn("sensor", F.explode(F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup")])))
    master = master.withColumn("id", F.struct("seq", "sensor"))
    near = temporal.nearest_in_time(master, others, 1500.0, "id", by=("sensor", "unit"))
    return near.filter("r_seq IS NOT NULL").groupBy("seq").agg((F.count("*") + 1).alias("sensors"))


@query("src30_log_retention", "SELECT day FROM (SELECT day, row_number() OVER (ORDER BY day DESC) AS r FROM (SELECT DISTINCT CAST(floor(ts / 86400e0) AS BIGINT) AS day FROM frames)) WHERE r > 7")
def src30(spark, d):
    days = view(spark, d, "frames").select(F.floor(F.col("ts") / 86400.0).alias("day")).distinct()
    return days.withColumn("r", F.row_number().over(Window.orderBy(F.desc("day")))).filter("r > 7").select("day")


@query("src35_berth_resend", "SELECT id, CAST(floor((35.4e0 + cy / 111320e0) * 2147483648e0 / 180e0 + 0.5e0) AS BIGINT) AS lat_code FROM berths WHERE cy >= 0")
def src35(spark, d):
    b = view(spark, d, "berths").filter("cy >= 0")
    return b.select("id", geo.encode_geo(35.4 + F.col("cy") / geo.METRES_PER_DEGREE).alias("lat_code"))
