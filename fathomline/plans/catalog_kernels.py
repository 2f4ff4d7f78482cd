"""Queries of iterative kernels and state machines, whose results tests check against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import berths, folds, kernels
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


@query("join10_rect_overlap_iou")
def join10(spark, d):
    b = view(spark, d, "berths").withColumn("angle", F.col("angle"))
    return berths.overlapping_rects(b.select("id", "cx", "cy", "w", "l", "angle"), 0.05).select("id", "other", r6("iou").alias("iou"))


@query("join17_edge_crossings", """WITH b AS (SELECT id, cx, cy, w, l FROM berths), p AS (SELECT a.id, c.id AS other, a.cx AS ax, a.cy AS ay, a.w AS aw, a.l AS al, c.cx AS bx, c.cy AS byy, c.w AS bw, c.l AS bl FROM b a JOIN b c ON a.id < c.id AND abs(a.cx - c.cx) < 30e0 AND abs(a.cy - c.cy) < 30e0)
 SELECT id, other FROM p WHERE (abs(ax - bx) <= (aw + bw) / 2e0 AND abs(ay - byy) <= (al + bl) / 2e0) AND NOT (abs(ax - bx) < abs(aw - bw) / 2e0 AND abs(ay - byy) < abs(al - bl) / 2e0 AND (aw - bw) * (al - bl) > 0)""")
def join17(spark, d):
    b = view(spark, d, "berths").withColumn("angle", F.lit(0.0))
    return berths.crossing_outlines(b.select("id", "cx", "cy", "w", "l", "angle"))


@query("agg13b_water_plane")
def agg13b(spark, d):
    p = view(spark, d, "pts").select(F.floor(F.col("kf") / 500).cast("long").alias("key"), F.col("kf").alias("frame"), F.col("kf").cast("double").alias("ts"), "x", "y", (F.col("z") * 0.02).alias("z"))
    return kernels.remove_water(p, clearance=0.005, neighbours=0, least=50).groupBy("frame").agg(F.count("*").alias("kept"))


@query("agg19b_ordered_merge", """WITH RECURSIVE p AS (SELECT session AS key, id, kind, cx, cy, CAST(w AS DOUBLE) AS w, CAST(l AS DOUBLE) AS l, angle, CAST(hits AS BIGINT) AS n, row_number() OVER (PARTITION BY session ORDER BY id) AS r FROM berths),
 s AS (SELECT key, r, [struct_pack(id := id, kind := kind, x := cx, y := cy, w := w, l := l, angle := angle, n := n)] AS known FROM p WHERE r = 1 UNION ALL
  SELECT key, r, CASE WHEN best IS NULL THEN list_append(known, struct_pack(id := id, kind := kind, x := cx, y := cy, w := w, l := l, angle := angle, n := n)) ELSE list_transform(known, lambda b, i: CASE WHEN i <> best THEN b ELSE
    struct_pack(id := b.id, kind := b.kind, x := b.x + (cx - b.x) * (n / (b.n + n)), y := b.y + (cy - b.y) * (n / (b.n + n)), w := b.w + (w - b.w) * (n / (b.n + n)), l := b.l + (l - b.l) * (n / (b.n + n)),
     angle := (b.angle + ((angle - b.angle + 270e0) % 180e0 - 90e0) * (n / (b.n + n)) + 180e0) % 180e0, n := b.n + n) END) END FROM
   (SELECT *, list_min(list_filter(list_transform(known, lambda b, i: struct_pack(d := sqrt((cx - b.x) * (cx - b.x) + (cy - b.y) * (cy - b.y)), i := i, ok := b.kind = kind AND abs(w - b.w) <= 0.35e0 * b.w AND abs(l - b.l) <= 0.35e0 * b.l
      AND least((angle - b.angle + 180e0) % 180e0, 180e0 - (angle - b.angle + 180e0) % 180e0) <= 60e0)), lambda c: c.ok AND c.d <= 30e0)).i AS best FROM (SELECT p.*, s.known FROM s JOIN p ON p.key = s.key AND p.r = s.r + 1)))
 SELECT key, b.id AS id, b.kind AS kind, round(b.x, 4) AS cx, round(b.y, 4) AS cy, b.n AS n FROM (SELECT key, unnest(known) AS b FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r DESC) AS last FROM s) WHERE last = 1)""")
def agg19b(spark, d):
    b = view(spark, d, "berths").select(F.col("session").alias("key"), F.col("id").alias("seq"), "id", "kind", "cx", "cy", F.col("w").cast("double").alias("w"), F.col("l").cast("double").alias("l"), "angle", F.col("hits").cast("long").alias("n"))
    return folds.merged_berths(b, gate=30.0, angle_gate=60.0).select("key", "id", "kind", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), "n")


@query("srt03b_greedy_suppression")
def srt03b(spark, d):
    b = view(spark, d, "berths").select(F.col("session").alias("key"), "id", "cx", "cy", F.col("w").cast("double").alias("w"), F.col("l").cast("double").alias("l"), "angle", F.col("hits").cast("double").alias("score"))
    return berths.suppressed(b, most=12)


@query("scl18_convex_hulls")
def scl18(spark, d):
    return berths.hulls(view(spark, d, "pts").select(F.col("kf").alias("key"), "x", "y")).select("key", "corners", F.round("area", 4).alias("area"))


@query("ker14_translation_only", "SELECT CAST(label AS BIGINT) AS key, -0.4e0 AS tx, 0.3e0 AS ty, 1e0 AS match FROM vec GROUP BY label")
def ker14(spark, d):
    v = view(spark, d, "vec").select(F.col("label").cast("long").alias("key"), (F.col("x") * 40).alias("x"), (F.col("y") * 40).alias("y"))
    both = v.withColumn("side", F.lit("t")).unionByName(v.select("key", (F.col("x") + 0.4).alias("x"), (F.col("y") - 0.3).alias("y")).withColumn("side", F.lit("s")))
    found = kernels.register_maps(both, reach=2.0)
    return found.select("key", F.round("tx", 3).alias("tx"), F.round("ty", 3).alias("ty"), F.round("match", 4).alias("match"))


@query("ker11_track_filter")
def ker11(spark, d):
    n = view(spark, d, "nav").select(F.col("unit").alias("key"), "ts", (F.col("lat") * 100).alias("x"), (F.col("lon") * 100).alias("y"), F.col("alt").alias("z"))
    return kernels.smooth_track(n).groupBy("key").agg(F.count("*").alias("n"), F.count_if("taken").alias("taken"))


@query("str09_stability")
def str09(spark, d):
    b = view(spark, d, "berths").select(F.col("session").alias("key"), F.col("id").alias("seq"), (F.col("cx") * 0.01).alias("cx"), (F.col("cy") * 0.01).alias("cy"), F.col("w").cast("double").alias("w"), (8 + F.col("hits") % 3).cast("double").alias("l"), (F.col("angle") * 0.1).alias("angle"))
    return folds.stable_berths(b).select("key", "seq", "state", F.round("cx", 5).alias("cx"), F.round("angle", 5).alias("angle"))


@query("str12_hysteresis", """WITH RECURSIVE p AS (SELECT CAST(unit AS VARCHAR) AS key, id AS seq, ts, value < 40e0 AS stable, row_number() OVER (PARTITION BY unit ORDER BY id) AS r FROM nav),
 s AS (SELECT key, r, seq, ts AS last, false AS standby, CASE WHEN stable THEN 1 ELSE 0 END AS run FROM p WHERE r = 1 UNION ALL
  SELECT key, r, seq, last, CASE WHEN run >= 3 THEN NOT standby ELSE standby END, CASE WHEN run >= 3 THEN 0 ELSE run END FROM
   (SELECT key, r, seq, CASE WHEN same THEN was ELSE ts END AS last, standby, CASE WHEN same THEN run WHEN stable <> standby THEN run + 1 ELSE 0 END AS run FROM
    (SELECT p.key, p.r, p.seq, p.ts, p.stable, s.last AS was, abs(p.ts - s.last) <= 1e-6 AS same, CASE WHEN p.ts < s.last - 1e-6 THEN false ELSE s.standby END AS standby, CASE WHEN p.ts < s.last - 1e-6 THEN 0 ELSE s.run END AS run FROM s JOIN p ON p.key = s.key AND p.r = s.r + 1)))
 SELECT key, seq, standby FROM s""")
def str12(spark, d):
    n = view(spark, d, "nav").select(F.col("unit").cast("string").alias("key"), F.col("id").alias("seq"), "ts", (F.col("value") < 40.0).alias("stable"))
    return folds.schedule_detection(n, 3, 3)


@query("str17_lru_cache", """WITH RECURSIVE p AS (SELECT CAST(unit AS VARCHAR) AS key, seq, 't' || (port % 9) AS tile, row_number() OVER (PARTITION BY unit ORDER BY seq) AS r FROM frames),
 s AS (SELECT key, r, seq, tile, false AS hit, '' AS evicted, [tile] AS held FROM p WHERE r = 1 UNION ALL
  SELECT key, r, seq, tile, hit, coalesce(victim, ''), CASE WHEN victim IS NULL THEN held ELSE list_filter(held, lambda x: x <> victim) END FROM
   (SELECT *, CASE WHEN len(held) > 5 THEN list_filter(held, lambda x: x <> tile AND x <> 't0')[1] END AS victim FROM
    (SELECT p.key, p.r, p.seq, p.tile, list_contains(s.held, p.tile) AS hit, list_append(list_filter(s.held, lambda x: x <> p.tile), p.tile) AS held FROM s JOIN p ON p.key = s.key AND p.r = s.r + 1)))
 SELECT key, seq, tile, hit, evicted, array_to_string(held, ',') AS resident FROM s""")
def str17(spark, d):
    f = view(spark, d, "frames").select(F.col("unit").cast("string").alias("key"), "seq", F.concat(F.lit("t"), F.col("port") % 9).alias("tile"), F.lit(100).cast("long").alias("size"), F.lit("t0").alias("pinned"))
    return folds.lru_trace(f, 500)


@query("ker19_pier_interval_merge", """WITH i AS (SELECT session, cx - w / 2e0 AS a, cx + w / 2e0 AS z FROM berths), m AS (SELECT *, max(z) OVER (PARTITION BY session ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
 g AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p + 0.2e0 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS n FROM m) SELECT session, round(min(a), 5) AS a, round(max(z), 5) AS z, count(*) AS parts FROM g GROUP BY session, n""")
def ker19(spark, d):
    i = view(spark, d, "berths").select("session", (F.col("cx") - F.col("w") / 2).alias("a"), (F.col("cx") + F.col("w") / 2).alias("z"))
    return berths.merged_intervals(i, ["session"], 0.2).select("session", F.round("a", 5).alias("a"), F.round("z", 5).alias("z"), "parts")


@query("scl26b_distinct_shapes", "SELECT session, count(DISTINCT (w, l, angle)) AS shapes FROM berths GROUP BY session")
def digests(spark, d):
    h = F.xxhash64("w", "l", "angle")
    return view(spark, d, "berths").groupBy("session").agg(F.count_distinct(h).alias("shapes"))
