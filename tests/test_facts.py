"""Known facts about single operators, state machines and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import geo
from fathomline.operators import berths, folds, kernels, maps, spatial, temporal


def test_tile_index_and_viewport(spark):
    df = spark.createDataFrame([(-0.01,), (0.0,), (49.999,), (50.0,), (float("nan"),)], "c double")
    assert [r[0] for r in df.select(geo.tile_index(F.col("c"), 0.0, 50.0)).collect()] == [-1, 0, 0, 1, 0]
    box = spark.createDataFrame([(-10.0, -5.0, 60.0, 40.0)], "min_x double, min_y double, max_x double, max_y double")
    assert maps.viewport_tiles(box).count() == 6 and maps.viewport_tiles(box, ring=1).count() == 20


def test_level_of_detail_for_view(spark):
    df = spark.createDataFrame([(10.0,), (60.0,), (300.0,)], "h double")
    assert [r.lod for r in maps.choose_lod(df, "h", 800).orderBy("h").collect()] == [2, 1, 0]


def test_tiles_of_two_keyframes(spark):
    pts = [(1, 0, -49.0, 10.0, 0.0), (1, 1, -48.96, 10.04, 0.0), (1, 2, 0.0 - 0.001, 10.0, 1.0), (2, 0, 51.0, 10.0, 0.0), (2, 1, 51.15, 10.0, 0.0)]
    tiles = maps.build_tiles(spark.createDataFrame(pts, "kf long, idx long, wx double, wy double, wz double"))
    by = {r.lod: r["count"] for r in tiles.groupBy("lod").count().collect()}
    assert sorted({r.tile_x for r in tiles.collect()}) == [-1, 1] and by[0] <= by[1] <= by[2] and by[0] < 5


def test_water_scene():
    rng = np.random.default_rng(0)
    grid = np.array([(x * 0.5, y * 0.5, rng.choice([-0.01, 0, 0.01])) for x in range(21) for y in range(21)])
    plane = kernels.fit_plane(grid)
    assert plane is not None and plane[2] > 0.99
    assert kernels.fit_plane(rng.uniform(-5, 5, (300, 3))) is None


def test_water_removal(spark):
    rows = [(1, 1, 0.0, x * 0.5, y * 0.5, (-0.01, 0.0, 0.01)[(x + y) % 3]) for x in range(21) for y in range(21)]
    rows += [(1, 1, 0.0, k * 0.5, 7.0, -0.6) for k in range(20)] + [(1, 1, 0.0, 8 + i * 0.1, 8 + j * 0.1, 0.65) for i in range(4) for j in range(4)]
    rows += [(1, 2, 1.0, 8.0 + i * 0.1, 8.0, 0.65) for i in range(4)] + [(1, 2, 1.0, 3.0, 3.0, 0.0)]  # no plane of its own
    df = spark.createDataFrame(rows, "key long, frame long, ts double, x double, y double, z double")
    got = kernels.remove_water(df).groupBy("frame").count().collect()
    assert {r.frame: r["count"] for r in got} == {1: 16, 2: 4}


def test_rectangles(spark):
    assert kernels.rect_iou((0, 0, 2, 2, 0), (1, 0, 2, 2, 0)) == pytest.approx(1 / 3)
    assert kernels.rect_iou((0, 0, 2, 2, 0), (0, 0, 2, 2, 90)) == pytest.approx(1.0) and kernels.rect_iou((0, 0, 2, 2, 0), (9, 0, 2, 2, 45)) == 0
    assert kernels.suppress([(0, 0, 8, 12, 0), (0.5, 0, 8, 12, 0), (30, 0, 8, 12, 0)], [1.0, 2.0, 0.5]) == [1, 2]
    df = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0, 0.0), (2, 3.0, 0.0, 4.0, 4.0, 45.0), (3, 50.0, 0.0, 4.0, 4.0, 0.0)], "id long, cx double, cy double, w double, l double, angle double")
    assert [(r.id, r.other) for r in berths.overlapping_rects(df, 0.01).collect()] == [(1, 2)] == [(r.id, r.other) for r in berths.crossing_outlines(df).collect()]


def test_occupancy_needs_a_hundred_points(spark):
    rects = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 20.0, 30.0)], "id long, cx double, cy double, w double, l double, angle double")
    rng = np.random.default_rng(4)
    pts = rng.uniform(-20, 20, (4000, 2))
    c, s = math.cos(math.radians(30)), math.sin(math.radians(30))
    u, v = pts[:, 0] * c + pts[:, 1] * s, -pts[:, 0] * s + pts[:, 1] * c
    expected = int(((abs(u) <= 4.2) & (abs(v) <= 9.2)).sum())
    got = spatial.occupancy(spark.createDataFrame(pts.tolist(), "x double, y double"), rects, "id").first()
    assert got.inside == expected and got.occupied == (expected >= 100)


def test_nearest_takes_the_first_of_a_tie(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 20.0)], "seq long, ts double")
    right = spark.createDataFrame([(5, 9.95), (4, 10.05), (6, 25.0)], "seq long, ts double")
    got = {r.seq: r.r_seq for r in temporal.nearest_in_time(left, right, 0.1, "seq").collect()}
    assert got == {1: 4, 2: None}


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (102, 100)]
    nodes = spark.createDataFrame([(k,) for k in [*range(0, 42), 100, 101, 102]], "node long")
    got = {r.node: r.component for r in spatial.connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[41] == 41 and {got[k] for k in (100, 101, 102)} == {100}


class Row:
    def __init__(self, **k):
        self.__dict__.update(k)


def berth(seq, x=0.0, w=8.0, l=12.0, angle=10.0):
    return Row(key="a", seq=seq, cx=x, cy=0.0, w=w, l=l, angle=angle)


def test_stability_traces():
    states = [r[2] for r in folds.stability_step()([berth(k) for k in range(8)], {})]
    out = list(folds.stability_step()([berth(k, x=0.1 * (k % 2)) for k in range(8)], {}))
    assert states == ["accepted"] * 8 and out[6][3] is None and out[7][3] == pytest.approx(0.05)
    trace = [berth(k) for k in range(8)] + [berth(8 + k, x=20.0) for k in range(5)]
    out = list(folds.stability_step()(trace, {}))
    assert [r[2] for r in out[8:]] == ["outlier"] * 4 + ["replaced"] and out[-1][3] == 20.0
    trace = [berth(k) for k in range(8)] + [berth(8, 20.0), berth(9, 20.0), berth(10, x=None), *[berth(11 + k, 20.0) for k in range(4)]]
    assert "replaced" not in [r[2] for r in folds.stability_step()(trace, {})]
    swapped = [berth(k) for k in range(7)] + [berth(7, w=12.0, l=8.0, angle=100.0)]
    last = list(folds.stability_step()(swapped, {}))[-1]
    assert last[2] == "accepted" and last[5:7] == (8.0, 12.0)


def test_scheduler_traces():
    def run(ts, stable):
        return [r[2] for r in folds.hysteresis_step(10, 10)([Row(key="a", seq=k, ts=t, stable=s) for k, (t, s) in enumerate(zip(ts, stable, strict=True))], {})]

    assert run(range(10), [True] * 10) == [False] * 9 + [True]
    assert run([0] * 20, [True] * 20) == [False] * 20
    assert run(range(20), [True] * 10 + [False] * 10)[-2:] == [True, False]
    assert run([*range(10), 0], [True] * 11)[-1] is False


def test_lru_trace():
    rows = [Row(key="c", seq=k, tile=t, size=100, pinned=p) for k, (t, p) in enumerate([("a", ""), ("b", ""), ("a", ""), ("c", "")])]
    assert list(folds.lru_step(200)(rows, {}))[-1][4:] == ("b", "a,c")
    rows[-1].pinned = "a,b"
    assert list(folds.lru_step(200)(rows, {}))[-1][4] == ""


def test_registration_and_filter():
    rng = np.random.default_rng(6)
    t = rng.uniform(-20, 20, (200, 2))
    found = kernels.icp_2d(t - (0.4, -0.3), t, reach=2.0)
    assert (found["tx"], found["ty"]) == pytest.approx((0.4, -0.3), abs=0.02) and found["match"] > 0.95
    yaw = math.radians(7)
    r = np.array([[math.cos(yaw), -math.sin(yaw)], [math.sin(yaw), math.cos(yaw)]])
    assert kernels.rigid_fit_2d(t, t @ r.T + (1, 2)) == pytest.approx((yaw, 1.0, 2.0))
    f = kernels.ConstantVelocityFilter()
    for k in range(60):
        f.predict(0.1)
        f.update(np.array([k * 0.1, 0.0, 0.0]), 0.05)
    assert f.x[3] == pytest.approx(1.0, abs=0.1) and not f.update(np.array([500.0, 0, 0]), 0.05)
    assert len(kernels.convex_hull(np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)], float))) == 4


def test_geodesy_round_trip(spark):
    df = spark.createDataFrame([(35.401, 119.502, 7.0)], "lat double, lon double, alt double")
    e, n, _ = geo.geodetic_to_enu(F.col("lat"), F.col("lon"), F.col("alt"), 35.4, 119.5, 7.0)
    la, lo, _ = geo.enu_to_geodetic(e, n, F.lit(0.0), F.lit(35.4), F.lit(119.5), F.lit(7.0))
    r = df.select(la.alias("la"), lo.alias("lo")).first()
    assert r.la == pytest.approx(35.401, abs=1e-6) and r.lo == pytest.approx(119.502, abs=1e-6)


def test_streams(spark, tmp_path):
    from fathomline.streaming import operators as st

    src = str(tmp_path / "in")
    schema = "source string, key string, generation long, seq long, ts double"
    rows = [("a", "k1", 0, k, 100.0 + k) for k in range(12)] + [("b", "k2", 0, k, 100.0 + k) for k in range(3)] + [("b", "k1", 1, k, 100.0 + k) for k in range(4)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)

    def drain(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    stream = lambda: spark.readStream.schema(schema).parquet(src)
    got = drain(st.confirmations(stream(), 5), "append", "confirmed")
    assert [(r.key, r.generation, r.seq) for r in got] == [("k1", 0, 4)]
    rates = drain(st.packet_rates(stream()), "complete", "rates")
    assert sum(r.packets for r in rates) == 19
    latest = drain(st.latest_state(stream(), "source", "seq"), "complete", "latest")
    assert {r.source: r.seq for r in latest} == {"a": 11, "b": 3}
    poses = stream().select(F.col("generation").alias("key"), "ts", (F.col("seq") * 0.3).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("yaw")).filter("key = 1")
    assert [round(r.x, 1) for r in drain(st.keyframes(poses), "append", "kfs_stream")] == [0.0, 0.6]
    pairs = drain(st.paired_in_time(stream().filter("source = 'a'"), stream().filter("source = 'b' AND generation = 0"), 0.5), "append", "pairs")
    assert sorted((r.seq, r.r_seq) for r in pairs) == [(0, 0), (1, 1), (2, 2)]
