"""Registration, tracking and digests against known answers, streams and brute force."""

import math

import numpy as np
import pytest

from fathomline.functions import digest
from fathomline.operators import kernels, registration, spatial, tracking
from fathomline.sources import formats


def test_nearest_is_the_nearest():
    rng = np.random.default_rng(1)
    t, s = rng.uniform(-10, 10, (300, 3)), rng.uniform(-12, 12, (200, 3))
    at, d = registration.nearest(t, s, 2.0)
    every = np.linalg.norm(s[:, None] - t[None], axis=2)
    want = np.where(every.min(axis=1) <= 2.0, every.argmin(axis=1), -1)
    assert (at == want).all() and np.allclose(d[at >= 0], every.min(axis=1)[at >= 0]) and np.isinf(d[at < 0]).all()
    assert (registration.nearest(t[:0], s, 1.0)[0] == -1).all()
    assert (kernels.neighbour_counts(t, t[:50], 3.0) == (np.linalg.norm(t[:50, None] - t[None], axis=2) <= 3.0).sum(axis=1)).all()


def test_normal_equations_are_the_derivative():
    rng = np.random.default_rng(2)
    p, q, w = rng.normal(size=(40, 3)), rng.normal(size=(40, 3)), np.broadcast_to(np.eye(3), (40, 3, 3))
    h, g, cost = registration.normal_equations(p, q, w)
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        m = registration.motion(step)
        after = registration.normal_equations(p @ m[:3, :3].T + m[:3, 3], q, w)[2]
        assert (after - cost) / 2e-6 == pytest.approx(g[k], rel=1e-3, abs=1e-3)
    assert np.allclose(h, h.T) and (np.linalg.eigvalsh(h) > 0).all()


@pytest.mark.parametrize("mode", ["plane", "least", "relative", "frobenius"])
def test_generalised_closest_points_find_the_motion(mode):
    rng = np.random.default_rng(3)
    u, v = rng.uniform(-10, 10, (2, 400))
    t = np.concatenate([np.stack([u, v, np.zeros(400)], 1), np.stack([u, np.full(400, 10.0), abs(v)], 1), np.stack([np.full(400, -10.0), u, abs(v)], 1)])
    move = registration.motion(np.array([0.02, -0.03, 0.05, 0.3, -0.2, 0.1]))
    s = (t - move[:3, 3]) @ move[:3, :3]
    r = registration.gicp(s, t, reach=3.0)
    assert np.allclose(r["pose"], move, atol=0.01) and r["matches"] == len(s)
    assert registration.hessian_covariance(r["hessian"]).shape == (6, 6)


def test_stitch_accepts_and_refuses():
    rng = np.random.default_rng(4)
    t = rng.uniform(-40, 40, (600, 3)) * (1, 1, 0.1)
    found = registration.stitch(t - (1.4, -0.6, 0.0), t)
    assert found["accepted"] and (found["tx"], found["ty"]) == pytest.approx((1.4, -0.6), abs=0.01)
    turned = registration.turned(t, -3.0, 0.0, 0.0)
    assert registration.stitch(turned, t, with_yaw=True)["yaw"] == pytest.approx(3.0, abs=0.05)
    far = registration.stitch(t + (500.0, 0.0, 0.0), t)
    assert not far["accepted"] and far["refused"] == "match"


def test_tracks_of_clusters():
    tracker = tracking.Tracker()
    assert tracker.advance([(1, 0.0, 0.0, 2.0, False), (2, 20.0, 0.0, 5.0, True)]) == [(2, 0, True), (1, 1, True)]
    # the larger cluster chooses first; a cluster beyond the gate begins a track
    assert tracker.advance([(3, 1.0, 0.0, 2.0, False), (4, 24.5, 0.0, 5.0, False)]) == [(4, 2, True), (3, 1, False)]
    for _ in range(8):
        tracker.advance([(9, 24.5, 0.0, 5.0, False)])
    assert set(tracker.tracks) == {0, 1, 2}
    tracker.advance([(9, 24.5, 0.0, 5.0, False)])
    assert set(tracker.tracks) == {0, 2}  # the ninth frame missed ends a track, a locked one stays for thirty
    again = tracking.Tracker.loads(tracker.dumps())
    assert again.tracks == tracker.tracks and again.following == tracker.following


def test_tracks_in_batch_and_stream_agree(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(str(k % 3), int(f), 100 * f + c, float(x), float(y), float(1 + c), bool(c == 0)) for k in range(3) for f in range(12) for c, (x, y) in enumerate(rng.uniform(0, 12, (3, 2)))]
    schema = "key string, frame long, id long, x double, y double, size double, locked boolean"
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, tracking.track_clusters(df).collect()))
    for part in range(3):
        df.filter(f"frame div 4 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracking.track_clusters_stream(stream).writeStream.format("memory").queryName("tracks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tracks").collect())) == want


def test_digest_of_bytes():
    a = np.frombuffer(b"a", np.uint8)[None, :]
    assert digest.fnv1a(a, np.uint64(0xCBF29CE484222325))[0] == np.uint64(0xAF63DC4C8601EC8C)
    assert digest.fnv1a(np.zeros((2, 0), np.uint8)).tolist() == [int(digest.FNV_START)] * 2


def test_geometry_digests_follow_the_bytes(spark):
    rows = [(1, 1.5, 2.0, 3.0, 8.0, 12.0, 30.0, 1, 2), (2, 1.5, 2.0, 3.0, 8.0, 12.0, 30.0, 1, 1)]
    df = spark.createDataFrame(rows, "id long, ts double, cx double, cy double, w double, l double, angle double, opening_edge int, kind int")
    import struct

    def brute(r):
        h = 1469598103934665603
        for b in struct.pack("<dQdddddii", r[1], 1, *r[2:7], r[7], r[8]):
            h = (h ^ b) * 1099511628211 % 2**64
        return h - 2**64 if h >= 2**63 else h

    assert {r.id: r.digest for r in digest.geometry_digest(df).collect()} == {r[0]: brute(r) for r in rows}


def test_pairs_are_named_once(spark):
    rng = np.random.default_rng(6)
    p = [(k, int(k % 2), *map(float, rng.uniform(0, 6, 3))) for k in range(120)]
    df = spark.createDataFrame(p, "idx long, kf int, x double, y double, z double")
    got = sorted((r.idx, r.r_idx) for r in spatial.radius_pairs(df, 1.2, "idx", by=("kf",)).collect())
    want = sorted((a[0], b[0]) for a in p for b in p if a[0] < b[0] and a[1] == b[1] and math.dist(a[2:], b[2:]) <= 1.2)
    assert got == want and got


def test_low_outliers_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    p = [(k, 0, *map(float, rng.normal(0, 1.5, 2)), float(rng.uniform(0, 2))) for k in range(150)]
    df = spark.createDataFrame(p, "idx long, kf int, x double, y double, z double")
    got = sorted(r.idx for r in spatial.low_outliers(df, "kf", "idx", "z", 1.0, 0.8, 3).collect())
    near = {a[0]: sum(a[0] != b[0] and math.dist(a[2:], b[2:]) <= 0.8 for b in p) for a in p}
    assert got == sorted(a[0] for a in p if a[4] > 1.0 or near[a[0]] >= 3) and 0 < len(got) < 150


def test_clouds_as_archives():
    pts = {"x": np.array([1.0, 2.0]), "y": np.array([3.0, 4.0]), "z": np.array([5.0, 6.0]), "intensity": np.array([7.0, 8.0])}
    m = formats.compatible_archive("a/B.PCD", formats.pack_pcd(pts))
    assert m["keyframes"][0]["points"]["y"].tolist() == [3.0, 4.0] and m["keyframes"][0]["points"]["intensity"].tolist() == [7, 8] and not m["anchor"]["valid"]
    with pytest.raises(formats.FormatError):
        formats.compatible_archive("a.las", b"")
    packet = formats.grid_packet(7, 1, -2, 3, 4, (-5, 6, 7), 50, bytes(range(256)) * 5)
    back = formats.unpack_grid_packet(packet)
    assert len(packet) == formats.GRID_SIZE and back["chunk"] == (-5, 6, 7) and back["bits"] == bytes(range(256)) * 5 and back["lat"] == -2


def test_berth_store_in_batch_and_stream_agree(spark, tmp_path):
    from fathomline.operators import folds
    from fathomline.streaming import operators as st

    rng = np.random.default_rng(8)
    rows = [("m" + str(k % 2), k, k, int(1 + k % 2), float(20 * (k % 3) + rng.normal(0, 0.2)), float(rng.normal(0, 0.2)), 8.0, 12.0, float(rng.uniform(175, 185) % 180), 1) for k in range(60)]
    rows.append(("m0", 60, 60, 1, float("nan"), 0.0, 8.0, 12.0, 0.0, 1))
    schema = "key string, seq long, id long, kind int, cx double, cy double, w double, l double, angle double, n long"
    df = spark.createDataFrame(rows, schema)
    want = {(r.key, r.id): (r.n, round(r.cx, 6), round(r.angle, 6)) for r in folds.merged_berths(df).collect()}
    assert sum(n for n, _, _ in want.values()) == 60 and all(min(a, 180 - a) < 6 for _, _, a in want.values())
    for part in range(3):
        df.filter(f"seq div 21 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}
    q = st.berth_store(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.update({(r.key, r.id): (r.n, round(r.cx, 6), round(r.angle, 6)) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == want


def test_timelines_and_rings(spark, tmp_path):
    from fathomline.streaming import operators as st

    schema = "source string, generation long, seq long"
    for k, rows in enumerate(([("a", 0, 1), ("a", 0, 2), ("a", 1, 3)], [("a", 0, 4), ("a", 1, 5), ("b", 0, 6)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.seq for r in drain(st.newest_timeline(stream()), "timeline")) == [1, 2, 3, 5, 6]
    got = drain(st.ring(stream(), keep=1), "ring")
    assert sorted((r.source, r.seq, r.missed) for r in got) == [("a", 3, 2), ("a", 5, 3), ("b", 6, 0)]


def test_overlaps_at_once_are_those_one_by_one():
    rng = np.random.default_rng(10)
    a, b = (np.column_stack([rng.uniform(-3, 3, (300, 2)), rng.uniform(1, 6, (300, 2)), rng.uniform(0, 180, 300)]) for _ in range(2))
    a[:5], b[:5] = (0, 0, 4, 4, 0), [(0, 0, 4, 4, 0), (0, 0, 4, 4, 90), (0, 0, 2, 2, 0), (4, 0, 4, 4, 0), (9, 9, 1, 1, 45)]
    want = [kernels.rect_iou(tuple(x), tuple(y)) for x, y in zip(a, b, strict=True)]
    assert np.allclose(kernels.rect_ious(a, b), want, atol=1e-9) and kernels.rect_ious(a[:0], b[:0]).tolist() == []


def test_outlines_that_touch(spark):
    from fathomline.operators import berths

    rows = [(1, 0.0, 0.0, 4.0, 4.0, 0.0), (2, 4.0, 1.0, 4.0, 4.0, 0.0), (3, 0.0, 0.0, 2.0, 2.0, 0.0), (4, 30.0, 0.0, 2.0, 2.0, 0.0), (5, 0.0, 20.0, 4.0, 4.0, 0.0), (6, 0.0, 20.0, 4.0, 4.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, cx double, cy double, w double, l double, angle double")
    assert sorted((r.id, r.other) for r in berths.crossing_outlines(df).collect()) == [(1, 2), (5, 6)]


def test_smallest_rectangles_and_raster_candidates(spark):
    from fathomline.operators import berths

    rng = np.random.default_rng(11)
    for angle in (0.0, 30.0, 75.0, 90.0, 140.0):
        corners = kernels.rect_polygon(3.0, -2.0, 8.0, 15.0, angle)
        inside = kernels.rect_polygon(3.0, -2.0, 7.0, 12.0, angle)
        got = kernels.smallest_rect(np.concatenate([corners, inside, [(3.0, -2.0)]]))
        assert got[:4] == pytest.approx((3.0, -2.0, 8.0, 15.0)) and min((got[4] - angle) % 180, (angle - got[4]) % 180) < 1e-6
    assert kernels.smallest_rect(np.array([(0.0, 0.0), (0.0, 4.0)]))[2:4] == (0.0, 4.0)
    u, v = np.meshgrid(np.arange(41), np.arange(71))
    ring = [(int(a), int(b)) for a, b in zip(u.ravel(), v.ravel(), strict=True) if a in (0, 40) or b in (0, 70)]
    rows = [(1, a, b) for a, b in ring] + [(1, 100 + a, b) for a, b in ((0, 0), (1, 1), (2, 2))] + [(2, int(a), int(b)) for a, b in rng.integers(0, 500, (40, 2))]
    got = berths.raster_candidates(spark.createDataFrame(rows, "key long, u long, v long"), 0.2, -10.0, -10.0).collect()
    assert [(r.key, r.rank, round(r.w, 6), round(r.l, 6), round(r.cx, 6), round(r.cy, 6), r.cells) for r in got] == [(1, 0, 8.0, 14.0, -6.0, -3.0, len(ring))]


def test_edges_go_on_while_there_are_points(spark):
    from fathomline.operators import berths

    edges = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 3.0), (2, 50.0, 0.0, 50.0, 0.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    d, n = np.array([0.8, 0.6]), np.array([-0.6, 0.8])
    on = [(np.array([4.0, 3.0]) + d * t + n * s) for t in np.arange(0.2, 2.01, 0.2) for s in (-0.1, 0.1)] + [np.array([4.0, 3.0]) + d * 5]
    back = [-d * t for t in (0.2, 0.2, 0.6, 0.6)]
    points = spark.createDataFrame([tuple(map(float, p)) for p in on + back], "x double, y double")
    got = {r.id: (r.back, r.ahead) for r in berths.extended_edges(edges, points, along=0.05).collect()}
    assert got == {1: (1, 10), 2: (0, 0)}


def test_configuration():
    from fathomline.sources.config import SETTINGS, load_config

    plain = load_config()
    assert plain == load_config("nonsense") == load_config("[1]") and plain["slam.offline_tile_map.tile_size_m"] == 50.0 and len(plain) == len(SETTINGS)
    got = load_config('{"pcap_playback": {"default_speed": 9}, "slam": {"offline_tile_map": {"prefetch_ring_tiles": 5, "unload_ring_tiles": 1, "lod_voxel_sizes_m": [20, 0.3], "enabled": "yes"}, "water_filter": {"min_inliers": 20000}}, "maps_dir": 3}')
    assert got["pcap_playback.default_speed"] == 4.0 and got["slam.offline_tile_map.unload_ring_tiles"] == 5 and got["slam.offline_tile_map.lod_voxel_sizes_m"] == [10.0, 0.3]
    assert got["slam.offline_tile_map.enabled"] is True and got["maps_dir"] == "maps" and got["slam.water_filter.max_sample_points"] == 20000


def test_pose_filter_learns_the_turn():
    f = kernels.PoseFilter()
    noise = np.diag([0.05**2] * 3 + [0.01**2])
    for k in range(200):
        f.predict(0.1)
        yaw = (0.1 * k * 0.3 + math.pi) % (2 * math.pi) - math.pi
        assert f.update(np.array([0.1 * k, -0.05 * k, 0.0]), yaw, noise)
    assert f.x[6:8] == pytest.approx((1.0, -0.5), abs=0.1) and f.x[11] == pytest.approx(0.3, abs=0.05)
    assert f.x[3] == f.x[4] == 0 and np.allclose(f.p, f.p.T) and not f.update(np.array([500.0, 0, 0]), 0.0, noise)


def test_fragments_that_lack_one_are_left_out(spark):
    from fathomline.sources import datasources

    rows = [("a", 1, 0, False, b"xy"), ("a", 1, 2, True, b"z"), ("a", 1, 2, True, b"z"), ("a", 2, 0, False, b"xy"), ("a", 2, 3, True, b"z"), ("b", 1, 0, False, b"q"), ("b", 3, 0, True, b"w")]
    df = spark.createDataFrame([(s, i, o, last, bytearray(p)) for s, i, o, last, p in rows], "source string, ident long, offset long, last boolean, payload binary")
    assert sorted((r.source, r.ident, bytes(r.payload)) for r in datasources.reassembled(df).collect()) == [("a", 1, b"xyz"), ("b", 3, b"w")]


def test_moving_things_are_confirmed_and_removed(spark):
    from fathomline.operators import dynamics

    rng = np.random.default_rng(12)
    boat, wall = rng.uniform(0, 2, (40, 3)), rng.uniform(0, 3, (60, 3)) + (30, 0, 0)
    tracker, seen = dynamics.DynamicTracker(), []
    for k in range(10):
        seen.append(tracker.advance([(7, boat + (0.4 * k, 0, 0)), (8, wall + rng.normal(0, 0.01, wall.shape))], 0.2))
    assert {(c, t) for frame in seen for c, t, _, _ in frame} == {(7, 0), (8, 1)}
    assert [frame[0][3] for frame in seen].index(True) <= 6 and not any(frame[1][3] for frame in seen)
    assert tracker.tracks[0].velocity == pytest.approx((2.0, 0, 0), abs=0.4)
    assert tracker.advance([(7, boat + (4.0, 0, 0))], 0.2)[0][3]  # confirmed for good, and the wall may be missed
    for _ in range(7):
        tracker.advance([(9, boat + (100.0, 0, 0))], 0.2)
    assert set(tracker.tracks) == {2}
    rows = [(1, k, 0.2 * k, c, *map(float, p)) for k in range(10) for c, cloud in ((7, boat + (0.4 * k, 0, 0)), (8, wall)) for p in cloud]
    df = spark.createDataFrame(rows, "key long, frame long, ts double, cluster long, x double, y double, z double")
    left = {(r.frame, r.cluster) for r in dynamics.without_moving(df).select("frame", "cluster").distinct().collect()}
    assert {(k, 8) for k in range(10)} <= left and (9, 7) not in left and (0, 7) in left


def test_box_gaps():
    from fathomline.operators import dynamics

    a = np.array([(0.0, 0, 0), (1, 1, 1)])
    assert dynamics.box_gap(a, a + 0.5) == 0 and dynamics.box_gap(a, a + (4, 5, 0)) == 5.0
    assert dynamics.offset_between(np.zeros((7, 3)), np.zeros((7, 3))) is None


def test_world_lines_confirm_lock_and_wait():
    from fathomline.operators import folds

    a, b = (0.0, 0.0, 10.0, 0.0), (0.0, 5.0, 10.0, 5.0)
    world, held = folds.WorldLine(), []
    for line in [a, a, (float("nan"),) * 4, a, a, a]:
        world.observe(line)
        held.append(world.line)
    assert held == [None] * 5 + [a] and not world.locked  # a lost frame begins anew
    for line in (b, a, b, b, b):
        world.observe(line)
    assert world.line == b and not world.locked
    for _ in range(3):
        world.observe((0.0, 5.2, 10.0, 5.4))
    assert world.locked and world.line == b
    for _ in range(5):
        world.observe(a)
    assert world.line == b


def test_berths_lie_along_a_turned_line_on_its_side(spark):
    from fathomline.operators import berths

    c, s = math.cos(math.radians(30)), math.sin(math.radians(30))
    place = lambda u, v: (u * c - v * s, u * s + v * c)
    rows = [("a", 1, *place(10, 5.5), 8.0, 12.0, 27.0, 1, 0), ("a", 2, *place(30, -5.0), 8.0, 12.0, 33.0, 1, 2), ("a", 3, *place(50, 6.2), 8.0, 12.0, 30.0, 1, 7), ("a", 4, *place(70, 30), 8.0, 12.0, 30.0, 1, 0), ("a", 5, *place(90, 6), 8.0, 12.0, 30.0, 2, 0)]
    b = spark.createDataFrame(rows, "key string, id long, cx double, cy double, w double, l double, angle double, kind int, opening_edge int")
    lines = spark.createDataFrame([("a", 0.0, 0.0, 10 * c, 10 * s)], "key string, x1 double, y1 double, x2 double, y2 double")
    lines = berths.line_side(b, lines)
    assert lines.first().side == 1
    got = {r.id: r for r in berths.aligned_berths(b, lines).collect()}
    assert [got[k].aligned for k in range(1, 6)] == [True, True, True, False, False]
    for k, u in ((1, 10), (2, 30), (3, 50)):
        assert (got[k].cx, got[k].cy) == pytest.approx(place(u, 6.0)) and got[k].angle == pytest.approx(30.0)
    assert [got[k].opening_edge for k in range(1, 4)] == [0, 0, 0]
