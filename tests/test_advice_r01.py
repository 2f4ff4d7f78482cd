"""Queries without SQL run over their whole tables."""

from fathomline.plans import registry
from fathomline.plans.views import view


def test_water_plane_judges_every_keyframe(spark):
    d = "/root/testdata/sf0.001"
    points = {r["kf"]: r["count"] for r in view(spark, d, "pts").groupBy("kf").count().collect()}
    kept = {r["frame"]: r["kept"] for r in registry.QUERIES["agg13b_water_plane"](spark, d).collect()}
    assert max(points) >= 20 and any(f >= 20 for f in kept)
    assert all(0 < n <= points[f] for f, n in kept.items())
