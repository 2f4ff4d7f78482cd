"""Explicit schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


L, I, D, F, B, S, BIN, SH = T.LongType(), T.IntegerType(), T.DoubleType(), T.FloatType(), T.BooleanType(), T.StringType(), T.BinaryType(), T.ShortType()

POSE = _struct(tx=D, ty=D, tz=D, qx=D, qy=D, qz=D, qw=D)
POINTS = _struct(frame_id=L, point_index=I, x=F, y=F, z=F, intensity=SH)
FRAMES = _struct(sensor=S, ts=D, seq=L, generation=L)
PACKETS = _struct(path=S, seq=L, ts=D, src_ip=S, src_port=I, payload=BIN)
NAVIGATION = _struct(ts=D, lat=D, lon=D, alt=D, yaw=D, pitch=D, roll=D, nav_state=I, yaw_valid=B, pitch_valid=B, roll_valid=B)
ANCHORS = _struct(map_id=S, valid=B, ts=D, lat=D, lon=D, alt=D)
KEYFRAMES = _struct(map_id=S, keyframe_id=L, ts=D, pose=POSE, ref_valid=B, ref_ts=D, sync_error=D)
KEYFRAME_POINTS = _struct(map_id=S, keyframe_id=L, point_index=I, x=F, y=F, z=F, intensity=SH)
MAP_BERTHS = _struct(map_id=S, id=L, ts=D, x=D, y=D, z=D, width=D, length=D, angle_deg=D, kind=I, opening_edge=I, observation_count=L, confidence=D)
BERTH_OBSERVATIONS = _struct(
    session=S, frame_seq=L, ts=D, cx=D, cy=D, w=D, l=D, angle=D, kind=I, source=I, opening_edge=I,
    edge_point_counts=T.ArrayType(I), edge_heights=T.ArrayType(D), edge_height_counts=T.ArrayType(I), edge_height_valid=T.ArrayType(B),
)
TILE_CATALOGUE = _struct(lod=I, tile_x=L, tile_y=L, path=S, min_x=D, min_y=D, min_z=D, max_x=D, max_y=D, max_z=D, point_count=L, byte_size=L, sha256=S)
GRID_CHUNKS = _struct(cx=L, cy=L, cz=L, bits=BIN)
