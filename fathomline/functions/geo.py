"""Scalar geometry, geodesy, pose and wire-code functions as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 semi-major axis and flattening, and metres per degree of latitude.
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)
METRES_PER_DEGREE = 111320.0
#: Scale of coordinates and of azimuths on the wire.
GEO_SCALE = 2147483648.0 / 180.0
AZIMUTH_SCALE = 182.04


def floor_int(x: Column) -> Column:
    return F.floor(x).cast("long")


def floor_div(a: Column, b: int) -> Column:
    return floor_int(a / F.lit(float(b)))


def tile_index(c: Column, origin: float, size: float) -> Column:
    """Half-open tiles; 0 where the coordinate or the size is no number."""
    ok = ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(ok, floor_int((c - origin) / size)).otherwise(F.lit(0).cast("long")) if size > 0 else F.lit(0).cast("long")


def finite(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def meridian_radius(lat_deg: Column) -> Column:
    s = F.sin(F.radians(lat_deg))
    return WGS84_A * (1 - WGS84_E2) / F.pow(1 - WGS84_E2 * s * s, 1.5)


def prime_vertical_radius(lat_deg: Column) -> Column:
    s = F.sin(F.radians(lat_deg))
    return WGS84_A / F.sqrt(1 - WGS84_E2 * s * s)


def geodetic_to_ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    n, la, lo = prime_vertical_radius(lat), F.radians(lat), F.radians(lon)
    return (n + alt) * F.cos(la) * F.cos(lo), (n + alt) * F.cos(la) * F.sin(lo), (n * (1 - WGS84_E2) + alt) * F.sin(la)


def geodetic_to_enu(lat: Column, lon: Column, alt: Column, lat0: float, lon0: float, alt0: float) -> tuple[Column, Column, Column]:
    x, y, z = geodetic_to_ecef(lat, lon, alt)
    la, lo = math.radians(lat0), math.radians(lon0)
    n = WGS84_A / math.sqrt(1 - WGS84_E2 * math.sin(la) ** 2)
    dx = x - (n + alt0) * math.cos(la) * math.cos(lo)
    dy = y - (n + alt0) * math.cos(la) * math.sin(lo)
    dz = z - (n * (1 - WGS84_E2) + alt0) * math.sin(la)
    east = -math.sin(lo) * dx + math.cos(lo) * dy
    north = -math.sin(la) * math.cos(lo) * dx - math.sin(la) * math.sin(lo) * dy + math.cos(la) * dz
    up = math.cos(la) * math.cos(lo) * dx + math.cos(la) * math.sin(lo) * dy + math.sin(la) * dz
    return east, north, up


def enu_to_geodetic(e: Column, n: Column, u: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """Linearised about the origin; the altitude falls as u grows, as on the wire it does."""
    lat = lat0 + F.degrees(n / (meridian_radius(lat0) + alt0))
    lon = lon0 + F.degrees(e / ((prime_vertical_radius(lat0) + alt0) * F.cos(F.radians(lat0))))
    return lat, lon, alt0 - u


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dx = (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * METRES_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def rotate_yaw(x: Column, y: Column, yaw_deg: Column) -> tuple[Column, Column]:
    c, s = F.cos(F.radians(yaw_deg)), F.sin(F.radians(yaw_deg))
    return x * c - y * s, x * s + y * c


def quaternion_matrix(qx: Column, qy: Column, qz: Column, qw: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion of any positive norm."""
    n = qx * qx + qy * qy + qz * qz + qw * qw
    s = 2 / n
    return [
        [1 - s * (qy * qy + qz * qz), s * (qx * qy - qz * qw), s * (qx * qz + qy * qw)],
        [s * (qx * qy + qz * qw), 1 - s * (qx * qx + qz * qz), s * (qy * qz - qx * qw)],
        [s * (qx * qz - qy * qw), s * (qy * qz + qx * qw), 1 - s * (qx * qx + qy * qy)],
    ]


def apply_pose(x: Column, y: Column, z: Column, t: tuple[Column, Column, Column], q: tuple[Column, Column, Column, Column]) -> tuple[Column, Column, Column]:
    m = quaternion_matrix(*q)
    return tuple(m[i][0] * x + m[i][1] * y + m[i][2] * z + t[i] for i in range(3))


def inverse_apply_pose(x: Column, y: Column, z: Column, t: tuple[Column, Column, Column], q: tuple[Column, Column, Column, Column]) -> tuple[Column, Column, Column]:
    m = quaternion_matrix(*q)
    d = (x - t[0], y - t[1], z - t[2])
    return tuple(m[0][i] * d[0] + m[1][i] * d[1] + m[2][i] * d[2] for i in range(3))


def quaternion_angle(a: tuple, b: tuple) -> Column:
    dot = F.abs(sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0]))
    return 2 * F.acos(F.least(dot, F.lit(1.0)))


def slerp(a: tuple, b: tuple, u: Column) -> tuple:
    """Spherical interpolation along the shorter arc; linear where the quaternions almost agree."""
    dot = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    d = F.least(F.abs(dot), F.lit(1.0))
    theta = F.acos(d)
    near = d > 0.9995
    wa = F.when(near, 1 - u).otherwise(F.sin((1 - u) * theta) / F.sin(theta))
    wb = F.when(near, u).otherwise(F.sin(u * theta) / F.sin(theta)) * sign
    raw = [wa * x + wb * y for x, y in zip(a, b, strict=True)]
    n = F.sqrt(sum((r * r for r in raw[1:]), raw[0] * raw[0]))
    return tuple(r / n for r in raw)


def euler_matrix(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """Body (forward, right, down) to north-east-down, angles in degrees."""
    cr, sr, cp, sp, cy, sy = (f(F.radians(a)) for a in (roll, pitch, yaw) for f in (F.cos, F.sin))
    return [
        [cp * cy, sr * sp * cy - cr * sy, cr * sp * cy + sr * sy],
        [cp * sy, sr * sp * sy + cr * cy, cr * sp * sy - sr * cy],
        [-sp, sr * cp, cr * cp],
    ]


def angle_180(a: Column) -> Column:
    """[0, 180)."""
    return F.pmod(a, F.lit(180.0))


def angle_90(a: Column) -> Column:
    """[-90, 90): an undirected axis."""
    return F.pmod(a + 90, F.lit(180.0)) - 90


def wrap_pi(a: Column) -> Column:
    """(-pi, pi] up to rounding."""
    return a - 2 * math.pi * F.floor((a + math.pi) / (2 * math.pi))


def axis_difference(a: Column, b: Column) -> Column:
    """Smallest angle between undirected axes, in degrees."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180 - d)


def compass_to_yaw(deg: Column) -> Column:
    """Clockwise from north to counter-clockwise from east, degrees in [0, 360)."""
    return F.pmod(90 - deg, F.lit(360.0))


def rect_corners(cx: Column, cy: Column, w: Column, l: Column, angle: Column) -> Column:
    """Corners, counter-clockwise from (-w/2, -l/2) in the rectangle's own frame."""
    out = []
    for sx, sy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)):
        dx, dy = rotate_yaw(w * sx, l * sy, angle)
        out.append(F.struct((cx + dx).alias("x"), (cy + dy).alias("y")))
    return F.array(*out)


def in_rect(px: Column, py: Column, cx: Column, cy: Column, w: Column, l: Column, angle: Column, inset: float = 0.0) -> Column:
    u, v = rotate_yaw(px - cx, py - cy, -angle)
    return (F.abs(u) <= w / 2 - inset) & (F.abs(v) <= l / 2 - inset)


def opposite_edge(edge: Column) -> Column:
    return F.when(edge >= 0, (edge + 2) % 4).otherwise(edge)


def swap_axes(w: Column, l: Column, angle: Column, edge: Column) -> tuple[Column, Column, Column, Column]:
    """The same rectangle with its sides named the other way round."""
    return l, w, angle_180(angle + 90), F.when(edge >= 0, (edge + 3) % 4).otherwise(edge)


def sparsest_edge(counts: Column) -> Column:
    """First edge of the fewest points, from 0."""
    return (F.array_position(counts, F.array_min(counts)) - 1).cast("int")


def cv_rect_angle(w: Column, h: Column, angle: Column) -> Column:
    """Angle of the width axis from a minimum-area rectangle of (w, h, angle)."""
    return angle_180(F.when(w < h, angle + 90).otherwise(angle))


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def half_away(x: Column) -> Column:
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def clamped(x: Column, lo: int, hi: int) -> Column:
    return F.least(F.greatest(x, F.lit(lo).cast("long")), F.lit(hi).cast("long"))


def encode_geo(deg: Column) -> Column:
    return clamped(half_away(deg * GEO_SCALE), -(2**31), 2**31 - 1)


def encode_tenths(x: Column, signed: bool = True) -> Column:
    return clamped(half_away(x * 10), -(2**15) if signed else 0, 2**15 - 1 if signed else 2**16 - 1)


def encode_azimuth(deg: Column) -> Column:
    return clamped(half_away(F.pmod(deg, F.lit(360.0)) * AZIMUTH_SCALE), 0, 2**16 - 1)


def pixel_bearing(px: Column, cx: float, fx: float) -> Column:
    return F.degrees(F.atan((px - cx) / fx))


def world_to_bev(x: Column, y: Column, min_x: float, max_y: float, cell: float) -> tuple[Column, Column]:
    return floor_int((x - min_x) / cell), floor_int((F.lit(max_y) - y) / cell)


def bev_to_world(u: Column, v: Column, min_x: float, max_y: float, cell: float) -> tuple[Column, Column]:
    return min_x + (u + 0.5) * cell, max_y - (v + 0.5) * cell


def target_voxel(half_height_m: Column, pixels: int) -> Column:
    """Voxel worth showing: two pixels, 2 cm at least."""
    return F.greatest(F.lit(0.02), 2 * (2 * half_height_m / pixels))


def tile_path(lod: Column, tx: Column, ty: Column) -> Column:
    return F.format_string("L%d/tile_%d_%d.tilebin", lod, tx, ty)


def normal_ip(ip: Column) -> Column:
    """An IPv4-mapped IPv6 address as IPv4."""
    return F.regexp_replace(F.lower(F.trim(ip)), "^::ffff:", "")


def pan_orthographic(x: Column, y: Column, dx: Column, dy: Column, vertical: float, aspect: float, width: int, height: int) -> tuple[Column, Column]:
    """The view's centre after a drag by pixels; unchanged where a size is not positive."""
    if vertical <= 0 or aspect <= 0 or width <= 0 or height <= 0:
        return x, y
    return x - dx * (2 * vertical * aspect / width), y + dy * (2 * vertical / height)


def pan_perspective(x: Column, y: Column, dx: Column, dy: Column, distance: Column, height: int, field_deg: float = 45.0) -> tuple[Column, Column]:
    """The view's offset after a drag by pixels, at a camera distance of one metre or more."""
    if height <= 0:
        return x, y
    unit = F.greatest(F.lit(1.0), F.abs(distance)) * (2 * math.tan(math.radians(field_deg) / 2) / height)
    return x + dx * unit, y - dy * unit
