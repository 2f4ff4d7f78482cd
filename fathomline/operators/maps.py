"""Voxels, tiles, levels of detail, occupancy and map assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from fathomline.functions import geo
from fathomline.operators import spatial

#: Voxel size of each level of detail, and the edge of a tile, in metres.
LODS = ((0, 1.0), (1, 0.3), (2, 0.1))
TILE = 50.0
#: Voxels of an occupancy chunk along x, y and z.
CHUNK = (32, 32, 10)


def _chosen(points: DataFrame, size: Column, keys: list[str], order: list[str], dims: tuple[str, ...], first: bool) -> DataFrame:
    """One row a voxel by order, as a partial aggregation: tasks send one row a voxel, not all points.

    Two integers of 31 and 32 bits are compared as one, so that the buffers have a fixed width and the
    aggregation is by hash; any other order is compared as a struct.
    """
    df = points.withColumns({f"_v{k}": F.floor(F.col(d) / size).cast("long") for k, d in enumerate(dims)})
    rest = [c for c in points.columns if c not in keys]
    voxel = [*keys, *[f"_v{k}" for k in range(len(dims))]]
    pick = F.min_by if first else F.max_by
    if len(order) == 2 and all(isinstance(points.schema[o].dataType, IntegralType) for o in order):
        rank = F.shiftleft(F.col(order[0]).cast("long"), 32).bitwiseOR(F.col(order[1]).cast("long"))
        found = df.withColumn("_rank", rank).groupBy(*voxel).agg(*[pick(c, "_rank").alias(c) for c in rest])
        return found.select(*keys, *rest)
    found = df.groupBy(*voxel).agg(pick(F.struct(*rest), F.struct(*[F.col(o) for o in order])).alias("_r"))
    return found.select(*keys, "_r.*")


def first_per_voxel(points: DataFrame, voxel: float | Column, keys: list[str], order: list[str], dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The first point of each voxel in the given order."""
    return _chosen(points, voxel if isinstance(voxel, Column) else F.lit(float(voxel)), keys, order, dims, True)


def last_per_voxel(points: DataFrame, voxel: float, keys: list[str], order: list[str], dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    return _chosen(points, F.lit(float(voxel)), keys, order, dims, False)


def voxel_centroids(points: DataFrame, voxel: float, keys: list[str], dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    df = points.withColumns({f"v{d}": F.floor(F.col(d) / F.lit(float(voxel))).cast("long") for d in dims})
    return df.groupBy(*keys, *[f"v{d}" for d in dims]).agg(*[F.avg(d).alias(d) for d in dims], F.count("*").alias("n"))


def distinct_voxels(points: DataFrame, voxel: float, keys: list[str], exact: bool = True) -> DataFrame:
    v = F.struct(*[F.floor(F.col(d) / F.lit(float(voxel))).cast("long").alias(d) for d in ("x", "y", "z")])
    return points.groupBy(*keys).agg((F.count_distinct(v) if exact else F.approx_count_distinct(F.xxhash64(v), 0.01)).alias("voxels"))


def tiled(points: DataFrame, x: str, y: str, origin: tuple[float, float] = (0.0, 0.0), tile: float = TILE) -> DataFrame:
    return points.withColumn("tile_x", geo.tile_index(F.col(x), origin[0], tile)).withColumn("tile_y", geo.tile_index(F.col(y), origin[1], tile))


def build_tiles(points: DataFrame, lods=LODS, tile: float = TILE, order: tuple[str, ...] = ("kf", "idx")) -> DataFrame:
    """World points (wx, wy, wz, ...) -> the points of every tile at every level of detail."""
    levels = F.array(*[F.struct(F.lit(k).alias("lod"), F.lit(v).alias("voxel")) for k, v in lods])
    df = points.filter(geo.finite(F.col("wx"), F.col("wy"), F.col("wz")))
    df = tiled(df, "wx", "wy", tile=tile).withColumn("_l", F.explode(levels)).select("*", "_l.lod", "_l.voxel").drop("_l")
    # keys inside a tile: coordinates less the tile's corner
    df = df.withColumn("_x", F.col("wx") - F.col("tile_x") * tile).withColumn("_y", F.col("wy") - F.col("tile_y") * tile)
    return first_per_voxel(df, F.col("voxel"), ["lod", "tile_x", "tile_y"], list(order), ("_x", "_y", "wz")).drop("_x", "_y", "voxel")


def tile_catalogue(tiles: DataFrame) -> DataFrame:
    bounds = [f(c).alias(f"{n}_{c[-1]}") for c in ("wx", "wy", "wz") for n, f in (("min", F.min), ("max", F.max))]
    return tiles.groupBy("lod", "tile_x", "tile_y").agg(F.count("*").alias("point_count"), *bounds).withColumn("byte_size", F.col("point_count") * 13).withColumn("path", geo.tile_path(F.col("lod"), F.col("tile_x"), F.col("tile_y")))


def cell_statistics(points: DataFrame, size: float, keyframe: str = "kf", x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    df = points.withColumn("cx", F.floor(F.col(x) / size).cast("long")).withColumn("cy", F.floor(F.col(y) / size).cast("long"))
    return df.groupBy("cx", "cy").agg(
        F.count("*").alias("n"), F.count_distinct(keyframe).alias("keyframes"), F.sum(x).alias("sum_x"), F.sum(y).alias("sum_y"), F.min(z).alias("min_z"), F.max(z).alias("max_z"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y")
    )


def stable_regions(points: DataFrame, size: float, least_keyframes: int = 2, least_cells: int = 5, keyframe: str = "kf") -> DataFrame:
    """8-connected regions of cells that several keyframes saw: area, counts and weighted centre."""
    cells = cell_statistics(points, size, keyframe).filter(F.col("keyframes") >= least_keyframes)
    cells = cells.withColumn("node", F.col("cx") * (1 << 31) + F.col("cy"))
    near = cells.select("node", "cx", "cy", F.explode(spatial.near_cells([F.col("cx"), F.col("cy")])).alias("m"))
    pairs = near.join(cells.select(F.col("cx").alias("x2"), F.col("cy").alias("y2"), F.col("node").alias("b")), (F.col("m.c0") == F.col("x2")) & (F.col("m.c1") == F.col("y2")))
    labels = spatial.connected_components(cells.select("node"), pairs.select(F.col("node").alias("a"), "b"))
    joined = cells.join(labels, "node")
    regions = joined.groupBy("component").agg(
        F.count("*").alias("cells"), F.sum("n").alias("points"), (F.count("*") * size * size).alias("area"), (F.sum("sum_x") / F.sum("n")).alias("centre_x"), (F.sum("sum_y") / F.sum("n")).alias("centre_y"),
        F.min("keyframes").alias("min_seen"), F.max("keyframes").alias("max_seen"), F.avg("keyframes").alias("avg_seen"),
    )
    return regions.filter(F.col("cells") >= least_cells)


def occupied_voxels(points: DataFrame, voxel: float, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """chunk key, bit index, byte and bit of each occupied voxel; keys outside 16 bits are left out."""
    v = [F.floor(F.col(c) / voxel).cast("long") for c in (x, y, z)]
    c = [F.floor(a / F.lit(float(n))).cast("long") for a, n in zip(v, CHUNK, strict=True)]
    low = [a - b * n for a, b, n in zip(v, c, CHUNK, strict=True)]
    df = points.select(*[k.alias(n) for k, n in zip(c, ("cx", "cy", "cz"), strict=True)], (low[0] + 32 * low[1] + 1024 * low[2]).alias("bit"))
    keep = F.lit(True)
    for n in ("cx", "cy", "cz"):
        keep = keep & F.col(n).between(-32768, 32767)
    return df.filter(keep).withColumn("byte", F.floor(F.col("bit") / 8).cast("int")).withColumn("mask", F.expr("shiftleft(1, CAST(bit % 8 AS INT))"))


def occupancy_bytes(points: DataFrame, voxel: float, **cols) -> DataFrame:
    return occupied_voxels(points, voxel, **cols).groupBy("cx", "cy", "cz", "byte").agg(F.expr("bit_or(mask)").alias("bits"))


def occupancy_chunks(points: DataFrame, voxel: float, **cols) -> DataFrame:
    """cx, cy, cz, bits: 1280 bytes a chunk.  A chunk has 1280 byte rows at most, so the array is bounded."""
    per = occupancy_bytes(points, voxel, **cols).groupBy("cx", "cy", "cz").agg(F.map_from_entries(F.collect_list(F.struct("byte", "bits"))).alias("m"))
    hexed = F.transform(F.sequence(F.lit(0), F.lit(1279)), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("long")), 2, "0"))
    return per.select("cx", "cy", "cz", F.unhex(F.array_join(hexed, "")).alias("bits"))


def viewport_tiles(boxes: DataFrame, tile: float = TILE, ring: int = 0) -> DataFrame:
    """boxes (min_x, min_y, max_x, max_y) -> distinct tiles under them and ``ring`` around."""
    axis = lambda a, b: F.sequence(F.floor(a / tile).cast("long") - ring, F.floor(b / tile).cast("long") + ring)
    df = boxes.withColumn("tile_x", F.explode(axis(F.col("min_x"), F.col("max_x"))))
    return df.withColumn("tile_y", F.explode(axis(F.col("min_y"), F.col("max_y")))).select("tile_x", "tile_y").distinct()


def append_maps(maps: DataFrame, map_order: list[str], order: list[str]) -> DataFrame:
    """Keyframes of all maps with new ids 0..n-1 in order of the maps; windows stay inside a map."""
    sizes = maps.groupBy(*map_order).agg(F.count("*").alias("_n"))
    before = Window.orderBy(*map_order).rowsBetween(Window.unboundedPreceding, -1)  # one row a map
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*map_order).orderBy(*order)) - 1
    return maps.join(sizes, map_order).withColumn("new_id", F.col("_before") + inside).drop("_n", "_before")


def choose_lod(requests: DataFrame, half_height: str, pixels: int, lods=LODS) -> DataFrame:
    """The coarsest level whose voxel is no larger than two pixels, else the finest."""
    target = geo.target_voxel(F.col(half_height), pixels)
    fine = min(lods, key=lambda x: x[1])[0]
    out = F.lit(fine)
    for k, v in sorted(lods, key=lambda x: x[1]):
        out = F.when(target >= v, F.lit(k)).otherwise(out)
    return requests.withColumn("lod", out)
