"""The application's configuration: JSON with defaults and bounds."""

from __future__ import annotations

import json
from dataclasses import dataclass


@dataclass(frozen=True)
class Setting:
    """A value by its path; numbers are held between ``least`` and ``most``."""

    path: str
    default: bool | int | float | str | list
    least: float | None = None
    most: float | None = None

    def of(self, found):
        if isinstance(self.default, list):
            ok = isinstance(found, list) and found and all(isinstance(x, int | float) and not isinstance(x, bool) for x in found)
            return [min(max(float(x), self.least), self.most) for x in (found if ok else self.default)]
        number = isinstance(self.default, int | float) and not isinstance(self.default, bool)
        if number:
            if isinstance(found, bool) or not isinstance(found, int | float) or isinstance(self.default, int) and found != int(found):
                found = self.default
            kind = type(self.default)
            return kind(found) if self.least is None else kind(min(max(found, self.least), self.most))
        return found if isinstance(found, type(self.default)) else self.default


#: Paths, defaults and bounds of the settings.
SETTINGS = (
    Setting("maps_dir", "maps"),
    Setting("devices_file", "devices.json"),
    Setting("calibration_file", "calibration.json"),
    Setting("pcap_playback.default_speed", 1.0, 0.5, 4.0),
    Setting("compute_node_scheduler.stable_berth_timestamps_to_stop_bridge", 10, 1, 10_000),
    Setting("compute_node_scheduler.missing_berth_timestamps_to_start_bridge", 10, 1, 10_000),
    Setting("slam.voxel_leaf_size", 0.5),
    Setting("slam.max_gnss_sync_sec", 0.25),
    Setting("slam.offline_tile_map.enabled", True),
    Setting("slam.offline_tile_map.tile_size_m", 50.0, 10.0, 500.0),
    Setting("slam.offline_tile_map.lod_voxel_sizes_m", [1.0, 0.3, 0.1], 0.02, 10.0),
    Setting("slam.offline_tile_map.prefetch_ring_tiles", 1, 0, 8),
    Setting("slam.offline_tile_map.unload_ring_tiles", 2, 0, 16),
    Setting("slam.offline_tile_map.ram_budget_mb", 512, 64, 8192),
    Setting("slam.offline_tile_map.gpu_point_budget", 1_500_000, 100_000, 20_000_000),
    Setting("slam.offline_tile_map.view_update_delay_ms", 120, 0, 2000),
    Setting("slam.offline_tile_map.max_concurrent_loads", 2, 1, 8),
    Setting("slam.water_filter.enabled", True),
    Setting("slam.water_filter.clearance_m", -0.15, -5.0, 5.0),
    Setting("slam.water_filter.plane_distance_m", 0.15, 0.01, 1.0),
    Setting("slam.water_filter.max_tilt_deg", 20.0, 1.0, 45.0),
    Setting("slam.water_filter.min_inliers", 80, 3, 100_000),
    Setting("slam.water_filter.max_sample_points", 12_000, 3, 100_000),
    Setting("slam.water_filter.ransac_iterations", 160, 10, 2000),
    Setting("slam.water_filter.near_surface_band_m", 1.0, 0.0, 5.0),
    Setting("slam.water_filter.outlier_radius_m", 0.6, 0.05, 5.0),
    Setting("slam.water_filter.outlier_min_neighbors", 0, 0, 100),
    Setting("slam.water_filter.max_fallback_frames", 15, 0, 1000),
)


def load_config(text: str = "{}") -> dict:
    """Settings by path; what is missing, of a wrong kind or no JSON object has its default.

    The unload ring is no smaller than the prefetch ring, and the plane's sample no smaller than its inliers.
    """
    try:
        root = json.loads(text)
    except ValueError:
        root = {}
    out = {}
    for s in SETTINGS:
        at = root
        for part in s.path.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        out[s.path] = s.of(at)
    for larger, smaller in (("offline_tile_map.unload_ring_tiles", "offline_tile_map.prefetch_ring_tiles"), ("water_filter.max_sample_points", "water_filter.min_inliers")):
        out[f"slam.{larger}"] = max(out[f"slam.{larger}"], out[f"slam.{smaller}"])
    return out
