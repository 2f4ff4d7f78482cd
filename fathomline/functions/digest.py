"""Digests of geometry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fathomline.functions.ship import shipped

#: Start and prime of the 64-bit FNV-1a hash.
FNV_START, FNV_PRIME = np.uint64(1469598103934665603), np.uint64(1099511628211)


def fnv1a(rows: np.ndarray, start: np.uint64 = FNV_START) -> np.ndarray:
    """FNV-1a of each row of bytes (n, width), with the start that the wire format uses."""
    out = np.full(len(rows), start, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            out = (out ^ rows[:, k].astype(np.uint64)) * FNV_PRIME
    return out


def geometry_digest(berths: DataFrame) -> DataFrame:
    """berths (id, ts, cx, cy, w, l, angle, opening_edge, kind) -> id, digest of a result with this one berth, as a signed number."""
    record = np.dtype([("ts", "<f8"), ("count", "<u8"), *[(c, "<f8") for c in ("cx", "cy", "w", "l", "angle")], ("opening_edge", "<i4"), ("kind", "<i4")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = np.zeros(len(p), record)
            for c in record.names:
                rows[c] = 1 if c == "count" else p[c].to_numpy()
            yield pd.DataFrame({"id": p.id, "digest": fnv1a(rows.view(np.uint8).reshape(len(p), record.itemsize)).view(np.int64)})

    return shipped(berths).mapInPandas(run, "id long, digest long")
