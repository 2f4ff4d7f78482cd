"""Clusters from frame to frame: greedy one-to-one assignment and tracks that expire.

One ``Tracker`` serves the batch fold and the stream; its state is plain numbers.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathomline.functions.ship import shipped

#: Bounds of the gate and its share of a cluster's size, weight of a size difference, frames a track may miss.
GATE_LEAST, GATE_MOST, GATE_SHARE, SIZE_WEIGHT = 3.0, 15.0, 0.28, 2.0
MISSED, MISSED_LOCKED = 8, 30

TRACKS = "key string, frame long, id long, track long, fresh boolean"


class Tracker:
    """Tracks of one session: number -> x, y, size, locked, frames missed."""

    def __init__(self, tracks: dict | None = None, following: int = 0):
        self.tracks: dict[int, list] = {int(k): list(v) for k, v in (tracks or {}).items()}
        self.following = following

    def dumps(self) -> str:
        return json.dumps([self.tracks, self.following])

    @classmethod
    def loads(cls, text: str) -> Tracker:
        return cls(*json.loads(text))

    def advance(self, clusters: list[tuple]) -> list[tuple[int, int, bool]]:
        """clusters (id, x, y, size, locked) of a frame -> (id, track, whether the track is new).

        Larger clusters choose first; each takes the free track of least cost inside its gate.
        """
        free, out = set(self.tracks), []
        for cid, x, y, size, locked in sorted(clusters, key=lambda c: (-c[3], c[0])):
            gate = min(GATE_MOST, max(GATE_LEAST, GATE_SHARE * size))
            near = []
            for k in free:
                t = self.tracks[k]
                d = math.hypot(x - t[0], y - t[1])
                if d <= gate:
                    near.append((d + SIZE_WEIGHT * abs(size - t[2]), k))
            fresh = not near
            k = min(near)[1] if near else self.following
            if fresh:
                self.following += 1
            else:
                free.discard(k)
                locked = locked or self.tracks[k][3]
            self.tracks[k] = [x, y, size, bool(locked), 0]
            out.append((cid, k, fresh))
        for k in free:
            t = self.tracks[k]
            t[4] += 1
            if t[4] > (MISSED_LOCKED if t[3] else MISSED):
                del self.tracks[k]
        return out


def _frames(pdf: pd.DataFrame) -> Iterator[tuple[int, list[tuple]]]:
    for frame, g in pdf.sort_values(["frame", "id"]).groupby("frame", sort=True):
        yield int(frame), list(zip(g.id.tolist(), g.x.tolist(), g.y.tolist(), g["size"].tolist(), g.locked.tolist(), strict=True))


def _advance(tracker: Tracker, key: str, pdf: pd.DataFrame) -> list[tuple]:
    return [(key, frame, cid, track, fresh) for frame, clusters in _frames(pdf) for cid, track, fresh in tracker.advance(clusters)]


def track_clusters(clusters: DataFrame) -> DataFrame:
    """clusters (key, frame, id, x, y, size, locked) -> the track of each; frames without a cluster do not count."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_advance(Tracker(), pdf.key.iloc[0], pdf), columns=["key", "frame", "id", "track", "fresh"])

    return shipped(clusters).groupBy("key").applyInPandas(run, TRACKS)


def track_clusters_stream(clusters: DataFrame) -> DataFrame:
    """The same on a stream whose batches hold whole frames; the tracks are the state of a key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracker.loads(state.get[0]) if state.exists else Tracker()
        out = _advance(tracker, key[0], pd.concat(list(batches)))
        state.update((tracker.dumps(),))
        yield pd.DataFrame(out, columns=["key", "frame", "id", "track", "fresh"])

    return shipped(clusters).groupBy("key").applyInPandasWithState(step, TRACKS, "tracker string", "append", GroupStateTimeout.NoTimeout)
