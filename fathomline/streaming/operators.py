"""Structured Streaming forms: windows, late data, keyed state and stream-stream pairing.

Event time is a double of seconds everywhere; ``event_time`` derives the timestamp that watermarks need.
A seek begins a new timeline: ``generation`` belongs to every key, so state of the old one is never met.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathomline.functions.ship import shipped
from fathomline.operators import folds, maps


def event_time(df: DataFrame, ts: str = "ts", delay: str = "1 second") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros((F.col(ts) * 1e6).cast("long"))).withWatermark("event_time", delay)


def packet_rates(packets: DataFrame, width: str = "5 seconds", delay: str = "1 second") -> DataFrame:
    """Packets by source and window."""
    return event_time(packets, delay=delay).groupBy(F.window("event_time", width), "source").agg(F.count("*").alias("packets"))


def latest_state(rows: DataFrame, key: str, value: str, ts: str = "ts") -> DataFrame:
    """The newest value by key (update mode)."""
    return rows.groupBy(key).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def drop_repeats(frames: DataFrame, digest: str, delay: str = "200 milliseconds") -> DataFrame:
    return event_time(frames, delay=delay).dropDuplicatesWithinWatermark([digest])


def occupied(points: DataFrame, voxel: float, **cols) -> DataFrame:
    """The union of occupancy bits so far (update mode): an OR only ever grows."""
    return maps.occupancy_bytes(points, voxel, **cols)


def paired_in_time(left: DataFrame, right: DataFrame, tolerance: float, delay: str = "1 second") -> DataFrame:
    """Inner stream-stream join of rows of one generation within ``tolerance`` seconds.

    The equality key is a time bucket, the state is bounded by the watermark on both sides.
    """
    l = event_time(left, delay=delay).withColumn("_b", F.explode(F.array(*[F.floor(F.col("ts") / tolerance).cast("long") + d for d in (-1, 0, 1)])))
    r = event_time(right, delay=delay).select(*[F.col(c).alias("r_" + c) for c in [*right.columns, "event_time"]]).withColumn("_b2", F.floor(F.col("r_ts") / tolerance).cast("long"))
    near = F.expr(f"r_event_time BETWEEN event_time - INTERVAL {int(tolerance * 1e6)} MICROSECONDS AND event_time + INTERVAL {int(tolerance * 1e6)} MICROSECONDS")
    return l.join(r, (F.col("_b") == F.col("_b2")) & (F.col("generation") == F.col("r_generation")) & near).drop("_b", "_b2")


def confirmations(rows: DataFrame, hits: int = 5) -> DataFrame:
    """rows (key, generation, seq): emits a key once, when it has been seen ``hits`` times in a generation."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for pdf in batches:
            for seq in pdf.seq.sort_values():
                seen += 1
                if seen == hits:
                    yield pd.DataFrame([{"key": key[0], "generation": key[1], "seq": seq, "hits": seen}])
        state.update((seen,))

    return shipped(rows).groupBy("key", "generation").applyInPandasWithState(step, "key string, generation long, seq long, hits long", "seen long", "append", GroupStateTimeout.NoTimeout)


def keyframes(poses: DataFrame, move: float = 0.5, turn_deg: float = 5.0) -> DataFrame:
    """poses (key, ts, x, y, z, yaw): keyframes as they come; the last one is the state."""
    schema = "key long, ts double, x double, y double, z double, yaw double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.sort_values("ts")
            if state.exists:
                before = pd.DataFrame([(key[0], *state.get)], columns=["key", "ts", "x", "y", "z", "yaw"])
                rows = pd.concat([before, rows[rows.ts > before.ts[0]]])
            found = list(folds.keyframe_step(move, turn_deg)(rows.itertuples(index=False), {}))
            new = found[1:] if state.exists else found
            if found:
                state.update(tuple(map(float, found[-1][1:])))
            if new:
                yield pd.DataFrame(new, columns=["key", "ts", "x", "y", "z", "yaw"])

    return shipped(poses).groupBy("key").applyInPandasWithState(step, schema, "ts double, x double, y double, z double, yaw double", "append", GroupStateTimeout.NoTimeout)


STORE_SCHEMA = "key string, id long, kind int, cx double, cy double, w double, l double, angle double, n long"


def berth_store(rows: DataFrame, **options) -> DataFrame:
    """rows (key, seq, id, kind, cx, cy, w, l, angle, n): a map's berths as observations come (update mode): the records that changed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        store = folds.BerthStore(json.loads(state.get[0]) if state.exists else None, **options)
        changed = {}
        for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples(index=False):
            if (met := store.observe(r)) is not None:
                changed[int(met["id"])] = met
        # plain numbers for the state
        state.update((json.dumps([[v.item() if hasattr(v, "item") else v for v in k] for k in store.records()]),))
        yield pd.DataFrame([(key[0], *(b[c] for c in store.NAMES)) for b in changed.values()], columns=["key", "id", "kind", "cx", "cy", "w", "l", "angle", "n"])

    return shipped(rows).groupBy("key").applyInPandasWithState(step, STORE_SCHEMA, "store string", "update", GroupStateTimeout.NoTimeout)


def newest_timeline(rows: DataFrame, delay: str = "1 second") -> DataFrame:
    """rows (source, generation, ts): a seek begins a timeline; what belongs to one older than the newest seen so far by its source is dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else -1
        for pdf in batches:
            top = pdf.generation.cummax().clip(lower=newest)
            newest = max(newest, int(pdf.generation.max()))
            yield pdf[pdf.generation >= top]
        state.update((newest,))

    return shipped(rows).groupBy("source").applyInPandasWithState(step, rows.schema, "newest long", "append", GroupStateTimeout.NoTimeout)


def ring(rows: DataFrame, keep: int = 64) -> DataFrame:
    """rows (source, seq): a bounded ring by source: of each batch a slow reader gets the newest ``keep``, with the number it has missed so far."""
    schema = T.StructType([*rows.schema.fields, T.StructField("missed", T.LongType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        missed, newest, seen = state.get[0] if state.exists else 0, None, 0
        for pdf in batches:
            seen += len(pdf)
            newest = (pdf if newest is None else pd.concat([newest, pdf])).nlargest(keep, "seq")
        missed += seen - len(newest)
        state.update((missed,))
        yield newest.sort_values("seq").assign(missed=missed)

    return shipped(rows).groupBy("source").applyInPandasWithState(step, schema, "missed long", "append", GroupStateTimeout.NoTimeout)
