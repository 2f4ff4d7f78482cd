"""Joins by nearest time and ordered windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: float, left_id: str, left_ts: str = "ts", right_ts: str = "ts", right_seq: str = "seq", by: tuple[str, ...] = (), prefix: str = "r_") -> DataFrame:
    """Left join with the nearest right row within ``tolerance``; ties to the lowest sequence.

    Time is cut into buckets of the tolerance: a left row looks into three of them, so the join is an
    equality join of bounded fan-out, not a comparison of everything with everything.
    """
    bucket = F.floor(F.col(left_ts) / tolerance).cast("long")
    l = left.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns]).withColumn("_b", F.floor(F.col(prefix + right_ts) / tolerance).cast("long"))
    on = [l["_b"] == r["_b"], *[l[k] == r[prefix + k] for k in by]]
    gap = F.abs(l[left_ts] - r[prefix + right_ts])
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    hits = l.join(r, cond).filter(gap <= tolerance)
    best = hits.groupBy(left_id).agg(F.min(F.struct(gap.alias("gap"), F.col(prefix + right_seq).alias("seq"), F.struct(*[F.col(c) for c in r.columns if c != "_b"]).alias("row")))["row"].alias("_row"))
    return left.join(best, left_id, "left").select(*left.columns, "_row.*")


def latest_before(left: DataFrame, right: DataFrame, most_age: float, left_id: str, left_ts: str = "ts", right_ts: str = "ts", by: tuple[str, ...] = (), prefix: str = "r_") -> DataFrame:
    """Left join with the latest right row at or before the left one, no older than ``most_age``."""
    bucket = F.floor(F.col(left_ts) / most_age).cast("long")
    l = left.withColumn("_b", F.explode(F.array(bucket - 1, bucket)))
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns]).withColumn("_b", F.floor(F.col(prefix + right_ts) / most_age).cast("long"))
    cond = l["_b"] == r["_b"]
    for k in by:
        cond = cond & (l[k] == r[prefix + k])
    age = l[left_ts] - r[prefix + right_ts]
    hits = l.join(r, cond).filter((age >= 0) & (age <= most_age))
    best = hits.groupBy(left_id).agg(F.max(F.struct(F.col(prefix + right_ts).alias("t"), F.struct(*[F.col(c) for c in r.columns if c != "_b"]).alias("row")))["row"].alias("_row"))
    return left.join(best, left_id, "left").select(*left.columns, "_row.*")


def bracket(left: DataFrame, right: DataFrame, group: list[str], value: list[str], left_id: str, ts: str = "ts") -> DataFrame:
    """Linear interpolation of ``value`` at the left times, clamped at both ends; nearest raw gap as well."""
    none = [F.lit(None).cast("double").alias(v) for v in value]
    asks = left.select(*group, F.col(ts), F.col(left_id).alias("_id"), *none, F.lit(1).alias("_ask"))
    has = right.select(*group, F.col(ts), F.lit(None).cast(left.schema[left_id].dataType).alias("_id"), *[F.col(v).cast("double").alias(v) for v in value], F.lit(0).alias("_ask"))
    both = asks.unionByName(has).withColumn("_s", F.when(F.col("_ask") == 0, F.struct(F.col(ts).alias("t"), *value)))
    back = Window.partitionBy(*group).orderBy(ts, "_ask").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*group).orderBy(F.col(ts).desc(), F.col("_ask")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_a", F.last("_s", ignorenulls=True).over(back)).withColumn("_z", F.last("_s", ignorenulls=True).over(ahead)).filter("_ask = 1")
    a, z = F.coalesce("_a", "_z"), F.coalesce("_z", "_a")
    u = F.when(z["t"] > a["t"], (F.col(ts) - a["t"]) / (z["t"] - a["t"])).otherwise(0.0)
    out = [(a[v] + (z[v] - a[v]) * u).alias(v) for v in value]
    return both.select(F.col("_id").alias(left_id), *group, ts, *out, F.least(F.abs(F.col(ts) - a["t"]), F.abs(F.col(ts) - z["t"])).alias("gap"))


def centred_median(df: DataFrame, group: list[str], order: str, value: str, half: int = 2, name: str = "median") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(-half, half)
    return df.withColumn(name, F.percentile(value, 0.5).over(w))


def neighbour_median(df: DataFrame, group: list[str], order: str, value: str, half: int = 2) -> DataFrame:
    """Median of the rows around, the row itself left out; null where there are fewer than two."""
    base = Window.partitionBy(*group).orderBy(order)
    around = F.concat(F.collect_list(value).over(base.rowsBetween(-half, -1)), F.collect_list(value).over(base.rowsBetween(1, half)))
    df = df.withColumn("_n", F.sort_array(around)).withColumn("neighbours", F.size("_n"))
    k = F.col("neighbours")
    middle = (F.element_at("_n", F.floor((k + 1) / 2).cast("int")) + F.element_at("_n", (F.floor(k / 2) + 1).cast("int"))) / 2
    return df.withColumn("neighbour_median", F.when(k >= 2, middle)).drop("_n")


def unwrap_degrees(df: DataFrame, group: list[str], order: str, angle: str, name: str = "unwrapped") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(order)
    turn = F.floor((F.lag(angle).over(w) - F.col(angle)) / 360.0 + 0.5)
    df = df.withColumn("_t", F.coalesce(turn, F.lit(0).cast("long")))
    return df.withColumn(name, F.col(angle) + 360.0 * F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_t")


def repaired_clock(df: DataFrame, group: list[str], seq: str, ts: str, least: float = 0.001, most: float = 0.25, nominal: float = 0.1) -> DataFrame:
    """Time since the first row, with each step outside (least, most) replaced by the nominal one."""
    w = Window.partitionBy(*group).orderBy(seq)
    step = F.col(ts) - F.lag(ts).over(w)
    step = F.when(step.isNull(), 0.0).when((step > least) & (step < most), step).otherwise(nominal)
    df = df.withColumn("_d", step)
    return df.withColumn("clock", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def playback_schedule(df: DataFrame, group: list[str], seq: str, ts: str, speed: float = 1.0) -> DataFrame:
    """Seconds after the start at which a row is due; time never runs back, speed is clamped to 0.5-4."""
    speed = min(max(speed, 0.5), 4.0)
    w = Window.partitionBy(*group).orderBy(seq)
    df = df.withColumn("_d", F.greatest(F.coalesce(F.col(ts) - F.lag(ts).over(w), F.lit(0.0)), F.lit(0.0)) / speed)
    return df.withColumn("due", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def islands(df: DataFrame, group: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number of runs so far; ``starts`` says where a new run begins and may use ``F.lag(...).over(w)``."""
    w = Window.partitionBy(*group).orderBy(*order)
    df = df.withColumn("_s", F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0))
    return df.withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def ema(values: Column, alpha: float) -> Column:
    """Exponential smoothing of an ordered array, started at its first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), lambda a, x: a + F.lit(alpha) * (x - a))


def seek_with_preroll(df: DataFrame, target: float, preroll: float, ts: str = "ts", eps: float = 1e-9) -> DataFrame:
    """Rows from target - preroll on; ``phase`` is warm before the target and play from it."""
    kept = df.filter(F.col(ts) + eps >= target - preroll)
    return kept.withColumn("phase", F.when(F.col(ts) + eps >= target, "play").otherwise("warm"))


def last_apart(pairs: DataFrame, own: str, other: str, when: str, dx: Column, dy: Column, least: float) -> DataFrame:
    """The last ``other`` by ``own`` whose dx² + dy² reaches ``least``.

    Squares are those of the C library's pow, as in the SQL; it and a product differ in the last place, so pairs at the
    limit are collected and decided by it.
    """
    product, edge = dx * dx + dy * dy, least * 1e-9

    @F.udf(f"struct<t:double,o:{pairs.schema[other].dataType.simpleString()}>")
    def decided(at_limit):
        return max(((p.t, p.o) for p in at_limit if math.pow(p.dx, 2.0) + math.pow(p.dy, 2.0) >= least), default=None)

    near = pairs.withColumns({"_dx": dx, "_dy": dy, "_d2": product}).filter(F.col("_d2") >= least - edge)
    sure = F.col("_d2") > least + edge
    found = near.groupBy(own).agg(
        F.max(F.when(sure, F.struct(F.col(when).alias("t"), F.col(other).alias("o")))).alias("_sure"),
        F.collect_list(F.when(~sure, F.struct(F.col(when).alias("t"), F.col(other).alias("o"), F.col("_dx").alias("dx"), F.col("_dy").alias("dy")))).alias("_edge"),
    )
    last = F.greatest("_sure", decided("_edge"))
    return found.withColumn("_last", last).filter(F.col("_last").isNotNull()).select(own, F.col("_last.o").alias(other))
