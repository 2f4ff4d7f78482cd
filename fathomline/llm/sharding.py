"""Sharding by balanced label propagation.

Documents with a common hub (here: equal texts) are linked.  All rows start in a shard of their own
hash; in every round a linked row asks for the shard that holds most of its group, and the requests
are granted up to the quotas that keep the linked rows of every shard below its capacity.  A shard that
is full takes no more requests: its groups ask for the open shard that holds most of them, or for one
drawn by the group.  Rows without a link make room wherever a group moves, so capacity is all of a
shard's size.  A group larger than a quarter of a shard is split beforehand into parts of that size,
which then move on their own, so no shard ever has to hold an unbounded group; parts are salted, so no
task has to either.  Pairs are never formed: the links of a group are the counts of its rows by shard,
at most ``shards`` numbers.

What is collected to the driver: counts by (from, to, hash bucket), at most shards^2 * BUCKETS numbers.
At last, rows that have no link move from too full to too empty shards, so that the counts of any two
shards differ by one at most (law ``rows``).

Defined cases: null texts are linked with each other and take 8 bytes; repeated rows are rows of
their own; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARDS = 24
BUCKETS = 256
#: Room above an even share of the linked rows, in which groups move; at last it is evened out.
SLACK = 0.25
#: Rows of a part under one salt.
SALT_ROWS = 50_000


def _granted(flow: np.ndarray, load: np.ndarray, capacity: float) -> np.ndarray:
    """For each wanted shard the number of hash buckets granted; flow[from, to, bucket] are rows.

    Cuts only ever fall: a shard above capacity admits a bucket less until all fit.
    """
    shards = len(load)
    cut = np.full(shards, BUCKETS)
    upto = np.concatenate([np.zeros((shards, shards, 1)), flow.cumsum(axis=2)], axis=2)
    while True:
        moved = np.stack([upto[:, j, cut[j]] for j in range(shards)], axis=1)
        after = load + moved.sum(axis=0) - moved.sum(axis=1)
        over = (after > capacity) & (cut > 0)
        if not over.any():
            return cut
        cut[over] -= 1


def _lookup(values: list[int], key: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), key.cast("int"))


def propagate(nodes: DataFrame, total: int, shards: int = SHARDS, rounds: int = 12) -> DataFrame:
    """nodes (rid, hub) -> (rid, hub, linked, shard); the shards of rows with one hub drawn together."""
    part = max(1, -(-total // (4 * shards)))
    start = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")
    groups = stored(nodes.groupBy("hub").agg(F.count("*").alias("m")).filter("m > 1"), "shard-groups")
    # at most 4 * shards groups have more than total / (4 * shards) rows, and total / SALT_ROWS more than one salt: bounded broadcasts
    salts = F.ceil(F.least(F.col("m"), F.lit(part)) / SALT_ROWS)
    heavy = F.broadcast(groups.filter((F.col("m") > part) | (F.col("m") > SALT_ROWS)).select("hub", F.ceil(F.col("m") / part).alias("parts"), salts.alias("salts")))
    df = nodes.join(heavy, "hub", "left")
    light = df.filter("parts is null").drop("parts", "salts")
    small = groups.filter((F.col("m") <= part) & (F.col("m") <= SALT_ROWS)).select("hub", F.lit(0).cast("long").alias("chunk"), F.lit(1).cast("long").alias("salts"))
    large = df.filter("parts is not null").withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(7)), F.col("parts")))
    df = light.join(small, "hub", "left").select("rid", "hub", "chunk", "salts").unionByName(large.select("rid", "hub", "chunk", "salts"))
    df = stored(df.withColumn("salt", F.pmod(F.xxhash64("rid", F.lit(13)), F.col("salts"))).withColumn("shard", start), "shard-start")
    single = df.filter("chunk is null").withColumn("linked", F.lit(False))
    linked = df.filter("chunk is not null")
    # rows without a link make room; where there are too few of them, groups need some slack to move at all
    capacity = max(total // shards, math.ceil((1 + SLACK) * linked.count() / shards))
    closed = [False] * shards
    for k in range(rounds):
        cells = linked.groupBy("hub", "chunk", "shard").agg(F.count("*").alias("n"), F.max("salts").alias("salts"))
        # most rows first; ties go to a shard drawn by the group
        draw = F.pmod(F.xxhash64("hub", "chunk", "shard"), F.lit(1 << 20))
        free = F.lit(True) if not any(closed) else ~F.get(F.array(*[F.lit(c) for c in closed]), F.col("shard"))
        want = cells.groupBy("hub", "chunk").agg(F.max(F.when(free, F.struct("n", draw.alias("draw"), "shard")))["shard"].alias("want"), F.max("shard").alias("most"), F.min("shard").alias("least"), F.first("shard").alias("stay"), F.max("salts").alias("salts"))
        elsewhere = [j for j in range(shards) if not closed[j]]
        if elsewhere:
            drawn = F.get(F.array(*[F.lit(j) for j in elsewhere]), F.pmod(F.xxhash64("hub", "chunk", F.lit(-k)), F.lit(len(elsewhere))).cast("int"))
        else:
            drawn = F.col("stay")
        # a group that is whole stays where it is
        want = want.select("hub", "chunk", F.when(F.col("most") == F.col("least"), F.col("most")).otherwise(F.coalesce("want", drawn)).alias("want"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        asked = linked.join(want, ["hub", "chunk", "salt"]).withColumn("bucket", F.pmod(F.xxhash64("hub", "chunk", F.lit(k)), F.lit(BUCKETS)).cast("int"))
        asked = stored(asked, "shard-asked")
        flow, load = np.zeros((shards, shards, BUCKETS)), np.zeros(shards)
        for r in asked.groupBy("shard", "want", "bucket").count().collect():
            load[r["shard"]] += r["count"]
            if r["shard"] != r["want"]:
                flow[r["shard"], r["want"], r["bucket"]] += r["count"]
        if not flow.any():
            break
        cut = _granted(flow, load, capacity)
        closed = [bool(c < BUCKETS) for c in cut]
        granted = F.col("bucket") < _lookup(list(cut), F.col("want"))
        linked = asked.select("rid", "hub", "chunk", "salts", "salt", F.when(granted, F.col("want")).otherwise(F.col("shard")).alias("shard"))
    return linked.select("rid", "hub", F.lit(True).alias("linked"), "shard").unionByName(single.select("rid", "hub", "linked", "shard"))


def even_out(placed: DataFrame, total: int, shards: int = SHARDS, rows_a_part: int = 20_000) -> DataFrame:
    """placed (rid, linked, shard) -> with shard and slot: gapless in each shard, counts at most one apart."""
    parts = max(1, -(-total // (shards * rows_a_part)))
    # rows with links take the low slots, so that those that may move stand last
    df = placed.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(11)), F.lit(parts)) + F.when(F.col("linked"), 0).otherwise(parts))
    df = stored(df, "shard-placed")
    counts = df.groupBy("shard", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    df = df.withColumn("k", F.row_number().over(Window.partitionBy("shard", "part").orderBy("rid")) - 1)
    df = df.join(first, ["shard", "part"]).withColumn("slot", F.col("first") + F.col("k"))
    have = [0] * shards
    for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        have[r["shard"]] = r["n"]
    goal = [total // shards] * shards
    for j in sorted(range(shards), key=lambda j: (-have[j], j))[: total % shards]:
        goal[j] += 1
    surplus = np.concatenate([[0], np.cumsum([max(0, h - g) for h, g in zip(have, goal, strict=True)])])
    missing = np.concatenate([[0], np.cumsum([max(0, g - h) for h, g in zip(have, goal, strict=True)])])
    rank = _lookup(list(surplus[:-1]), F.col("shard")) + F.col("slot") - _lookup(goal, F.col("shard"))
    df = df.withColumn("rank", F.when(F.col("slot") >= _lookup(goal, F.col("shard")), rank))
    to = F.lit(-1)
    for j in range(shards):
        to = to + F.when(F.col("rank") >= int(missing[j]), 1).otherwise(0)
    # shards that miss nothing have empty ranges: the last one that begins at or before the rank is the right one
    df = df.withColumn("to", F.when(F.col("rank").isNotNull(), to))
    slot = F.when(F.col("to").isNotNull(), _lookup(have, F.col("to")) + F.col("rank") - _lookup(list(missing[:-1]), F.col("to"))).otherwise(F.col("slot"))
    return df.withColumn("slot", slot).withColumn("shard", F.coalesce("to", "shard")).select("rid", "shard", F.col("slot").cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, linked, shard, slot of each row; linked: another row has its text."""
    base = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(F.encode(F.col(text), "UTF-8"))), F.unhex(F.lit("00"))).alias("hub"),
    )
    base = stored(base.withColumn("rid", F.monotonically_increasing_id()), "shard-base")
    total = base.count()
    placed = propagate(base.select("rid", "hub"), total, shards)
    final = even_out(placed.select("rid", "linked", "shard"), total, shards)
    return base.join(final, "rid").select("doc_id", "size", "text_crc32", "shard", "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shard_documents(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
