"""Quotation linking: conversations in reply order, without quotes, in DataFrame operations only.

A line's quote level is its number of leading ``>`` (single spaces between them allowed).  A *passage* is
a run of lines of one level without a blank line; lines are normalised (lower case, letters and digits,
single spaces) and a passage is its normalised lines joined by spaces.  Passages of level 1 or more are
hashed and joined to the own passages (level 0) of messages; a passage that nobody has as a whole is
joined line by line.

A found passage, or line, votes with its length for the nearest earlier message of its conversation that
has it; the message with most votes of the lowest level that has any is the parent, ties go to the
nearest.  So a line that many share ("Hi,") does not outweigh the one that tells.  Where the conversation
has none, whole passages that exactly one other conversation has vote for their first message there; where
nothing is known, the message before is the parent.  A parent inside the conversation always stands
before its reply, so the order by ``position`` is a reply order, and the depth is well defined.

Rows, not arrays, are the result, so a conversation of any length is no row's or task's burden: rows
are placed by one range partitioning on (conversation, turn), numbered inside partitions, and the
numbers of partitions are added up.  The nearest earlier origin, and the start of a run of replies, are
carried forward through blocks of ``BLOCK`` positions, so that no window holds a whole conversation.

Defined cases: a null text is empty; null conv_id is one conversation and a null turn comes first;
repeated rows and equal turns keep a place each, ordered by role and text; a quote of what only stands
later is unknown; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

PREFIX = r"^[ \t]?(?:>[ \t]?)+"
BLOCK = 4096


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 0), "[^>]", ""))


def bare(line: Column) -> Column:
    return F.regexp_replace(line, PREFIX, "")


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def placed(messages: DataFrame) -> DataFrame:
    """Adds ``position`` from 0 inside each conversation (``_conv`` is the null-safe name)."""
    df = messages.withColumn("_conv", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")))
    order = [F.col("_conv"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    parts = max(8, messages.rdd.getNumPartitions())
    df = df.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    df = stored(df, "quote-placed")
    counts = df.groupBy("_conv", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    ahead = Window.partitionBy("_conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions, at most
    counts = counts.select("_conv", "_part", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return df.join(counts, ["_conv", "_part"]).withColumn("position", F.col("_before") + F.col("_row") - F.col("_first")).drop("_part", "_first", "_before")


def lines_of(text: Column) -> Column:
    """(level, raw) of each line."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.struct(quote_level(x).alias("level"), x.alias("raw")))


def _passages(lines: Column, level: Column | int) -> Column:
    """The level's passages, their normalised lines joined by line breaks: all else is blank, and blank lines part them."""
    mine = F.transform(lines, lambda x: F.when(x["level"] == level, normal(bare(x["raw"]))).otherwise(""))
    return F.filter(F.transform(F.split(F.array_join(mine, "\n"), "\n{2,}"), lambda p: F.trim(p, F.lit("\n"))), lambda p: p != "")


def _units(df: DataFrame, of: list[str]) -> DataFrame:
    """df (``passage``) -> whole (boolean), text: the passage and each of its lines."""
    own = F.array(F.struct(F.lit(True).alias("whole"), F.replace(F.col("passage"), F.lit("\n"), F.lit(" ")).alias("text")))
    each = F.transform(F.array_distinct(F.split("passage", "\n")), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("text")))
    return df.select(*of, F.explode(F.concat(own, each)).alias("u")).select(*of, "u.whole", "u.text")


def carried(df: DataFrame, keys: list[str], at: Column, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last ``value`` that is not null among rows of the keys at or before this one.

    Rows are ordered by (position, at).  Windows hold a block of positions, and one row a block.
    """
    df = df.withColumn("_at", at).withColumn("_value", value).withColumn("_block", F.floor(F.col("position") / BLOCK))
    inside = Window.partitionBy(*keys, "_block").orderBy("position", "_at").rowsBetween(Window.unboundedPreceding, 0)
    last = df.filter("_value is not null").groupBy(*keys, "_block").agg(F.max(F.struct("position", "_at", "_value"))["_value"].alias("_value"))
    blocks = df.select(*keys, "_block").distinct().join(last, [*keys, "_block"], "left")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_ahead", F.last("_value", ignorenulls=True).over(before)).select(*keys, "_block", "_ahead")
    df = df.withColumn(name, F.last("_value", ignorenulls=True).over(inside)).join(blocks, [*keys, "_block"])
    return df.withColumn(name, F.coalesce(name, "_ahead")).drop("_at", "_value", "_block", "_ahead")


def _votes(found: DataFrame) -> DataFrame:
    """found (_row, level, passage_id, whole, length, to) -> _row, to: lines count where their passage was not found."""
    passage = Window.partitionBy("_row", "level", "passage_id")
    counted = found.withColumn("known", F.max("whole").over(passage)).filter(F.col("whole") == F.col("known"))
    votes = counted.groupBy("_row", "level", "to").agg(F.sum("length").alias("votes"))
    return votes.groupBy("_row").agg(F.min(F.struct("level", (-F.col("votes")).alias("votes"), (-F.col("to.position")).alias("near"), "to"))["to"].alias("to"))


def _linked(df: DataFrame, asks: DataFrame) -> DataFrame:
    """_row, to_conv, to_name, to_position for the messages whose quotes are known; df: messages with ``_lines``."""
    own = df.select("_conv", "conv_id", "position", "_row", F.explode(_passages(F.col("_lines"), 0)).alias("passage"))
    own = _units(own, ["_conv", "conv_id", "position", "_row"]).select("_conv", "conv_id", "position", "_row", "whole", F.xxhash64("whole", "text").alias("h")).distinct()
    # only what is quoted anywhere matters as an origin
    origins = stored(own.join(asks.select("h").distinct(), "h", "left_semi"), "quote-origins")
    place = F.struct("position", F.col("_row").alias("row"))
    here = origins.join(asks.select("_conv", "h").distinct(), ["_conv", "h"], "left_semi").select("_conv", "h", "position", place.alias("origin"), *[F.lit(None).cast(t).alias(c) for c, t in _ASK])
    both = here.unionByName(asks.select("_conv", "h", "position", F.lit(None).cast("struct<position:long,row:long>").alias("origin"), *[c for c, _ in _ASK]))
    # at one position the quote comes before the message's own lines
    told = carried(both, ["_conv", "h"], F.when(F.col("origin").isNull(), 0).otherwise(1), F.col("origin"), "to")
    inside = _votes(told.filter("_row is not null and to is not null"))
    # beyond the conversation: whole passages of one other conversation only
    single = origins.filter("whole").groupBy("h").agg(F.min("_conv").alias("lo"), F.max("_conv").alias("hi"), F.min(place).alias("to")).filter("lo = hi")
    far = asks.filter("whole").join(inside.select("_row"), "_row", "left_anti").join(single, "h").filter("lo <> _conv")
    linked = inside.unionByName(_votes(far.select("_row", "level", "passage_id", "whole", "length", "to")))
    where = df.select(F.col("_row").alias("to_row"), F.col("conv_id").alias("to_conv"), F.col("_conv").alias("to_name"), F.col("position").alias("to_position"))
    return linked.select("_row", F.col("to.row").alias("to_row")).join(where, "to_row").select("_row", "to_conv", "to_name", "to_position")


_ASK = (("_row", "long"), ("level", "int"), ("passage_id", "int"), ("whole", "boolean"), ("length", "long"))


def _asks(df: DataFrame) -> DataFrame:
    """_conv, h, position and the quoted units' _row, level, passage_id, whole, length."""
    levels = F.array_distinct(F.filter(F.transform("_lines", lambda x: x["level"]), lambda x: x > 0))
    df = df.withColumn("_levels", levels).filter(F.size("_levels") > 0)
    df = df.select("_conv", "position", "_row", "_lines", F.explode("_levels").alias("level"))
    df = df.select("_conv", "position", "_row", "level", F.posexplode(_passages(F.col("_lines"), F.col("level"))).alias("passage_id", "passage"))
    units = _units(df, ["_conv", "position", "_row", "level", "passage_id"])
    return units.select("_conv", F.xxhash64("whole", "text").alias("h"), "position", "_row", "level", "passage_id", "whole", F.length("text").cast("long").alias("length"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, position, parent_conv, parent_position, depth, quote_levels, text (without quotes)."""
    df = placed(messages.select("conv_id", "turn", "role", "text")).withColumn("_lines", lines_of(F.col("text")))
    own = F.array_join(F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["raw"]), "\n")
    levels = F.array_max(F.transform("_lines", lambda x: x["level"]))
    body = F.when(F.col("quote_levels") > 0, F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")).otherwise(F.coalesce("text", F.lit("")))
    asks = stored(_asks(df), "quote-asks")
    before = F.when(F.col("position") > 0, F.col("position") - 1)
    if asks.isEmpty():
        out = df.withColumn("parent_conv", F.when(F.col("position") > 0, F.col("conv_id"))).withColumn("parent_position", before).withColumn("depth", F.col("position"))
    else:
        keys = df.select("_conv", "conv_id", "position", "_row").join(_linked(df, asks), "_row", "left")
        found = F.col("to_name").isNotNull()
        keys = keys.withColumn("parent_conv", F.when(found, F.col("to_conv")).when(F.col("position") > 0, F.col("conv_id")))
        keys = keys.withColumn("parent_position", F.when(found, F.col("to_position")).otherwise(before))
        # a link out of the conversation begins a thread; a link inside points back
        keys = keys.withColumn("_up", F.when(found & (F.col("to_name") == F.col("_conv")), F.col("to_position")).when(~found, before))
        keys = stored(keys.select("_conv", "position", "_row", "parent_conv", "parent_position", "_up"), "quote-parents")
        out = df.join(_with_depth(keys).select("_row", "parent_conv", "parent_position", "depth"), "_row")
    return out.withColumn("quote_levels", levels).select("conv_id", "turn", "role", "position", "parent_conv", "parent_position", "depth", "quote_levels", body.alias("text"))


def _with_depth(df: DataFrame) -> DataFrame:
    """Depth in the reply tree.

    A run of messages that each answer the one before is counted by position; only the starts of runs
    (messages that answer something else) are followed up the tree, by pointer doubling.  Links point
    back in the conversation, so every turn of the loop at least halves what is left of each way.
    """
    starts = F.col("_up").isNull() | (F.col("_up") != F.col("position") - 1)
    broken = stored(df.filter(starts & (F.col("position") > 0)).select("_conv").distinct(), "quote-broken")
    plain = df.join(broken, "_conv", "left_anti").withColumn("depth", F.col("position"))
    if broken.isEmpty():
        return plain
    hard = carried(df.join(broken, "_conv", "left_semi"), ["_conv"], F.lit(0), F.when(starts, F.col("position")), "_start")
    hard = stored(hard, "quote-runs")
    to = hard.select("_conv", F.col("position").alias("_up"), F.col("_start").alias("up"), (F.col("position") - F.col("_start") + 1).alias("more"))
    state = hard.filter("position = _start").select("_conv", "_start", "_up").join(to, ["_conv", "_up"], "left").select("_conv", "_start", "up", F.coalesce("more", F.lit(0)).cast("long").alias("base"))
    state = stored(state, "quote-depth")
    while not state.filter("up is not null").isEmpty():
        above = state.select("_conv", F.col("_start").alias("up"), F.col("up").alias("next"), F.col("base").alias("more"))
        state = stored(state.join(above, ["_conv", "up"], "left").select("_conv", "_start", F.col("next").alias("up"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")), "quote-depth")
    hard = hard.join(state.select("_conv", "_start", "base"), ["_conv", "_start"]).withColumn("depth", F.col("base") + F.col("position") - F.col("_start"))
    return plain.unionByName(hard.select(plain.columns))


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations")).withColumn("text_md5", F.md5(F.encode("text", "UTF-8"))).drop("text")
