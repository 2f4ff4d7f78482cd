"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

1.  Words are runs of letters and digits, lower-cased; shingles are five words (an item of fewer words
    is one shingle of its own length).  A window of weighted similarity s or more with an item shares
    s / (1 + s) of the two weights' sum with it, so of any chosen part of the item's shingles it holds all but
    the rest.  Half of each item's shingles, those that fewest items have, are looked up in all documents, and
    every window of the item's size that holds as many of them as that asks for, wherever in the window they
    stand, goes on: no other window can reach s with that item.
2.  Each window is fingerprinted: 64-bit SimHash of the weighted shingles.
3.  A fingerprint within ``radius`` of another agrees with it in at least one of radius + 1 blocks;
    windows and items meet in an equality join on (item, block, value), the item being one whose shingles the
    window holds: blocks as short as such a radius asks for tell hardly any two fingerprints apart, so
    alone they would pair each window with most items of its length.  The Hamming distance is taken exactly.
4.  Candidates are verified by their exact weighted similarity, sum of minima over sum of maxima.

Fingerprints and similarities are computed inside the row, from the window's words; only hits, and windows
of documents that were hit, are shuffled.

At similarity 0.8 the expected distance is 9.7 bits with a deviation of 2.9; the radius of 18 loses
about two in a thousand windows that stand right at the threshold and none that are nearer.

The items' looked-up shingles are broadcast where they are at most ``BROADCAST_ROWS`` rows, which is
checked, and joined by shuffle beyond it.

Defined cases: null texts are empty; items and documents without words match nothing; a null doc_id or
item_id is carried as such; repeated rows are reported once; extra columns are ignored by ``find_leaks``
and kept by ``decontaminate``, whatever their names; with an empty table on either side nothing is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored, table

#: Separators of words: everything in ASCII but letters and digits.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 5
SIMILARITY = 0.8
RADIUS = 18
BROADCAST_ROWS = 200_000
#: Sixty-four lanes in thirty-two sums.
LANES = 0x0000000100000001


def token_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")


def _shingles(words: Column, width: Column | int) -> Column:
    """Hashes of the runs of ``width`` words, in order; none where there are fewer words."""
    n = F.size(words)
    return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - F.lit(width) + 1 if isinstance(width, int) else n - width + 1), lambda i: F.xxhash64(F.slice(words, i, width))))


def _small(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Broadcast what is small, which is counted (in ``rows`` where df holds them in lists); otherwise leave the join to a shuffle."""
    return F.broadcast(df) if (df if rows is None else rows).count() <= BROADCAST_ROWS else df


def _features(df: DataFrame, key: str) -> DataFrame:
    """df (key, words, width) -> key, h, tf.

    The outer form of explode: the inner one has Spark repeat the array's expression in a filter below
    it, where every step of the inner function would split the text anew.
    """
    df = df.withColumn("_hashes", _shingles(F.col("words"), F.col("width")))
    return df.select(key, F.explode_outer("_hashes").alias("h")).filter("h is not null").groupBy(key, "h").agg(F.count("*").alias("tf"))


def _fingerprint(hashes: Column) -> Column:
    """SimHash of shingle hashes, each as often as it occurs: two counters of ones share each sum."""
    out = F.lit(0).cast("long")
    for k in range(32):
        out = out.bitwiseOR(_two_lanes(hashes, k))
    return out


def _two_lanes(hashes: Column, k: int) -> Column:
    ones = F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES)))
    # the sum is named by a one-element array, so that it is not taken twice
    both = F.transform(F.array(ones), lambda c: _lane(c.bitwiseAND(F.lit(0xFFFFFFFF)), hashes, k).bitwiseOR(_lane(F.shiftrightunsigned(c, 32), hashes, k + 32)))
    return F.get(both, F.lit(0))


def _lane(ones: Column, hashes: Column, bit: int) -> Column:
    return F.shiftleft(F.when(2 * ones > F.size(hashes), F.lit(1)).otherwise(F.lit(0)).cast("long"), bit)


def _numbered(hashes: Column) -> Column:
    """Hashes told apart by their occurrence: equal ones are numbered."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, i - F.array_position(hashes, x).cast("int")))


def row_key(docs: DataFrame) -> Column:
    """A 128-bit name of a row's doc_id and text."""
    return F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))


def _blocks(print_: Column, radius: int) -> Column:
    """The fingerprint's radius + 1 blocks as (block, value)."""
    count = radius + 1
    cuts = [64 * k // count for k in range(count + 1)]
    parts = [F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.struct(F.lit(k).alias("block"), p.alias("value")) for k, p in enumerate(parts)])


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs (doc_id, text) against benchmark (item_id, text) -> row_key, doc_id, item_id, start, n_words, similarity, distance."""
    items = benchmark.select("item_id", token_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    # items of equal words are one
    items = items.withColumn("iid", F.xxhash64("words")).groupBy("iid").agg(F.first("words").alias("words"), F.collect_set("item_id").alias("item_ids"))
    items = items.withColumn("length", F.size("words")).withColumn("width", F.least(F.lit(width), F.col("length")))
    items = stored(items, "leak-items")
    item_features = stored(_features(items, "iid"), "leak-item-features")
    total = items.select("iid", "length", "width", (F.col("length") - F.col("width") + 1).alias("total"))
    # the looked-up half of each item: whole groups of equal shingles, first those that fewest items have
    shared = item_features.groupBy("h").agg(F.count("*").alias("items"))
    run = Window.partitionBy("iid").orderBy("items", "h").rowsBetween(Window.unboundedPreceding, -1)
    chosen = item_features.join(shared, "h").withColumn("before", F.coalesce(F.sum("tf").over(run), F.lit(0))).join(total, "iid")
    chosen = chosen.filter(F.col("before") <= F.floor(F.col("total") / 2)).withColumn("chosen", F.sum("tf").over(Window.partitionBy("iid")))
    probes = stored(chosen.select("iid", "h", "length", "width", "chosen"), "leak-probes")

    base = docs.select("doc_id", row_key(docs).alias("row_key"), token_words(F.col("text")).alias("words"))
    hits = None
    for r in probes.select("width").distinct().orderBy("width").collect():  # five numbers at most
        w = r["width"]
        own = probes.filter(F.col("width") == w)
        own = _small(own.groupBy("h").agg(F.collect_list(F.struct("iid", "length", "chosen")).alias("items")), own)
        spread = base.withColumn("hashes", _shingles(F.col("words"), w)).select("doc_id", "row_key", F.size("words").alias("n"), F.posexplode_outer("hashes").alias("pos", "h"))
        found = spread.join(own, "h").select("doc_id", "row_key", "n", "pos", F.lit(w).alias("width"), F.explode("items").alias("item"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        none = F.lit(0)
        hits = base.select("doc_id", "row_key", none.alias("n"), none.alias("pos"), none.alias("width"), F.struct(none.cast("long").alias("iid"), none.alias("length"), none.cast("long").alias("chosen")).alias("item")).limit(0)
    hits = hits.select("doc_id", "row_key", "n", "pos", "width", "item.iid", "item.length", "item.chosen")
    # a text's hits of one item: every start whose window holds enough of them
    own = hits.groupBy("row_key", "iid").agg(F.sort_array(F.collect_set("pos")).alias("p"), *[F.first(c).alias(c) for c in ("doc_id", "n", "width", "length", "chosen")])
    size = F.least("length", "n")
    weight, whole = size - F.col("width") + 1, F.col("length") - F.col("width") + 1
    missing = F.floor(whole - similarity * (whole + weight) / (1 + similarity) + 1e-9)
    own = own.withColumn("n_words", size).withColumn("least", F.greatest(F.col("chosen") - missing, F.lit(1)).cast("int")).withColumn("reach", (size - F.col("width")).cast("int"))
    # equal positions of repeated shingles count once each, so a run of ``least`` hits spans the window's inside at most
    spans = F.transform(F.slice("p", 1, F.greatest(F.size("p") - F.col("least") + 1, F.lit(0))), lambda x, j: F.struct(F.greatest(F.lit(0), F.get("p", j + F.col("least") - 1) - F.col("reach")).alias("first"), F.least(x, F.col("n") - F.col("n_words")).alias("last")))
    own = own.withColumn("spans", F.filter(spans, lambda r: r["first"] <= r["last"])).filter(F.size("spans") > 0)
    own = stored(own.select("doc_id", "row_key", "iid", "width", "n_words", "spans"), "leak-hits")
    starts = own.select("row_key", "iid", "width", "n_words", F.explode("spans").alias("r")).select("row_key", "iid", "width", "n_words", F.explode(F.sequence("r.first", "r.last")).alias("start")).distinct()
    # back to the words: only the documents that were hit
    texts = base.drop("doc_id").join(_small(own.select("row_key").distinct()), "row_key").dropDuplicates(["row_key"])
    cut = starts.join(texts, "row_key").withColumn("words", F.slice("words", F.col("start") + 1, F.col("n_words")))
    cut = stored(cut.select(F.md5(F.array_join("words", " ")).alias("wid"), "row_key", "iid", "start", "n_words", F.sort_array(_shingles(F.col("words"), F.col("width"))).alias("hashes")), "leak-cut")
    windows = stored(cut.groupBy("wid", "iid").agg(F.first("hashes").alias("hashes")).withColumn("print", _fingerprint(F.col("hashes"))), "leak-windows")
    own_hashes = items.select("iid", F.sort_array(_shingles(F.col("words"), F.col("width"))).alias("item_hashes"))
    prints = stored(own_hashes.withColumn("item_print", _fingerprint(F.col("item_hashes"))), "leak-item-prints")
    a = windows.select("wid", "iid", "print", F.explode(_blocks(F.col("print"), radius)).alias("b")).select("wid", "iid", "print", "b.*")
    b = prints.select("iid", "item_print", F.explode(_blocks(F.col("item_print"), radius)).alias("b")).select("iid", "item_print", "b.*")
    near = a.join(_small(b), ["iid", "block", "value"]).withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
    near = stored(near.filter(F.col("distance") <= radius).select("wid", "iid", "distance").distinct(), "leak-near")
    pairs = windows.select("wid", "iid", "hashes").join(near, ["wid", "iid"]).join(_small(prints.select("iid", "item_hashes")), "iid")
    common = F.size(F.array_intersect(_numbered(F.col("hashes")), _numbered(F.col("item_hashes"))))
    pairs = pairs.withColumn("common", common).withColumn("similarity", F.col("common") / (F.size("hashes") + F.size("item_hashes") - F.col("common")))
    sure = pairs.filter(F.col("similarity") >= similarity - 1e-12).select("wid", "iid", "distance", "similarity")
    back = cut.select("wid", "iid", "row_key", "start", "n_words").join(sure, ["wid", "iid"])
    best = back.groupBy("row_key", "iid").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n_words", "distance")).alias("best"))
    named = own.select("row_key", "doc_id").distinct()
    out = best.join(named, "row_key").join(items.select("iid", F.explode_outer("item_ids").alias("item_id")), "iid")
    return out.select("row_key", "doc_id", "item_id", F.col("best.start").alias("start"), F.col("best.n_words").alias("n_words"), (-F.col("best.s")).alias("similarity"), F.col("best.distance").alias("distance"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no item was found."""
    leaks = stored(find_leaks(docs, benchmark, **options).select("row_key").distinct(), "leak-rows")
    name = "_row"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, row_key(docs)).join(_small(leaks.withColumnRenamed("row_key", name)), name, "left_anti").select(docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), F.round("similarity", 6).alias("similarity"))
