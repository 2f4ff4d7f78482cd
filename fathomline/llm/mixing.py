"""Mixing sources to target weights by entropy balancing.

Every source gets a token target: its weight's share of ``share`` times all tokens, stopped at
``most`` times its own size, the excess dealt again by weight.  Document rates are the ones
nearest to 1 (in the entropy of a rate between 0 and ``most``) that meet the target; their dual is
convex with one multiplier a source, and the solution is a tilt that is exponential in the
document's tokens and saturates at ``most``:

    rate = most / (1 + (most - 1) * exp(-multiplier * tokens / mean tokens of the source))

The multipliers come from Newton steps kept inside a bracket.  A step sums the gradient and the
curvature over a histogram (source, tokens, documents), so the corpus itself is read once for the
histogram and once for the rates.  Sums are decimal: they do not depend on the order of tasks, and
reruns agree.

Rates become whole copies by systematic rounding inside buckets of about ``bucket_rows`` documents
of a source, ordered by size; a source of any number of rows is spread over as many buckets as it
needs.  What rounding leaves of a source is settled by whole copies as well, given or taken back from the
largest sizes that fit, chosen from the counts by size; only what is then left, less than one
document, is a part of one copy.

Defined cases: a null or blank text has size 0 and takes nothing; null is a source of its own, last
in order; repeated rows are mixed row by row; ties in size are ordered by ``doc_id``; extra columns
are dropped by ``mix_plan`` and kept by ``mix``; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, stored, table, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size) -> with target.  One row a source goes through one window."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    df = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights)))
    df = df.withColumn("limit", most * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level at which this source and all fuller ones share what the emptier ones leave
    df = df.withColumn("total", share * F.sum("source_size").over(everything))
    df = df.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("level", F.first(F.when(F.col("ratio") >= F.col("level"), F.col("level")), ignorenulls=True).over(everything))
    target = F.least(F.col("limit"), F.col("weight") * F.coalesce(F.col("level"), F.lit(float("inf"))))
    return df.select("source", "source_size", "n_docs", target.alias("target"))


def _rate(multiplier, tokens, mean, most: float):
    bias = -math.log(most - 1)
    z = F.least(F.greatest(multiplier * tokens / mean + bias, F.lit(-700.0)), F.lit(700.0))
    return most / (1 + F.exp(-z))


def solve_multipliers(histogram: DataFrame, targets: DataFrame, most: float = MOST, steps: int = 40, tolerance: float = 1e-7) -> DataFrame:
    """Newton iterations on the dual; source, multiplier (infinite where all is taken ``most`` times)."""
    mean = F.col("source_size") / F.col("n_docs")
    state = targets.select(
        "source", "source_size", "target", mean.alias("mean"), F.lit(0.0).alias("m"), F.lit(-1e7).alias("lo"), F.lit(1e7).alias("hi"),
        ((F.col("source_size") == 0) | (F.col("target") >= most * F.col("source_size") * (1 - 1e-12))).alias("done"),
    )
    state = stored(state, "mix-state")
    for _ in range(steps):
        rate = _rate(F.col("m"), F.col("size"), F.col("mean"), most)
        sums = (
            histogram.join(state.filter(~F.col("done")).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source")
            .agg(
                F.sum((F.col("docs") * rate * F.col("size")).cast("decimal(38,6)")).cast("double").alias("taken"),
                F.sum((F.col("docs") * rate * (1 - rate / most) * F.col("size") * F.col("size") / F.col("mean")).cast("decimal(38,6)")).cast("double").alias("slope"),
            )
            .withColumnRenamed("source", "s")
        )
        gap = F.col("taken") - F.col("target")
        df = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        df = df.withColumn("lo", F.when(gap < 0, F.col("m")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap > 0, F.col("m")).otherwise(F.col("hi")))
        newton = F.when(F.col("slope") > 0, F.col("m") - gap / F.col("slope"))
        newton = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton)
        # outside the bracket: bisect on the scale of the sign's own side, which spans many powers of ten
        middle = F.when(F.col("lo") < -1, F.when(F.col("hi") <= -1, -F.sqrt(F.col("lo") * F.col("hi"))).otherwise(-F.sqrt(-F.col("lo")))).otherwise(
            F.when(F.col("hi") > 1, F.sqrt(F.col("hi") * F.greatest(F.col("lo"), F.lit(1.0)))).otherwise((F.col("lo") + F.col("hi")) / 2)
        )
        finished = F.col("done") | F.coalesce(F.abs(gap) <= tolerance * F.col("target") + 1e-3, F.lit(True))
        df = df.withColumn("m", F.when(finished, F.col("m")).otherwise(F.coalesce(newton, middle))).withColumn("done", finished)
        state = stored(df.select(state.columns), "mix-state")
        if state.filter(~F.col("done")).isEmpty():
            break
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    return state.select("source", F.when(full, F.lit(1e9)).otherwise(F.col("m")).alias("multiplier"), "mean")


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, bucket_rows: int = 1000) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs (doc_id, source, text)."""
    sized = stored(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("hash")), "mix-sizes")
    histogram = stored(sized.groupBy("source", "size").agg(F.count("*").alias("docs")), "mix-histogram")
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("n_docs"))
    targets = stored(source_targets(totals, weights, share, most), "mix-targets")
    found = solve_multipliers(histogram, targets, most).withColumnRenamed("source", "s")
    per_source = targets.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "s")
    df = sized.join(per_source, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    df = df.withColumn("rate", F.when(F.col("size") > 0, _rate(F.col("multiplier"), F.col("size"), F.col("mean"), most)).otherwise(F.lit(1.0)))
    df = df.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "hash"), F.ceil(F.col("n_docs") / bucket_rows)))
    order = Window.partitionBy("source", "bucket").orderBy("size", "doc_id", "hash")
    start = F.pmod(F.xxhash64("source", "bucket"), F.lit(1 << 20)) / float(1 << 20)
    df = df.withColumn("to", start + F.sum("rate").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.floor(F.col("to")) - F.floor(F.coalesce(F.lag("to").over(order), start))
    df = df.withColumn("copies", F.least(whole, F.lit(math.floor(most))).cast("long"))
    rounded = stored(df.select("doc_id", "hash", "source", "size", "source_size", "target", "bucket", "copies"), "mix-copies")
    settled = _settled(rounded, math.floor(most))
    return settled.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def _settled(rounded: DataFrame, most: int) -> DataFrame:
    """rounded with the rest of each source settled: ``copies`` one more or less, and ``part`` words of one copy."""
    sums = rounded.groupBy("source").agg((F.round(F.first("target")) - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("rest")).filter("rest <> 0")
    more, less = F.count_if(F.col("copies") < most), F.count_if(F.col("copies") > 0)
    sizes = rounded.filter("size > 0").groupBy("source", "size").agg(more.alias("more"), less.alias("less"))
    sizes = sizes.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("units", F.when(F.col("rest") > 0, F.col("more")).otherwise(F.col("less")))
    # a source's distinct sizes, largest first
    lists = sizes.filter("units > 0").groupBy("source", "rest").agg(F.sort_array(F.collect_list(F.struct("size", "units")), asc=False).alias("sizes"))
    none = F.lit(None).cast("struct<size:bigint,n:bigint>")
    begin = F.struct(F.abs("rest").alias("left"), F.array().cast("array<struct<size:bigint,n:bigint>>").alias("picks"), none.alias("spare"))

    def step(acc, x):
        n = F.least(x["units"], F.floor(acc["left"] / x["size"]))
        pick = F.struct(x["size"].alias("size"), n.alias("n"))
        return F.struct(
            (acc["left"] - n * x["size"]).alias("left"),
            F.when(n > 0, F.concat(acc["picks"], F.array(pick))).otherwise(acc["picks"]).alias("picks"),
            F.when(acc["spare"].isNull() & (n < x["units"]), pick).otherwise(acc["spare"]).alias("spare"),
        )

    picks = lists.select("source", F.signum("rest").cast("long").alias("sign"), F.aggregate("sizes", begin, step).alias("a"))
    spare = F.when((F.col("a.left") > 0) & F.col("a.spare").isNotNull(), F.array(F.struct("a.spare.size", "a.spare.n", F.col("a.left").alias("part")))).otherwise(F.array().cast("array<struct<size:bigint,n:bigint,part:bigint>>"))
    plain = F.transform(F.filter("a.picks", lambda p: ~F.coalesce((F.col("a.left") > 0) & (p["size"] == F.col("a.spare.size")), F.lit(False))), lambda p: F.struct(p["size"].alias("size"), p["n"].alias("n"), F.lit(0).cast("long").alias("part")))
    picks = picks.select(F.col("source").alias("s"), "sign", F.explode(F.concat(plain, spare)).alias("p")).select("s", "sign", F.col("p.size").alias("z"), F.col("p.n").alias("n"), F.col("p.part").alias("words"))
    picks = stored(picks, "mix-picks")
    df = rounded.join(picks, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
    able = F.col("n").isNotNull() & F.when(F.col("sign") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    still = df.filter(~able).withColumn("part", F.lit(0).cast("long"))
    # the first n of these: counted by bucket, ranked inside
    df = df.filter(able)
    ahead = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy("source", "size", "bucket").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(ahead), F.lit(0)))
    counts = counts.select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("bucket").alias("b2"), "before")
    df = df.join(counts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("bucket") == F.col("b2")))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("doc_id", "hash"))
    df = df.withColumn("rank", rank)
    df = df.withColumn("part", F.when(F.col("rank") == F.col("n") + 1, F.col("sign") * F.col("words")).otherwise(F.lit(0)))
    df = df.withColumn("copies", F.when(F.col("rank") <= F.col("n"), F.col("copies") + F.col("sign")).otherwise(F.col("copies")))
    columns = [*rounded.columns, "part"]
    return still.select(columns).unionByName(df.select(columns))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as the plan says; a part of a copy is its first words, as they stand."""
    kept = docs.columns
    taken_names = {c.lower() for c in kept}

    def free(name: str) -> str:
        while name in taken_names:
            name += "_"
        return name

    pid, size, source, taken, n, part = (free(x) for x in ("_id", "_size", "_source", "_taken", "_n", "_part"))
    plan = mix_plan(docs, **options).select(F.col("doc_id").alias(pid), F.col("size").alias(size), F.col("source").alias(source), F.col("taken").alias(taken))
    # repeated doc ids: the plan's rows and the documents' rows are matched in order
    plan = plan.withColumn(n, F.row_number().over(Window.partitionBy(pid, source, size).orderBy(taken)))
    words, k = free("_words"), free("_k")
    df = docs.withColumn(words, F.size(words_of(F.col("text"))).cast("long"))
    df = df.withColumn(k, F.row_number().over(Window.partitionBy("doc_id", "source", words).orderBy("text")))
    df = df.join(plan, F.col("doc_id").eqNullSafe(F.col(pid)) & df["source"].eqNullSafe(F.col(source)) & (F.col(words) == F.col(size)) & (F.col(k) == F.col(n)))
    whole = F.when(F.col(words) > 0, F.floor(F.col(taken) / F.greatest(F.col(words), F.lit(1)))).otherwise(F.lit(0)).cast("int")
    rest = (F.col(taken) - whole * F.col(words)).cast("int")
    df = df.withColumn(part, F.explode(F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"({SPACE[:-1]}*[^{SPACE[1:-2]}]+)"), F.lit(1)), 1, F.greatest(F.col(part), F.lit(1))), "")
    return df.withColumn("text", F.when(F.col(part) == 0, F.col("text")).otherwise(first)).select(kept)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
