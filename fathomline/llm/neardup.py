"""MinHash near-duplicates by an inverted join on signature coordinates.

1.  One pass makes each text's set of word shingles, its signature of ``coordinates`` values (each of
    three minima, so that unrelated texts do not share them by chance), and a 128-bit digest of the set.
    Texts with equal sets form a *class*, which gets a number; all that follows is on classes.
2.  Classes are posted under every (coordinate, value).  Two sets of similarity s agree in about
    s^3 * coordinates of them; pairs with ``matches`` or more go on.  Such a pair has ``matches`` shared
    postings on both sides, so a class with fewer shared postings than that is skipped outright, and
    of the others only the rarest ``shared - matches + 1`` postings (one order for all: list length,
    then key) are kept: two such prefixes of a wanted pair always meet.
3.  Members of a list are not paired with each other.  In each round a list names a pivot; every
    member of another component asks one pivot, collisions are counted on the full signatures, and
    what passes is verified on the full sets.  Verified links join components.  Lists that lie within
    one component are done.  The first pivot is the list's most central member, the one whose postings
    have the longest lists: a member of a group of copies that is linked with anyone is mostly linked with it.
    Shingles that no other class has are counted first: what is left of the smaller side bounds the
    intersection, and pairs, or whole classes, that cannot reach the threshold are dropped by that bound.
4.  After the rounds, lists that still hold several components are finished exactly, with no cap: those
    of one most central member are merged, so that a group of copies is compared once and not once a
    coordinate; members outside the largest component are compared with all members, block by block
    (blocks are bounded in rows and bytes), collisions counted and sets intersected in place.  Only
    links leave a task, at most one from a member to a component in a block.

The chance to lose a link of similarity 0.8 is that of fewer than 9 agreements in 48, about 2e-6.
Verification is exact up to collisions of 64-bit hashes.

Defined cases: a null text is empty; a text without words has no shingles and is linked with
nothing; a row without doc_id is linked with nothing, its component is null and it is kept; rows that
repeat a doc_id count as one document whose component is shared; extra columns are dropped; an
empty table gives an empty result; a doc_id that is not an integer is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from .common import arrow_map, stored, table
from .tokenout import text_slices
from .words import min_hashes, shingle_sets

COORDINATES = 48
#: Minima in a coordinate: one alone is shared by chance with someone in any large corpus.
MINIMA = 3
MATCHES = 9
ROUNDS = 2
#: Rows and bytes of sets in a block of the exact finish.
BLOCK = 256
BLOCK_BYTES = 1 << 21
#: Ids that are broadcast to pick documents, and rows of two numbers that are broadcast at all, at most; beyond it they are joined by shuffle.
BROADCAST_IDS = 2_000_000
BROADCAST_ROWS = 500_000


def _digest(s: np.ndarray) -> tuple[int, int]:
    found = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def _documents(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"doc_id must be an integer, not {kind.simpleString()}")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def signatures(docs: DataFrame, width: int, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (the set's digest), sig."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, "text", 3 << 20):
                sets = shingle_sets(rows.column("text"), width)
                sig = min_hashes(sets, coordinates, MINIMA)
                n = np.array([len(s) for s in sets], np.int64)
                names = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * coordinates), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), flat], ["doc_id", "n_shingles", "d1", "d2", "sig"])

    return arrow_map(_documents(docs), sign, "doc_id long, n_shingles long, d1 long, d2 long, sig array<long>")


def _small(df: DataFrame, most: int) -> DataFrame:
    """Broadcast a stored table of few rows, which are counted; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, comp): the smallest node reachable.  Least neighbour and pointer jumping."""
    edges = links.select("a", "b").filter("a <> b")
    edges = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    few = edges.count() <= BROADCAST_ROWS  # labels and neighbours have no more rows than edges
    side = F.broadcast if few else (lambda df: df)
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "cc-labels")
    while True:
        near = edges.join(side(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        seen = near.join(side(labels), "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        after = stored(seen.join(side(jump), "comp", "left").select("node", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "cc-labels")
        labels = after.select("node", "comp")
        if after.filter("comp <> was").isEmpty():
            return labels


def _postings(classes: DataFrame, matches: int) -> DataFrame:
    """key, cid, weight, first: the prefixes of the classes that share enough postings; weight: the lengths of all lists of a class."""
    posts = classes.select("cid", F.posexplode("sig").alias("at", "value")).select("cid", F.xxhash64("at", "value").alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = posts.join(lists, "key")
    own = Window.partitionBy("cid")
    ranked = shared.withColumn("m", F.count("*").over(own)).filter(F.col("m") >= matches)
    ranked = ranked.withColumn("r", F.row_number().over(own.orderBy("n", "key"))).withColumn("weight", F.sum("n").over(own))
    return ranked.filter(F.col("r") <= F.col("m") - matches + 1).select("key", "cid", "weight", (F.col("r") == 1).alias("first"))


def _shared_shingles(sets: DataFrame) -> DataFrame:
    """sets (cid, set) -> cid, alone: how many of a class's shingles no other class has."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("set")]
            h = np.concatenate(parts)
            cid = np.repeat(batch.column("cid").to_numpy(), [len(x) for x in parts])
            order = np.argsort(h, kind="stable")
            h, cid = h[order], cid[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.minimum.reduceat(cid, first)), pa.array(np.maximum.reduceat(cid, first))], ["h", "lo", "hi"])

    found = arrow_map(sets.select("cid", "set"), spans, "h long, lo long, hi long").groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return found.filter("lo = hi").groupBy(F.col("lo").alias("cid")).agg(F.count("*").alias("alone"))


def _verified(pairs: DataFrame, family: DataFrame, matches: int, least: int, of: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in ``matches`` coordinates or more and whose full sets have of * intersection >= least * union."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            keep = (sa == sb).sum(axis=1) >= matches
            for k in np.flatnonzero(keep):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in ("set_a", "set_b"))
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep[k] = of * common >= least * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda x: family.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "free", "sig", "set")])
    most = F.least("free_a", "free_b")
    df = pairs.join(side("a"), "a").join(side("b"), "b").filter(of * most >= least * (F.col("n_a") + F.col("n_b") - most))
    return arrow_map(df.select("a", "b", "sig_a", "sig_b", "set_a", "set_b"), verify, "a long, b long")


def _family(docs: DataFrame, wanted: DataFrame, width: int, coordinates: int) -> DataFrame:
    """cid, n, sig, set for wanted (cid, rep, d1, d2), from the text of document ``rep``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, "text", 3 << 20):
                want = zip(*(rows.column(c).to_pylist() for c in ("cid", "d1", "d2")), strict=True)
                # a repeated document may have other texts
                found = [(c, s) for (c, *name), s in zip(want, shingle_sets(rows.column("text"), width), strict=True) if tuple(name) == _digest(s)]
                sets = [s for _, s in found]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * coordinates), pa.array(min_hashes(sets, coordinates, MINIMA).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in found], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), flat, pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "n", "sig", "set"]
                )

    wanted = _small(wanted.select("cid", "d1", "d2", F.col("rep").alias("doc_id")), BROADCAST_IDS)
    found = _documents(docs).join(wanted, "doc_id").select("cid", "d1", "d2", "text")
    return arrow_map(found, make, "cid long, n long, sig array<long>, set binary")


def _mixed(posts: DataFrame, merged: DataFrame | None, order: Column) -> DataFrame:
    """key, cid, comp and the pivot p (o, cid, comp) of the lists that hold several components."""
    posts = posts.withColumn("comp", F.col("cid")) if merged is None else posts.join(_small(merged.withColumnRenamed("node", "cid"), BROADCAST_ROWS), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    lists = posts.groupBy("key").agg(F.max(F.struct(order.alias("o"), "cid", "comp")).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return posts.join(lists.select("key", "p"), "key")


def _rest(posts: DataFrame, merged: DataFrame | None, family: DataFrame, matches: int, least: int, of: int) -> DataFrame:
    """The links of different components that lists still hold, by blocks, without a cap."""
    lists = _mixed(posts, merged, F.col("weight")).groupBy(F.col("p.cid").alias("pivot"), "cid").agg(F.first("comp").alias("comp"))
    lists = stored(lists, "dup-merged")
    if lists.isEmpty():
        return lists.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    members = stored(lists.join(family, "cid"), "dup-members")
    by_comp = members.groupBy("pivot", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    size = by_comp.groupBy("pivot").agg(F.max(F.struct("rows", "comp"))["comp"].alias("main"), F.greatest(F.ceil(F.sum("rows") / BLOCK), F.ceil(8 * F.sum("n") / BLOCK_BYTES)).alias("blocks"), F.count("*").alias("comps"))
    size = _small(stored(size.filter("comps > 1").drop("comps"), "dup-size"), BROADCAST_ROWS)
    members = members.join(size, "pivot").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    row = F.struct("cid", "comp", "sig", "n", "free", "set")
    everyone = members.groupBy("pivot", "block").agg(F.collect_list(row).alias("all"))
    queries = members.filter("comp <> main").groupBy("pivot", "block").agg(F.collect_list(row).alias("some")).withColumnRenamed("block", "asked")
    both = queries.join(everyone, "pivot").select("some", "all")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(x):
            v = x.values
            sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in v.field("set")]
            return *(v.field(c).to_numpy() for c in ("cid", "comp", "n", "free")), v.field("sig").flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1), sets

        for batch in batches:
            a, b = [], []
            for x, y in zip(batch.column("some"), batch.column("all"), strict=True):
                ca, ga, na, fa, sa, ta = parts(x)
                cb, gb, nb, fb, sb, tb = parts(y)
                known, codes = np.unique(np.concatenate(tb), return_inverse=True)
                starts = np.cumsum([0, *[len(t) for t in tb[:-1]]])
                mark = np.zeros(len(known) + 1, np.int32)
                for i in range(len(ca)):
                    most = np.minimum(fb, fa[i])
                    may = (gb != ga[i]) & (of * most >= least * (nb + na[i] - most))
                    may[may] = (sb[may] == sa[i]).sum(axis=1) >= matches
                    if not may.any():
                        continue
                    at = np.searchsorted(known, ta[i])
                    at = at[known[np.minimum(at, len(known) - 1)] == ta[i]]
                    mark[at] = 1
                    common = np.add.reduceat(mark[codes], starts)
                    mark[at] = 0
                    hit = np.flatnonzero(may & (of * common >= least * (nb + na[i] - common)))
                    hit = hit[np.unique(gb[hit], return_index=True)[1]]  # one link to a component joins all of it
                    a.extend([ca[i]] * len(hit))
                    b.extend(cb[hit])
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return arrow_map(both, compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, least: int = 80, of: int = 100, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept for each row."""
    signed = stored(signatures(docs, width, coordinates), "dup-signed")
    named = signed.filter("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "dup-classes")  # numbers are fixed as they are written
    posts = stored(_postings(classes, matches), "dup-posts")
    sharing = classes.select("cid", "rep", "d1", "d2").join(_small(posts.filter("first").select("cid"), BROADCAST_IDS), "cid")
    sharing = stored(sharing, "dup-sharing")
    family = stored(_family(docs, sharing, width, coordinates), "dup-sets")
    # shingles that no other class has bound every intersection; some classes can match nothing
    alone = _small(stored(_shared_shingles(family), "dup-alone"), BROADCAST_IDS)
    family = family.join(alone, "cid", "left").withColumn("free", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    family = family.filter(of * F.col("free") >= least * F.col("n"))
    # a document that is repeated gives its class more than once
    if not sharing.groupBy("rep").count().filter("count > 1").isEmpty() or family.count() > sharing.count():
        family = family.dropDuplicates(["cid"])
    family = stored(family, "dup-family")
    posts = stored(posts.select("key", "cid", "weight").join(_small(family.select("cid"), BROADCAST_IDS), "cid"), "dup-possible")
    links, merged = None, None
    for k in range(ROUNDS + 1):
        if k < ROUNDS:
            # every list names a pivot, every member outside its component asks one of them
            order = F.col("weight") if k == 0 else F.xxhash64("key", "cid", F.lit(k))
            asks = _mixed(posts, merged, order).filter(F.col("comp") != F.col("p.comp"))
            pairs = asks.groupBy("cid").agg(F.max(F.struct("p.o", "p.cid"))["cid"].alias("b")).withColumnRenamed("cid", "a")
            found = _verified(pairs, family, matches, least, of)
        else:
            found = _rest(posts, merged, family, matches, least, of)
        found = stored(found.select("a", "b"), "dup-links")
        if found.isEmpty() and k:
            continue
        links = found if links is None else links.unionByName(found)
        merged = components(links)
    # from classes back to documents: a document's rows with several texts tie their classes together
    repeats = named.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("x"), F.max(F.struct("d1", "d2")).alias("y")).filter("x <> y").select("doc_id")
    repeats = stored(repeats, "dup-repeats")
    if not repeats.isEmpty():
        several = named.select("doc_id", "d1", "d2").join(_small(repeats, BROADCAST_IDS), "doc_id").join(classes.select("d1", "d2", "cid"), ["d1", "d2"])
        tied = several.join(several.groupBy("doc_id").agg(F.min("cid").alias("a")), "doc_id").select("a", F.col("cid").alias("b"))
        merged = components(links.unionByName(tied))
    # a class that is linked with none has its own first document; the others the first of their component
    linked = classes.select("cid", "rep").join(_small(merged.withColumnRenamed("node", "cid"), BROADCAST_ROWS), "cid")
    first = linked.groupBy("comp").agg(F.min("rep").alias("first"))
    first = stored(first.join(merged, "comp").select(F.col("node").alias("cid"), "first"), "dup-first")
    by_class = classes.select("cid", "d1", "d2", "rep").join(_small(first, BROADCAST_ROWS), "cid", "left").select("d1", "d2", F.coalesce("first", "rep").alias("component_id"))
    # the classes of exact copies are the only hot keys here, and Spark splits those as it joins
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(by_class, ["d1", "d2"], "left")
    named_row = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(named_row, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
