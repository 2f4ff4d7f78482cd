"""Nearest neighbours of a whole cloud by k-d trees: one deals the places to parts of a task each, others cut the parts.

A place lies left of a cut where its coordinate is below it.  A ball meets the other side where the square of its middle's gap
to the cut is no more than the ball's: rounding keeps the order of differences, squares and sums, so no neighbour is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from fathomline.functions.ship import shipped

#: Places of a part, about; a sample of so many a part sets the cuts, whatever it holds only balances the tasks.
PART, SAMPLED = 4096, 64
#: Points of a leaf within a part, and places held against them at once.
LEAF, ABREAST = 256, 4096


class Cuts:
    """A k-d tree with at most ``most`` points a leaf, equal ones aside; ``members`` are the points of each leaf."""

    def __init__(self, points: np.ndarray, most: int):
        self.nodes: list[list] = []  # dimension, cut, node below, node above; a leaf is -1 - its number
        self.members: list[np.ndarray] = []
        self._cut(points, np.arange(len(points)), most)

    def _cut(self, points: np.ndarray, own: np.ndarray, most: int) -> int:
        part = points[own]
        spread = np.nan_to_num(part.max(axis=0) - part.min(axis=0)) if len(own) > most else np.zeros(1)
        d = int(spread.argmax())
        if not spread[d] > 0:
            self.members.append(own)
            return -len(self.members)
        x = part[:, d]
        cut = np.partition(x, len(x) // 2)[len(x) // 2]
        if cut == x.min():
            cut = x[x > cut].min()
        node = [d, float(cut), 0, 0]
        self.nodes.append(node)
        at = len(self.nodes) - 1
        node[2] = self._cut(points, own[x < cut], most)
        node[3] = self._cut(points, own[x >= cut], most)
        return at

    def meet(self, places: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of places and of the leaves that their balls (squared radius ``bound``) meet, or that hold them; by leaf."""
        which, leaves, todo = [], [], [(0 if self.nodes else -1, np.arange(len(places)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                which.append(own)
                leaves.append(np.full(len(own), -1 - node, np.int32))
                continue
            d, cut, below, above = self.nodes[node]
            x = places[own, d]
            left = x < cut
            if bound is None:
                todo += [(below, own[left]), (above, own[~left])]
            else:
                near = (x - cut) * (x - cut) <= bound[own]
                todo += [(below, own[left | near]), (above, own[~left | near])]
        return (np.concatenate(which), np.concatenate(leaves)) if which else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def _squares(places: np.ndarray, points: np.ndarray) -> np.ndarray:
    total = None
    for d in range(points.shape[1]):
        gap = places[:, d, None] - points[None, :, d]
        gap *= gap
        total = gap if total is None else total + gap
    return total


def _meetings(cuts: Cuts, points: np.ndarray, places: np.ndarray, bound: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, points of one leaf, and the squares of their distances."""
    which, leaves = cuts.meet(places, bound)
    ends = np.flatnonzero(np.diff(leaves, append=-1)) + 1
    first = 0
    for end in ends:
        members = cuts.members[leaves[first]]
        for k in range(first, end, ABREAST):
            own = which[k : min(end, k + ABREAST)]
            yield own, members, _squares(places[own], points[members])
        first = end


def bounds(cuts: Cuts, points: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """A square that the k-th neighbour's distance does not pass: that to the k-th point in the place's own leaf."""
    out = np.full(len(places), np.inf)
    for own, members, d2 in _meetings(cuts, points, places, None):
        if len(members) >= k:
            out[own] = np.partition(d2, k - 1, axis=1)[:, k - 1]
    return out


def nearest(cuts: Cuts, points: np.ndarray, places: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, point and square of the k nearest within the bounds, ties to the lower point; by place and distance."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for own, members, d2 in _meetings(cuts, points, places, bound):
        limit = bound[own]
        if len(members) > k:
            limit = np.minimum(limit, np.partition(d2, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(d2 <= limit[:, None])
        found.append((own[i], members[j], d2[i, j]))
    place, point, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((point, d2, place))
    place, point, d2 = place[order], point[order], d2[order]
    kept = np.arange(len(place)) - np.searchsorted(place, place) < k
    return place[kept], point[kept], d2[kept]


def _matrix(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table[n].cast(pa.float64()).to_numpy() for n in names], axis=1)


def _space(left: DataFrame, right: DataFrame, dims: tuple[str, ...]) -> Cuts:
    """Cuts of the space by a sample of both sides' places, drawn by a hash of the place."""
    places = left.select(*dims).unionByName(right.select(*dims)).dropna().withColumn("_h", F.xxhash64(*dims))
    n = places.agg(F.approx_count_distinct("_h")).first()[0]
    if n <= PART:
        return Cuts(np.zeros((0, len(dims))), SAMPLED)
    share = F.pmod("_h", F.lit(1 << 30)) < int((1 << 30) * SAMPLED / PART)
    return Cuts(_matrix(places.filter(share).drop("_h").distinct().toArrow(), list(dims)), SAMPLED)


def knn(left: DataFrame, right: DataFrame, k: int, reach: float, right_id: str, dims: tuple[str, ...] = ("x", "y", "z"), prefix: str = "r_") -> DataFrame:
    """The k nearest within ``reach``; ties to the lower id.

    Equal places of the left side ask once, and of equal places of the right side only the k lowest ids can be among the
    nearest.  A place learns a bound in its own part, then asks the parts that its ball meets; a part's answers are cut to k.
    """
    here, there = list(dims), [prefix + d for d in dims]
    space, limit, least = _space(left, right, dims), reach * reach, max(LEAF, 2 * k)
    part = StructField("_part", IntegerType())

    def dealt(df: DataFrame, names: list[str]) -> DataFrame:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                which, leaves = space.meet(_matrix(pa.Table.from_batches([batch]), names))
                number = np.zeros(batch.num_rows, np.int32)
                number[which] = leaves
                yield batch.append_column("_part", pa.array(number))

        return shipped(df).mapInArrow(deal, StructType([*df.schema, part]))

    def sorted_points(table: pa.Table) -> tuple[pa.Table, np.ndarray, Cuts]:
        table = table.take(pc.sort_indices(table, sort_keys=[(prefix + right_id, "ascending")], null_placement="at_start"))
        points = _matrix(table, there)
        return table, points, Cuts(points, least)

    def ask(places: pa.Table, rows: pa.Table) -> pa.Table:
        at, (_, points, cuts) = _matrix(places, here), sorted_points(rows)
        bound = np.minimum(bounds(cuts, points, at, k), limit)
        which, parts = space.meet(at, bound)
        return pa.table([*[pa.array(at[which, d]) for d in range(len(here))], pa.array(bound[which]), pa.array(parts)], names=asks.names)

    def answer(places: pa.Table, rows: pa.Table) -> pa.Table:
        at, (rows, points, cuts) = _matrix(places, here), sorted_points(rows)
        place, point, d2 = nearest(cuts, points, at, places["_bound"].to_numpy(), k)
        taken = rows.drop_columns("_part").take(pa.array(point))
        return pa.table([*[pa.array(at[place, d]) for d in range(len(here))], *taken.columns, pa.array(d2)], names=answers.names)

    q = left.select(*[F.col(c).cast("double").alias(c) for c in here]).dropna().distinct()
    first = F.row_number().over(Window.partitionBy(*there).orderBy(prefix + right_id))
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns]).dropna(subset=there).withColumn("_first", first).filter(F.col("_first") <= k).drop("_first")
    doubles = [StructField(c, DoubleType()) for c in here]
    asks = StructType([*doubles, StructField("_bound", DoubleType()), part])
    answers = StructType([*doubles, *r.schema, StructField("d2", DoubleType())])
    r = dealt(r, there)
    asked = dealt(q, here).groupBy("_part").cogroup(r.groupBy("_part")).applyInArrow(ask, asks)
    found = asked.groupBy("_part").cogroup(r.groupBy("_part")).applyInArrow(answer, answers)
    w = Window.partitionBy(*here).orderBy("d2", prefix + right_id)
    found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return left.join(found, here).select(*left.columns, *[prefix + c for c in right.columns], "d2", "rank")
