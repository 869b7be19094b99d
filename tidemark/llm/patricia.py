"""Patricia tries of sorted sequences: each range of them is read once, and the ranges' results are merged by key.

Sequences (of turns, or of letters) are dealt out by range, so that a partition holds neighbours; a very frequent prefix
is spread over as many ranges as it fills. One pass over a sorted range keeps the open points of the path it is on: the
root, branches and ends. A point is closed when the path leaves it, and gives an edge down from the point above.

Only nodes that lie on the path of two neighbouring ranges are seen by several of them: these, the spine, are given node
by node, each range with its share of the sums. All other edges are whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WorkTables


def in_ranges(sequences: DataFrame, key: str, work: WorkTables) -> DataFrame:
    """sequences with pid and kind, dealt out by pid and sorted by key: rows of a range have kind 0, between the last one of
    the range before (kind -1) and the first one of the range behind (kind 1), of which only the key is set."""
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.keep(sequences.repartitionByRange(parts, key).withColumn("pid", F.spark_partition_id()))
    ends = work.keep(dealt.groupBy("pid").agg(F.min(key).alias("low"), F.max(key).alias("high")))
    # One row for every range.
    beside = ends.withColumn("before", F.lag("high").over(Window.orderBy("pid"))).withColumn("behind", F.lead("low").over(Window.orderBy("pid")))
    border = lambda c, kind: beside.where(F.col(c).isNotNull()).select("pid", F.lit(kind).alias("kind"), F.col(c).alias(key))
    rows = dealt.withColumn("kind", F.lit(0)).unionByName(border("before", -1), allowMissingColumns=True).unionByName(border("behind", 1), allowMissingColumns=True)
    return rows.repartition(parts, "pid").sortWithinPartitions("pid", "kind", key)


@dataclass(slots=True)
class Point:
    """An open point; after closing, an edge that ends in it. Sums are over what the range holds below."""

    depth: int
    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    #: Weights of the turns of all members from here on, and of all nodes from here on.
    total: int = 0
    once: int = 0

    def absorb(self, below: Point, child: int) -> None:
        self.n += below.n
        self.leaves += below.leaves
        self.total += below.total
        self.once += below.once
        self.children += child
        if below.least is not None and (self.least is None or below.least < self.least):
            self.least = below.least


def shared(a, b) -> int:
    """The length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is common, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def compressed(rows: Iterable[tuple], start, step: Callable) -> Iterator[tuple]:
    """The edges of one sorted range of different sequences.

    rows: kind, sequence, weights, n, least, as in_ranges sorts them. Gives (whole, path, keys, top, point, weights): an edge
    of the nodes at depths top + 1 to point.depth of a path, complete (whole), or one node of the spine with this range's
    share. keys[d] names the path's node at depth d: keys[0] is start, and step makes a key of the one above and an
    element; without step there are no keys.
    """
    path, weights, keys, stack, before, outer = None, None, [start], [], None, 0

    def close(to: int, spine: int) -> Iterator[tuple]:
        while stack[-1].depth > to:
            p = stack.pop()
            top = max(stack[-1].depth, to)
            d, starts = p.depth, 0
            p.total += p.n * weights[d - 1]
            p.once += weights[d - 1] if d > outer else 0
            low = max(top, min(d, spine))
            if d > low:
                yield True, path, keys, low, p, weights
                rest = sum(weights[low : d - 1])
                p, d, starts = Point(d, p.n, p.least, 1, p.leaves, p.total + p.n * rest, p.once + rest), low, 1
                lift = True
            else:
                lift = False
            while d > top:
                if lift:
                    p = Point(d, p.n, p.least, starts, p.leaves, p.total + p.n * weights[d - 1], p.once + (weights[d - 1] if d > outer else 0))
                yield False, path, keys, d - 1, p, weights
                lift, starts, d = True, int(d > outer), d - 1
            if stack[-1].depth < top:
                stack.append(Point(top))
            stack[-1].absorb(p, starts)

    def left(common: int) -> None:
        """The path's end is a leaf if what follows doesn't go on from it."""
        if common < len(path) or not more:
            stack[-1].leaves += 1

    more = True
    for kind, sequence, weight, n, least in rows:
        if kind < 0:
            before = sequence
            continue
        if path is None:
            common, outer = 0, 0 if before is None else shared(before, sequence)
            stack.append(Point(0))
        else:
            common = shared(path, sequence)
            left(common)
            if kind > 0:
                yield from close(0, max(outer, common))
                break
            yield from close(common, outer)
            outer = min(outer, common)
        path, weights = sequence, weight
        if step:
            del keys[common + 1 :]
            for element in sequence[common:]:
                keys.append(step(keys[-1], element))
        if len(sequence) > stack[-1].depth:
            stack.append(Point(len(sequence)))
        stack[-1].absorb(Point(0, n, least), 0)
    else:
        more = False
        if path is not None:
            left(0)
            yield from close(0, outer)
    if path is not None:
        yield False, path, keys, -1, stack[0], weights
