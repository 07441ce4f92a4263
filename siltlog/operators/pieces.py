"""Many key ranges against many keys: the keyspace is cut at quantiles of the ranges' starts into numbered pieces.

A range lies whole over a run of pieces and in part over the two at its ends. Only the ends are dealt to their pieces as they are; the run
is split into nodes of a binary tree over the pieces, of which there are at most two a level, and only one figure (a largest or least
sequence number) is kept for each node. So a wide range costs some rows, not one a piece, and a key meets the few ranges that end in its
own piece and one figure for all that lie over it.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that start in a piece, about, and the most pieces.
EACH, MOST = 16, 4096


def listed(rows: DataFrame) -> DataFrame:
    """The same rows, read once and kept by the driver: for few of them."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def outline(ranges: Sequence[tuple[bytes, bytes | None, int]]) -> list[tuple[bytes, bytes | None, int]]:
    """Disjoint ranges in order, each with the largest number of those ranges (start, end: None for none, number) that lie over it."""
    points = sorted({p for start, end, _ in ranges for p in (start, end) if p is not None})
    waiting, open_, out = sorted(ranges, key=lambda r: r[0], reverse=True), [], []
    for i, point in enumerate(points):
        while waiting and waiting[-1][0] <= point:
            _, end, number = waiting.pop()
            heapq.heappush(open_, (-number, end is None, end or b""))
        while open_ and not open_[0][1] and open_[0][2] <= point:
            heapq.heappop(open_)
        if open_:
            until, number = points[i + 1] if i + 1 < len(points) else None, -open_[0][0]
            if out and out[-1][1] == point and out[-1][2] == number:
                out[-1] = (out[-1][0], until, number)
            else:
                out.append((point, until, number))
    return out


class Pieces:
    """Pieces for ``ranges`` (start, end: null for none; ``n`` of them): piece i holds keys from cut i - 1, included, to cut i."""

    def __init__(self, ranges: DataFrame | Sequence[bytes], n: int, start: str = "start"):
        """``ranges`` may be the list of their starts."""
        wanted = min(MOST, 1 << max(1, math.ceil(math.log2(max(2, n / EACH)))))
        if isinstance(ranges, DataFrame):
            sample = ranges.select(F.col(start).alias("s")).distinct().orderBy(F.xxhash64("s")).limit(8 * wanted)
            starts = sorted(bytes(r[0]) for r in sample.collect())
        else:
            starts = sorted(set(ranges))
        step = max(1, len(starts) // wanted)
        self.cuts = starts[step::step]
        self.size = 1 << len(self.cuts).bit_length()  # leaves of the tree: more than there are cuts
        # one literal, of hex digits, which sort as the bytes do: a literal a cut makes plans slow to analyse
        self.held = F.split(F.lit(",".join(c.hex().upper() for c in self.cuts)), ",") if self.cuts else F.array().cast("array<string>")

    def of(self, key: Column) -> Column:
        """The number of a key's piece."""
        steps = [1 << b for b in reversed(range(max(1, len(self.cuts).bit_length())))]
        return F.aggregate(F.lit(steps), F.lit(0), lambda n, s: F.when(F.coalesce(F.get(self.held, n + s - 1) <= F.hex(key), F.lit(False)), n + s).otherwise(n))

    def dealt(self, ranges: Sequence[tuple[bytes, bytes | None, int]]) -> list[tuple[int, bytes, bytes | None, int]]:
        """Disjoint ranges with the number of their piece, cut where they cross from one into the next."""
        out = []
        for start, end, number in ranges:
            first, last = bisect_right(self.cuts, start), len(self.cuts) if end is None else bisect_left(self.cuts, end)
            for piece in range(first, last + 1):
                out.append((piece, start if piece == first else self.cuts[piece - 1], end if piece == last else self.cuts[piece], number))
        return out

    def last_of(self, end: Column) -> Column:
        return F.when(end.isNull(), F.lit(len(self.cuts))).otherwise(self.of(end))

    def ends(self, start: Column, end: Column) -> Column:
        """The pieces that a range may hold in part."""
        return F.array_distinct(F.array(self.of(start), self.last_of(end)))

    def nodes(self, start: Column, end: Column) -> Column:
        """The tree's nodes that make up the pieces which a range holds whole."""

        def up(s: Column, _: Column) -> Column:
            a, b = s["a"], s["b"]
            odd_a, odd_b = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
            none = F.array().cast("array<int>")
            taken = F.concat(s["nodes"], F.when(odd_a, F.array(a)).otherwise(none), F.when(odd_b & (b - 1 >= a + odd_a.cast("int")), F.array(b - 1)).otherwise(none))
            half = lambda x: F.shiftright(x, 1).cast("int")
            return F.struct(half(a + odd_a.cast("int")).alias("a"), half(b - odd_b.cast("int")).alias("b"), taken.alias("nodes"))

        first = F.struct((self.of(start) + 1 + self.size).cast("int").alias("a"), (self.last_of(end) + self.size).cast("int").alias("b"), F.array().cast("array<int>").alias("nodes"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.size.bit_length())), first, up)["nodes"]

    def above(self, piece: Column) -> Column:
        """The nodes over a piece, itself the first."""
        return F.transform(F.sequence(F.lit(0), F.lit(self.size.bit_length() - 1)), lambda j: F.floor((piece + self.size) / F.pow(F.lit(2.0), j)).cast("int"))
