"""Bounds on keys, as predicates that reach the Parquet scan.

A prefix is written as a range: ``>=`` and ``<`` on binary columns are pushed down, ``startswith`` is not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.keys import MAX_KEY, pad_or_cut_bytes, successor


@dataclass(frozen=True)
class Scope:
    """low <= key, and key < high, or <= high if high is inclusive; None is no bound."""

    low: bytes | None = None
    high: bytes | None = None
    high_inclusive: bool = False

    @staticmethod
    def everything() -> Scope:
        return Scope()

    @staticmethod
    def prefix(prefix: bytes) -> Scope:
        return Scope(prefix or None, successor(prefix) if prefix else None)

    @staticmethod
    def range(start: bytes, end: bytes) -> Scope:
        return Scope(start, end)

    @staticmethod
    def from_key(start: bytes, ascending: bool = True) -> Scope:
        """Inclusive in either direction."""
        return Scope(low=start) if ascending else Scope(high=start, high_inclusive=True)

    @staticmethod
    def after(mark: bytes, within: Scope | None = None) -> Scope:
        """What follows mark: the least key above it is itself and a zero byte."""
        within = within or Scope()
        low = mark + b"\0"
        return Scope(low if within.low is None else max(low, within.low), within.high, within.high_inclusive)

    def start_bound(self) -> bytes | None:
        """Where a scan begins; a start wider than any key is cut to what a key can hold, as no key lies between."""
        return None if self.low is None else self.low[: MAX_KEY + 1]

    def locate(self, key: bytes) -> str:
        """before, inside or past, in ascending order."""
        if self.low is not None and key < self.low:
            return "before"
        if self.high is not None and (key > self.high if self.high_inclusive else key >= self.high):
            return "past"
        return "inside"

    def __call__(self, key: Column) -> Column:
        tests = []
        if self.low is not None:
            tests.append(key >= F.lit(self.start_bound()))
        if self.high is not None:
            tests.append(key <= F.lit(self.high) if self.high_inclusive else key < F.lit(self.high))
        out = tests[0] if tests else F.lit(True)
        for t in tests[1:]:
            out &= t
        return out

    def locate_column(self, key: Column) -> Column:
        before = key < F.lit(self.low) if self.low is not None else F.lit(False)
        past = F.lit(False) if self.high is None else key > F.lit(self.high) if self.high_inclusive else key >= F.lit(self.high)
        return F.when(before, "before").when(past, "past").otherwise("inside")


def delete_bounds(start: bytes, end: bytes | None, width: int | None) -> tuple[bytes, bytes | None]:
    """A range delete's bounds; on a family of fixed width they are padded or cut to it, unlike those of a range scan."""
    if width is None:
        return start, end
    return pad_or_cut_bytes(start, width), None if end is None else pad_or_cut_bytes(end, width)


def is_empty_range(start: bytes, end: bytes | None) -> bool:
    return end is not None and start >= end
