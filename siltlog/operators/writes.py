"""From operations to log rows.

A batch is validated whole before anything is written; its operations get one contiguous run of sequence numbers in order,
so that the last operation on a key wins and a put after a range delete survives it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import RejectedError
from ..functions.keys import pad_or_cut
from .schema import DATA, LOG, RANGE, TOMBSTONE, Registry
from .scope import delete_bounds, is_empty_range


@dataclass
class WriteBatch:
    """Operations in order, over any families."""

    ops: list[tuple] = field(default_factory=list)

    def put(self, cf: str, key: bytes, value: bytes) -> WriteBatch:
        self.ops.append((DATA, cf, bytes(key), bytes(value)))
        return self

    def delete(self, cf: str, key: bytes) -> WriteBatch:
        self.ops.append((TOMBSTONE, cf, bytes(key), None))
        return self

    def delete_range(self, cf: str, start: bytes, end: bytes | None = None) -> WriteBatch:
        self.ops.append((RANGE, cf, bytes(start), None if end is None else bytes(end)))
        return self

    def __len__(self) -> int:
        return len(self.ops)


def plan_batch(batch: WriteBatch, registry: Registry) -> list[tuple]:
    """(kind, cf, key, value or end) of what is to be written: bad operations refuse the whole batch, empty ranges are left out."""
    out = []
    for kind, cf, key, more in batch.ops:
        spec = registry[cf]
        if kind == RANGE:
            start, end = delete_bounds(key, more, spec.width)
            if not is_empty_range(start, end):
                out.append((RANGE, cf, start, end))
        elif not spec.admits(key):
            raise RejectedError(f"a key of {len(key)} bytes is not one of {cf}")
        else:
            out.append((kind, cf, key, more))
    return out


def batch_rows(spark: SparkSession, planned: list[tuple], base_lsn: int, batch_id: int, segment_id: int, pack: Callable[[str, bytes], tuple[bytes, int]] | None = None) -> DataFrame:
    """``pack`` gives what is stored for a family's value, and its codec."""
    rows = []
    for i, (kind, cf, key, more) in enumerate(planned):
        value, codec = (more if kind == DATA else None), 0
        if value is not None and pack is not None:
            value, codec = pack(cf, value)
        stored = len((value if kind == DATA else more) or b"")  # of a range delete, the bytes of its end
        rows.append((cf, bytearray(key), base_lsn + i, kind, None if kind != RANGE or more is None else bytearray(more), None if value is None else bytearray(value), stored, codec, zlib.crc32(value or b""), False, batch_id, segment_id))
    return spark.createDataFrame(rows, LOG)


def log_frame(df: DataFrame) -> DataFrame:
    """Any frame with cf, k, lsn, kind and v (and range_end, segment_id) as a log, with lengths and checksums from v."""
    has = lambda c, kind, other: F.col(c).cast(kind) if c in df.columns else other
    end = has("range_end", "binary", F.lit(None).cast("binary"))
    kind = F.col("kind").cast("byte")
    value = F.when(kind == DATA, F.col("v"))
    stored = F.when(kind == DATA, F.coalesce(F.octet_length("v"), F.lit(0))).when(kind == RANGE, F.coalesce(F.octet_length(end), F.lit(0))).otherwise(0)
    return df.select(
        F.col("cf"), F.col("k"), F.col("lsn").cast("long").alias("lsn"), kind.alias("kind"), end.alias("range_end"), value.alias("v"), stored.cast("int").alias("len"), has("codec", "byte", F.lit(0).cast("byte")).alias("codec"),
        F.crc32(F.coalesce(value, F.lit(b""))).alias("crc"), has("relocated", "boolean", F.lit(False)).alias("relocated"), has("batch_id", "long", F.col("lsn").cast("long")).alias("batch_id"), has("segment_id", "int", F.lit(1)).alias("segment_id"),
    )


def invalid(registry: Registry) -> Column:
    """Whether a family doesn't admit a row of a log: unknown family, key width, kind, or a null where none may be."""
    known = F.col("cf").isin([f.name for f in registry.families])
    widths = F.lit(False)
    for f in registry.families:
        size = F.octet_length("k")
        widths |= (F.col("cf") == f.name) & ((size != f.width) if f.width is not None else size > 1056) & (F.col("kind") != RANGE)
    bad_kind = ~F.col("kind").isin(DATA, TOMBSTONE, RANGE) | ((F.col("kind") == DATA) & F.col("v").isNull()) | ((F.col("kind") != RANGE) & F.col("range_end").isNotNull())
    return ~F.coalesce(known, F.lit(False)) | F.col("k").isNull() | widths | F.coalesce(bad_kind, F.lit(True))


def invalid_rows(df: DataFrame, registry: Registry) -> DataFrame:
    return df.where(invalid(registry))


def bounded(df: DataFrame, registry: Registry) -> DataFrame:
    """df with the bounds of range deletes padded or cut to fixed widths, and without those that hold nothing."""
    if "range_end" not in df.columns:
        return df
    for f in registry.families:
        if f.width is not None:
            mine = (F.col("cf") == f.name) & (F.col("kind") == RANGE)
            for c in ("k", "range_end"):
                df = df.withColumn(c, F.when(mine, pad_or_cut(F.col(c), f.width)).otherwise(F.col(c)))
    return df.where((F.col("kind") != RANGE) | F.col("range_end").isNull() | (F.col("k") < F.col("range_end")))


def numbered(staged: DataFrame, base: int) -> DataFrame:
    """``staged``, written with its range ``part`` and place ``nth`` inside it by ``in_order``, with contiguous lsns from base."""
    sums = staged.groupBy("part").count()
    before = sums.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return staged.join(F.broadcast(before), "part").withColumn("lsn", F.lit(base) + F.col("before") + F.col("nth") - 1).drop("part", "nth", "before")


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """df range-sorted by order, with the range of each row and its place there: write this, then call ``numbered``."""
    dealt = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    return dealt.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
