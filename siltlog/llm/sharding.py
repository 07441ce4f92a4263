"""Shards of near-equal size from sampled splitters.

The sort key is (hash of the text, salted hash of the id, id), so equal texts lie next to each other, wherever in the input they are. A size-weighted
sample of group hashes gives quantile boundaries; rows are dealt to the ranges between them; ranges that hold more
than twice their share (a hot group) are subdivided by a salted hash of id and text. Exact byte totals of the ranges, prefix
sums over them and running sums inside each then put every row at its byte offset in key order, and shard ``k`` of
``n`` is the part of that order from ``k/n`` to ``(k+1)/n`` of all bytes: sizes differ by a row's size at most.
Only ids, sizes and hashes are shuffled (about 40 bytes a row); texts stay where they are.

Cases: null texts have size 1 and form one group; null ids are kept; repeated rows are told apart by their place in
the written key table; an empty table gives an empty result; other columns are dropped by name before any are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Ranges a shard, and sampled keys a range: the splitters are at most SHARDS x RANGES x SAMPLE longs on the driver.
RANGES, SAMPLE = 32, 32


def range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at or below key, by binary search in a literal array."""
    bits = max(1, len(splitters).bit_length())
    top = (1 << 63) - 1
    padded = F.lit([*splitters, *[top] * ((1 << bits) - len(splitters))])
    steps = F.lit([1 << b for b in reversed(range(bits))])
    found = F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get(padded, n + s - 1) <= key, n + s).otherwise(n))
    return F.least(found, F.lit(len(splitters)))


def weighted_splitters(keyed: DataFrame, key: str, size: str, row: str, ranges: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample of keys. A row's chance follows its size; one that is sure to be drawn stands for its size. The sample has ranges x SAMPLE rows or so, whatever the input."""
    total = keyed.agg(F.sum(size).alias("n")).first()["n"] or 0
    if not total:
        return []
    expected = F.col(size) * F.lit(ranges * SAMPLE / total)
    uniform = F.xxhash64(F.lit(29), row).bitwiseAND((1 << 30) - 1) / F.lit(float(1 << 30))
    drawn = keyed.where(uniform < expected).select(F.col(key).alias("k"), F.greatest(F.lit(1), expected.cast("long")).alias("w"))
    got = drawn.agg(F.expr(f"percentile(k, array({', '.join(str(i / ranges) for i in range(1, ranges))}), w)").alias("q")).first()["q"]
    return sorted({int(x) for x in got or []})


def shard_rows(df: DataFrame, id_col: str, text_col: str, shards: int, scratch: Scratch) -> DataFrame:
    """id_col, size, text_crc32, shard and slot (gapless from 0 in key order) of each row of df."""
    text, ranges = F.coalesce(F.col(text_col), F.lit("")), RANGES * shards
    keyed = scratch.keep(
        df.select(F.col(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 11).alias("h")).withColumn("row", F.monotonically_increasing_id()),
        "keyed",
    )
    splitters = weighted_splitters(keyed, "h", "size", "row", ranges)
    dealt = keyed.withColumn("range", range_of(F.col("h"), splitters) if splitters else F.lit(0))
    sums = dealt.groupBy("range").agg(F.sum("size").alias("held"))
    mean = F.sum("held").over(Window.partitionBy()) / F.lit(ranges)
    parts = sums.select("range", F.when(F.col("held") > 2 * mean, F.ceil(F.col("held") / mean)).otherwise(1).alias("subs"))
    dealt = dealt.join(F.broadcast(parts), "range").withColumn("sub", F.pmod(F.xxhash64(id_col, "h"), "subs"))
    order = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("range", "sub").agg(F.sum("size").alias("held"), F.count("*").alias("n"))
    bases = bases.select("range", "sub", F.coalesce(F.sum("held").over(order), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("range", "sub").orderBy("h", F.xxhash64(id_col, F.lit(7)), id_col, "row")
    middle = F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.expr("size div 2")
    placed = dealt.join(F.broadcast(bases), ["range", "sub"]).select(
        id_col, "size", "text_crc32", (F.col("before") + F.row_number().over(inside) - 1).alias("place"), F.least(F.expr(f"{shards - 1}L"), F.floor((middle - 1) * shards / F.col("total"))).cast("int").alias("shard")
    )
    placed = scratch.keep(placed, "placed")
    scratch.drop("keyed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(id_col, "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 8) -> DataFrame:
    """The law is ``bytes``: the shards' sizes are near equal."""
    out = shard_rows(docs, "doc_id", "text", shards, Scratch(spark, "shards"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
