"""Rewriting segments: what is copied, what is carried, what goes; and clustering into a key index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import is_purged
from .pieces import Pieces, listed
from .resolve import BROADCAST_COVERS, LISTED_COVERS, newest, resolve
from .schema import DATA, RANGE, TOMBSTONE, Registry


def _of(log: DataFrame, segments: list[int]) -> DataFrame:
    return log.where(F.col("segment_id").isin(segments))


def purged(registry: Registry, floor: int) -> Column:
    """Whether a row's purge mark is below the floor; 0 purges nothing, and families without a mark keep all."""
    out = F.lit(False)
    if floor:
        for f in registry.families:
            if f.purge_at is not None:
                out |= (F.col("cf") == f.name) & is_purged(F.col("k"), f.purge_at, floor)
    return out


def live_copies(log: DataFrame, segments: list[int], registry: Registry | None = None, floor: int = 0, live: DataFrame | None = None) -> DataFrame:
    """The data records of these segments that the live view still resolves to, with their lsn, marked as relocated."""
    live = resolve(log, carry=("segment_id",)) if live is None else live
    marks = live.where(F.col("segment_id").isin(segments)).select("cf", "k", "lsn")
    rows = _of(log, segments).where(F.col("kind") == DATA)
    kept = rows.join(marks, ["cf", "k", "lsn"], "left_semi").select(*log.columns)
    if registry is not None and floor:
        kept = kept.where(~purged(registry, floor))
    return kept.withColumn("relocated", F.lit(True)) if "relocated" in log.columns else kept


def ranges_over_older(ranges: DataFrame, data: DataFrame, few: bool | None = None) -> DataFrame:
    """cf, k and lsn of those range deletes (cf, k, range_end, lsn) within which data (cf, k, lsn) has an older version.

    Of each key, only its oldest version is asked. Up to BROADCAST_COVERS ranges meet each key. Beyond, a range that holds pieces of the
    keyspace whole asks for the least number there; only the pieces of its ends are searched, where the keys stand up to LISTED_COVERS ranges.
    """
    data = data.groupBy("cf", "k").agg(F.min("lsn").alias("lsn"))
    asked = ranges.select("cf", F.col("k").alias("start"), F.col("range_end").alias("end"), "lsn").distinct()
    n = asked.count() if few is None or not few else 0
    within = (F.col("o.lsn") < F.col("r.lsn")) & (F.col("o.k") >= F.col("r.start")) & (F.col("r.end").isNull() | (F.col("o.k") < F.col("r.end")))
    names = [F.col("r.cf").alias("cf"), F.col("r.start").alias("k"), F.col("r.lsn").alias("lsn")]
    if few or few is None and n <= BROADCAST_COVERS:
        return data.alias("o").join(F.broadcast(asked.alias("r")), (F.col("r.cf") == F.col("o.cf")) & within).select(*names).distinct()
    here = n <= LISTED_COVERS
    asked = listed(asked) if here else asked
    pieces = Pieces(asked, n)
    placed = data.withColumn("piece", pieces.of(F.col("k")))
    least = placed.groupBy("cf", "piece").agg(F.min("lsn").alias("least")).withColumn("node", F.explode(pieces.above(F.col("piece")))).groupBy("cf", "node").agg(F.min("least").alias("least"))
    over = asked.withColumn("node", F.explode(pieces.nodes(F.col("start"), F.col("end")))).join(least, ["cf", "node"]).where("least < lsn").select("cf", F.col("start").alias("k"), "lsn")
    parts = asked.withColumn("piece", F.explode(pieces.ends(F.col("start"), F.col("end"))))
    same = (F.col("r.cf") == F.col("o.cf")) & (F.col("r.piece") == F.col("o.piece")) & within
    met = placed.alias("o").join(F.broadcast(parts.alias("r")), same).select(*names) if here else parts.alias("r").join(placed.alias("o"), same, "left_semi").select(*names)
    return over.union(met).distinct()


def carried_tombstones(log: DataFrame, segments: list[int], key_runs: bool = False) -> DataFrame:
    """The point and range deletes of these segments that must be copied.

    A point delete is carried while another segment holds an older version of its key, and is dropped if its key has a
    newer version. A range delete is carried while another segment holds older data within it, or while there are key runs.
    """
    own, other = _of(log, segments), log.where(~F.col("segment_id").isin(segments) & (F.col("kind") == DATA)).select("cf", "k", "lsn")
    oldest = other.groupBy("cf", "k").agg(F.min("lsn").alias("oldest"))
    top = newest(log, carry=("kind",)).select("cf", "k", F.col("lsn").alias("top"))
    points = own.where(F.col("kind") == TOMBSTONE)
    points = points.join(top, ["cf", "k"], "left").where(F.col("top") <= F.col("lsn")).join(oldest, ["cf", "k"], "left").where(F.col("oldest") < F.col("lsn")).select(*log.columns)
    ranges = own.where(F.col("kind") == RANGE)
    if not key_runs:
        ranges = ranges.join(ranges_over_older(ranges, other), ["cf", "k", "lsn"], "left_semi").dropDuplicates(["cf", "k", "lsn"]).select(*log.columns)
    both = points.unionByName(ranges)
    return both.withColumn("relocated", F.lit(True)) if "relocated" in log.columns else both


def rewritten(log: DataFrame, segments: list[int], registry: Registry | None = None, floor: int = 0, key_runs: bool = False) -> DataFrame:
    """What replaces these segments; empty if nothing of them is needed. Current reads don't change, but for what is purged."""
    return live_copies(log, segments, registry, floor).unionByName(carried_tombstones(log, segments, key_runs))


def clustered(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by (cf, k, lsn), newest first: files that hold disjoint key ranges."""
    dealt = rows.repartitionByRange(partitions, "cf", "k") if partitions else rows.repartitionByRange("cf", "k")
    return dealt.sortWithinPartitions("cf", "k", F.col("lsn").desc())


def key_merge(log: DataFrame, segments: list[int]) -> DataFrame:
    """The newest row of each key over these segments (cf, k, lsn, kind, segment_id), and how many older ones it shadows."""
    each = _of(log, segments).where(F.col("kind") != RANGE).groupBy("cf", "k", "lsn").agg(F.max(F.struct("kind", "segment_id")).alias("best"))
    best = each.groupBy("cf", "k").agg(F.max("lsn").alias("lsn"), F.max_by("best", "lsn").alias("best"), (F.count("*") - 1).alias("shadowed"))
    return best.select("cf", "k", "lsn", "best.kind", "best.segment_id", "shadowed")


def merge_candidates(runs: list[tuple[int, int]], depth: int, most: int = 8, factor: int = 2) -> list[int]:
    """Which key runs (id, size) to merge: none while no more than ``most`` spans overlap; else smallest first, while each is at most ``factor`` times the pile before it."""
    if depth <= most:
        return []
    picked, pile = [], 0
    for run, size in sorted(runs, key=lambda x: (x[1], x[0])):
        if pile and size > factor * pile:
            break
        picked.append(run)
        pile += size
    return picked if len(picked) > 1 else []
