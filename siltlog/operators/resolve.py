"""The live view: the newest version of each key that no delete hides.

One partial and one final aggregation on (cf, k) pick the newest version; key predicates reach the scan below it, since k is
a grouping key. Range deletes hide by an anti-join: each against each row while they are few, counted; else by pieces of the keyspace.
For lookups of many keys, ``narrowed`` puts the keys below the aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pieces import Pieces, outline
from .schema import DATA, RANGE, TOMBSTONE

#: Range deletes up to BROADCAST_COVERS are held against each row, up to LISTED_COVERS read once and broadcast by pieces.
BROADCAST_COVERS, LISTED_COVERS = 256, 100_000
#: Keys asked for up to BROADCAST_KEYS are broadcast, up to LISTED_KEYS written into the plan.
BROADCAST_KEYS, LISTED_KEYS = 100_000, 256
CARRIED = ("kind", "v", "len", "segment_id")


def visible(log: DataFrame, as_of: int | None) -> DataFrame:
    return log if as_of is None else log.where(F.col("lsn") <= as_of)


def covers_of(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """cf, start, end (null: no end) and lsn of the range deletes that hold anything."""
    held = visible(log, as_of).where((F.col("kind") == RANGE) & (F.col("range_end").isNull() | (F.col("k") < F.col("range_end"))))
    return held.select("cf", F.col("k").alias("start"), F.col("range_end").alias("end"), "lsn")


def newest(log: DataFrame, as_of: int | None = None, carry: tuple[str, ...] = CARRIED) -> DataFrame:
    """The newest point version of each (cf, k), tombstones included. Of copies of one version, a relocated one is taken."""
    points = visible(log, as_of).where(F.col("kind") != RANGE)
    carried = [c for c in carry if c in log.columns]
    order = F.col("lsn") * 2 + F.coalesce("relocated", F.lit(False)).cast("int") if "relocated" in log.columns else F.col("lsn")
    # a column each: what isn't asked for is pruned, payloads before all, and numbers alone are aggregated by hash without a sort
    return points.groupBy("cf", "k").agg(F.max("lsn").alias("lsn"), *(F.max_by(c, order).alias(c) for c in carried))


def _hides(rows: str, covers: str) -> Column:
    c = lambda x: F.col(f"{covers}.{x}")
    k, lsn = F.col(f"{rows}.k"), F.col(f"{rows}.lsn")
    return (c("cf") == F.col(f"{rows}.cf")) & (c("lsn") > lsn) & (k >= c("start")) & (c("end").isNull() | (k < c("end")))


def joined_with_covers(rows: DataFrame, covers: DataFrame, how: str, few: bool | None = None) -> DataFrame:
    """rows (cf, k, lsn, ...) semi- or anti-joined with the covers that hide them.

    Beyond BROADCAST_COVERS the join is an equi-join on pieces of the keyspace (see ``pieces``). Up to LISTED_COVERS, the covers' outline is
    broadcast: a row meets the few disjoint ranges of its piece, where it stands. Beyond, the join shuffles and spills: a row meets the covers
    that end in its piece, and the largest number of those that lie over all of it.
    """
    if few is None:
        n = covers.count()
        few = n <= BROADCAST_COVERS
    else:
        n = 0 if few else covers.count()
    if few:
        return rows.alias("r").join(F.broadcast(covers.alias("c")), _hides("r", "c"), how)
    if n <= LISTED_COVERS:
        by_cf: dict[str, list] = {}
        for r in covers.select("cf", "start", "end", "lsn").collect():
            by_cf.setdefault(r["cf"], []).append((bytes(r["start"]), None if r["end"] is None else bytes(r["end"]), r["lsn"]))
        lines = {cf: outline(found) for cf, found in by_cf.items()}
        starts = [start for line in lines.values() for start, _, _ in line]
        pieces = Pieces(starts, len(starts))
        cut = [(cf, piece, bytearray(start), None if end is None else bytearray(end), lsn) for cf, line in lines.items() for piece, start, end, lsn in pieces.dealt(line)]
        dealt = F.broadcast(rows.sparkSession.createDataFrame(cut, "cf string, piece int, start binary, end binary, lsn long"))
        return rows.withColumn("piece", pieces.of(F.col("k"))).alias("r").join(dealt.alias("c"), (F.col("r.piece") == F.col("c.piece")) & _hides("r", "c"), how).drop("piece")
    pieces = Pieces(covers, n)
    partly = covers.withColumn("piece", F.explode(pieces.ends(F.col("start"), F.col("end")))).select("cf", "piece", "start", "end", "lsn")
    whole = covers.select("cf", "lsn", F.explode(pieces.nodes(F.col("start"), F.col("end"))).alias("node")).groupBy("cf", "node").agg(F.max("lsn").alias("lsn"))
    leaves = rows.sparkSession.range(len(pieces.cuts) + 1).select(F.col("id").cast("int").alias("piece"))
    over = leaves.withColumn("node", F.explode(pieces.above(F.col("piece")))).join(whole, "node").groupBy("cf", "piece").agg(F.max("lsn").alias("lsn"))
    nothing = F.lit(None).cast("binary")
    dealt = partly.unionByName(over.select("cf", "piece", F.lit(b"").alias("start"), nothing.alias("end"), "lsn"))
    return rows.withColumn("piece", pieces.of(F.col("k"))).alias("r").join(dealt.alias("c"), (F.col("r.piece") == F.col("c.piece")) & _hides("r", "c"), how).drop("piece")


def resolve(log: DataFrame, as_of: int | None = None, carry: tuple[str, ...] = CARRIED, covers: DataFrame | None = None, few: bool | None = None) -> DataFrame:
    """cf, k, lsn and the carried columns of every live key, at the end of the log or as of a sequence number.

    As of S, versions and range deletes beyond S are ignored alike, and range deletes up to S apply.
    """
    best = newest(log, as_of, tuple(dict.fromkeys(("kind", *carry)))).where(F.col("kind") == DATA)
    hidden = covers_of(log, as_of) if covers is None else covers
    return joined_with_covers(best, hidden, "left_anti", few).drop("kind")


def narrowed(log: DataFrame, cf: str, keys: DataFrame | Sequence[bytes], n: int | None = None) -> DataFrame:
    """What lookups of keys (a list, or a frame k of ``n``) in a family need of the log: the versions of these keys, and the range deletes.

    Up to LISTED_KEYS listed ones are a predicate that reaches the scan; more are semi-joined, by a broadcast while they are few.
    """
    mine = log.where(F.col("cf") == cf)
    if not isinstance(keys, DataFrame):
        if len(keys) <= LISTED_KEYS:
            return mine.where((F.col("kind") == RANGE) | F.col("k").isin([bytearray(k) for k in dict.fromkeys(keys)]))
        keys, n = log.sparkSession.createDataFrame([(bytearray(k),) for k in keys], "k binary"), len(keys)
    asked = keys.select("k").distinct()
    points = mine.where(F.col("kind") != RANGE).join(F.broadcast(asked) if n is not None and n <= BROADCAST_KEYS else asked, "k", "left_semi")
    return points.select(*log.columns).unionByName(mine.where(F.col("kind") == RANGE))


def hidden_by_covers(log: DataFrame, as_of: int | None = None, few: bool | None = None) -> DataFrame:
    """The newest data versions that a range delete hides."""
    best = newest(log, as_of).where(F.col("kind") == DATA)
    return joined_with_covers(best, covers_of(log, as_of), "left_semi", few)


def versions(log: DataFrame) -> DataFrame:
    """Every point version with the lsn of the next one of its key, null for the newest."""
    order = Window.partitionBy("cf", "k").orderBy("lsn")
    return log.where(F.col("kind") != RANGE).withColumn("superseded_at", F.lead("lsn").over(order))


def graves(log: DataFrame) -> DataFrame:
    """Keys whose newest version is a point delete."""
    return newest(log, carry=("kind",)).where(F.col("kind") == TOMBSTONE)
