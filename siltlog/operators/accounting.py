"""What a log's segments hold: live, dead and tombstone bytes, spans, overlap, and what may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import dead_fraction, droppable, record_span
from .resolve import covers_of, graves, resolve
from .schema import DATA

# The reclaimable share from which a segment is rewritten, that of the escalated tier and how far the tier must
# fall to be left, the least share of a throttled writer, and the reserves over which it falls.
BASE_RATIO, ESCALATED_RATIO, RELEASE, LEAST_THROTTLE, BAND = 0.50, 0.20, 0.75, 0.05, 8


def located(log: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """The log's rows with ``is_live``: whether the live view still resolves to this very version."""
    live = resolve(log, carry=("segment_id",)) if live is None else live
    marks = live.select("cf", "k", "lsn", F.col("segment_id").alias("segment_id"), F.lit(True).alias("is_live"))
    rows = log.join(marks, ["cf", "k", "lsn", "segment_id"], "left")
    return rows.withColumn("is_live", F.coalesce("is_live", F.lit(False)) & (F.col("kind") == DATA))


def segment_bytes(log: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """segment_id, live (tombstones included), dead, held (tombstones' bytes), held_lsn, min_lsn, max_lsn and records of each segment."""
    rows = located(log, live).withColumn("span", record_span(F.col("k"), F.col("len")).cast("long"))
    data, total = F.col("kind") == DATA, lambda c: F.coalesce(F.sum(F.when(c, F.col("span"))), F.lit(0))
    return rows.groupBy("segment_id").agg(
        total(F.col("is_live") | ~data).alias("live"),
        total(data & ~F.col("is_live")).alias("dead"),
        total(~data).alias("held"),
        F.max(F.when(~data, F.col("lsn"))).alias("held_lsn"),
        F.min("lsn").alias("min_lsn"),
        F.max("lsn").alias("max_lsn"),
        F.count("*").alias("records"),
    )


def floors_excluding(segments: DataFrame) -> DataFrame:
    """segments with ``floor``: the least min_lsn of all *other* segments, null if there is none.

    The two smallest marks of the whole list suffice, and are one row, so that no window over all segments is needed.
    """
    two = segments.agg(F.min(F.struct("min_lsn", "segment_id")).alias("a"))
    second = segments.join(F.broadcast(two), segments["segment_id"] != F.col("a.segment_id")).agg(F.min("min_lsn").alias("b"))
    one = two.select(F.col("a.segment_id").alias("least"), F.col("a.min_lsn").alias("a")).join(F.broadcast(second), F.lit(True), "left")
    return segments.join(F.broadcast(one), F.lit(True), "left").withColumn("floor", F.when(F.col("segment_id") == F.col("least"), F.col("b")).otherwise(F.col("a"))).drop("least", "a", "b")


def ranked(segments: DataFrame) -> DataFrame:
    """segments with floor, droppable, reclaimable, dead_fraction and the share of all bytes that a rewrite would give back."""
    rows = floors_excluding(segments)
    drop = droppable(F.col("held"), F.col("held_lsn"), F.col("floor"))
    rows = rows.withColumn("droppable", drop).withColumn("reclaimable", F.col("dead") + F.col("droppable"))
    whole = (F.col("live") + F.col("dead")).cast("double")
    return rows.withColumn("dead_fraction", dead_fraction(F.col("dead"), F.col("live"))).withColumn("fraction", F.coalesce(F.try_divide(F.col("reclaimable").cast("double"), whole), F.lit(0.0)))


def gated(rows: DataFrame, held_floor: int | None) -> DataFrame:
    """Without segments that a held snapshot may still read: those whose oldest version is at or below it."""
    return rows if held_floor is None else rows.where(F.col("min_lsn") > held_floor)


def select_target(segments: DataFrame, ratio: float = BASE_RATIO, held_floor: int | None = None) -> DataFrame:
    """The segment with the largest reclaimable share at or above ratio, ties to the smaller id: one row or none."""
    rows = gated(ranked(segments), held_floor).where((F.col("fraction") >= ratio) & (F.col("reclaimable") > 0))
    return rows.orderBy(F.col("fraction").desc(), "segment_id").limit(1)


def whole_dead(segments: DataFrame, held_floor: int | None = None) -> DataFrame:
    return gated(ranked(segments), held_floor).where(F.col("fraction") >= 1.0)


def key_spans(log: DataFrame) -> DataFrame:
    """cf, segment_id, low and high key of each family in each segment."""
    return log.groupBy("cf", "segment_id").agg(F.min("k").alias("low"), F.max("k").alias("high"))


def overlapping(spans: DataFrame, low: Column, high: Column) -> DataFrame:
    """Segments whose closed span meets [low, high]."""
    return spans.where((F.col("low") <= high) & (F.col("high") >= low))


def overlap_depth(spans: DataFrame, key_runs: int = 0) -> DataFrame:
    """The largest number of closed spans of one family that stand over a key, and one more for each key run.

    A sweep: at equal points starts come before ends, so that touching spans overlap. There is a row for each segment, not for each key.
    """
    ends = spans.select("cf", F.col("low").alias("at"), F.lit(1).alias("step")).unionAll(spans.select("cf", "high", F.lit(-1)))
    order = Window.partitionBy("cf").orderBy("at", F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    depth = ends.withColumn("depth", F.sum("step").over(order))
    return depth.agg((F.coalesce(F.max("depth"), F.lit(0)) + key_runs).alias("depth"))


def sealed_spans(log: DataFrame) -> DataFrame:
    return log.groupBy("cf").agg(F.count_distinct("segment_id").alias("sealed_segments"))


def standing(log: DataFrame) -> DataFrame:
    """One row: the number of point deletes that are their key's newest version, and of range deletes."""
    return graves(log).agg(F.count("*").alias("graves")).join(covers_of(log).agg(F.count("*").alias("covers")), F.lit(True))


def dead_runs(log: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """segment_id, first and last lsn, records and bytes of each unbroken run of dead data records, in lsn order."""
    rows = located(log, live).withColumn("gone", (F.col("kind") == DATA) & ~F.col("is_live"))
    inside = Window.partitionBy("segment_id").orderBy("lsn")
    rows = rows.withColumn("island", F.row_number().over(inside) - F.row_number().over(Window.partitionBy("segment_id", "gone").orderBy("lsn")))
    span = record_span(F.col("k"), F.col("len")).cast("long")
    return rows.where("gone").groupBy("segment_id", "island").agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.count("*").alias("records"), F.sum(span).alias("bytes")).drop("island")


def move_ratio(rewritten: int, unlinked: int) -> float:
    """Segments that were copied, of all that went."""
    return rewritten / (rewritten + unlinked) if rewritten + unlinked else 0.0


def pressure_tier(dead_share: float, was_escalated: bool, ingest_is_hot: bool = False, soft: float = ESCALATED_RATIO) -> str:
    """escalated from ``soft`` of dead bytes on until they fall below three quarters of it; else deferred while ingest is hot, or relaxed."""
    if dead_share >= soft * (RELEASE if was_escalated else 1):
        return "escalated"
    return "deferred" if ingest_is_hot else "relaxed"


def effective_ratio(base: float, tier: str) -> float:
    return min(base, ESCALATED_RATIO) if tier == "escalated" else base


def foreground_throttle(used: int, capacity: int, reserve: int) -> float:
    """A writer's share of its pace: whole until BAND reserves below the ceiling, LEAST_THROTTLE at it, in a line between. No capacity is no ceiling."""
    if not capacity:
        return 1.0
    top = max(0, capacity - reserve)
    bottom = max(0, top - BAND * reserve)
    if used >= top:
        return LEAST_THROTTLE
    return 1.0 if used <= bottom or not reserve else 1.0 - (1.0 - LEAST_THROTTLE) * (used - bottom) / (BAND * reserve)


def admits(used: int, asked: int, capacity: int, reserve: int) -> bool:
    return not capacity or used + asked <= max(0, capacity - reserve)


def draw_volume(free: list[int], kinds: list[str], dead: list[bool], kind: str, watermark: int, pinned: int | None = None) -> int:
    """The pinned root if it has the watermark free; else of the live roots of this kind the one with most free above the watermark, else with most free; else the first."""
    if pinned is not None and free[pinned] >= watermark:
        return pinned
    choice = [(bytes_ >= watermark, bytes_, -place) for place, bytes_ in enumerate(free) if kinds[place] == kind and not dead[place]]
    return -max(choice)[2] if choice else 0


def output_kind(source: str, has_capacity: bool, segments_behind: int, segment_bytes: int, demote_after: int | None) -> str:
    """Where a rewrite of a segment goes: fast segments are demoted once enough was written after them."""
    if source == "capacity":
        return "capacity"
    if not has_capacity or demote_after is None:
        return "fast"
    return "capacity" if segments_behind * segment_bytes >= demote_after else "fast"
