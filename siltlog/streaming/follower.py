"""Following a store as a stream.

What streams is the store's manifests: each is published whole, and names what counts. A micro-batch reads the segments that the newest
manifest lists and the state hasn't seen, never strays, unpublished files or retired ones. The state is a small log itself: the newest
version of each key, tombstones included, and the range deletes. New rows are joined to it and reduced again, which doesn't depend on the
order of arrival: newest wins by sequence number, and standing range deletes are held against late records. Point and range deletes go
once they are WINDOW numbers behind the newest. Each state is a directory of its own and the next number; a retried micro-batch finds
its segments seen, or applies them again, which changes nothing. With more than MAX_COVERS range deletes, or versions that only
retired segments held, the state is rebuilt from the listed log; there, range deletes have done their work and go.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.resolve import CARRIED, covers_of, joined_with_covers, newest, resolve
from ..operators.schema import LOG, RANGE, TOMBSTONE, ColumnFamily, Registry
from ..sources import codec
from ..sources.files import Files
from ..sources.store import Store

# How far behind the newest number deletes are kept, and how many range deletes a state holds.
WINDOW, MAX_COVERS = 1 << 20, 4096


def reduced(log: DataFrame, window: int = WINDOW) -> DataFrame:
    """The least log with the same live view, and with the deletes that may still meet late records."""
    columns = LOG.fieldNames()
    best = newest(log, carry=tuple(c for c in columns if c not in ("cf", "k", "lsn"))).select(*columns)
    best = joined_with_covers(best, covers_of(log), "left_anti").select(*columns)
    ranges = log.where(F.col("kind") == RANGE).dropDuplicates(["cf", "k", "lsn"])
    both = best.unionByName(ranges)
    top = log.agg(F.max("lsn").alias("top"))
    old = F.col("kind").isin(TOMBSTONE, RANGE) & (F.col("lsn") < F.col("top") - window)
    return both.join(F.broadcast(top), F.lit(True)).where(~old).select(*columns)


class Follower:
    """A live view that is kept by a stream. ``families`` are needed where values are coded."""

    def __init__(self, spark: SparkSession, root: str, state: str, window: int = WINDOW, families: Sequence[ColumnFamily] = (), most_covers: int = MAX_COVERS):
        self.spark, self.root, self.window, self.most_covers = spark, root.rstrip("/"), window, most_covers
        self.store = Store(spark, root, families, read_only=True)
        self.files = Files(spark, state)
        self.files.make("")
        self.passes: list[dict] = []

    def _newest(self) -> int | None:
        """The number of the newest whole state."""
        found = [int(x[6:]) for x in self.files.names() if x.startswith("state-")]
        return max((n for n in found if self.files.exists(f"state-{n:08d}/_SUCCESS") and self.files.exists(f"seen-{n:08d}.json")), default=None)

    def _state(self, number: int | None) -> DataFrame:
        return self.spark.range(1).where(F.lit(False)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in LOG)) if number is None else self.spark.read.schema(LOG).parquet(f"{self.files.root}/state-{number:08d}")

    def _seen(self, number: int | None) -> set[int]:
        return set() if number is None else set(json.loads(self.files.read(f"seen-{number:08d}.json")))

    def _put(self, rows: DataFrame, seen: set[int]) -> int:
        """Write the next state; the one before it stays for readers, older ones go."""
        last = self._newest()
        number = 0 if last is None else last + 1
        for name in (f"state-{number:08d}", f"seen-{number:08d}.json"):
            self.files.delete(name)
        self.files.create(f"seen-{number:08d}.json", json.dumps(sorted(seen)))
        rows.write.parquet(f"{self.files.root}/state-{number:08d}")
        for name in self.files.names():
            if name[:6] == "state-" and int(name[6:]) < number - 1:
                self.files.delete(name)
                self.files.delete(f"seen-{name[6:]}.json")
        return number

    def apply(self, batch: DataFrame, number: int, seen: set[int] | None = None) -> dict:
        """Bring rows of a log into the state. What the pass read, took up and declined, and how many range deletes stand."""
        last = self._newest()
        before, rows = self._state(last), batch.select(*LOG.fieldNames())
        made = self._state(self._put(reduced(before.unionByName(rows), self.window), self._seen(last) if seen is None else seen))
        place = ["cf", "k", "lsn", "kind"]
        applied = made.join(before, place, "left_anti").count()
        read = rows.agg(F.count("*").alias("n"), F.max("lsn").alias("top")).first()
        covers = made.where(F.col("kind") == RANGE).count()
        told = {"pass": number, "applied": applied, "skipped": read["n"] - applied, "highest_lsn": read["top"], "retired": [], "lost": 0, "is_saturated": covers > self.most_covers, "rebuilt": False}
        self.passes.append(told)
        return told

    def advance(self, number: int = 0) -> dict:
        """One pass over what the newest manifest lists and the state hasn't seen; rebuilds if versions were lost or too many range deletes stand."""
        self.store.refresh()
        listed, seen = {s["id"] for s in self.store.manifest["segments"]}, self._seen(self._newest())
        told = self.apply(self.store.log(segments=sorted(listed - seen)), number, listed)
        told["highest_lsn"] = max(told["highest_lsn"] or 0, self.store.sequence - 1)
        told["retired"] = sorted(seen - listed)
        if told["retired"]:
            told["lost"] = self._state(self._newest()).where(F.col("segment_id").isin(told["retired"]) & (F.col("kind") == 0)).count()
        if told["lost"] or told["is_saturated"]:
            self.rebuild()
            told["rebuilt"] = True
        return told

    def follow(self, checkpoint: str, **trigger) -> StreamingQuery:
        """Start (or go on) following; by default, until what is published now is applied."""
        manifests = self.spark.readStream.schema("value string").text(f"{self.root}/manifest/*.json")
        return manifests.writeStream.foreachBatch(lambda _, number: self.advance(number)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def view(self) -> DataFrame:
        registry: Registry = self.store.registry
        state = self._state(self._newest())
        if not codec.coded(registry):
            return resolve(state)
        return resolve(state, carry=(*CARRIED, "codec")).withColumn("v", codec.opened()).drop("codec")

    def rebuild(self, log: DataFrame | None = None) -> None:
        """Start over from a whole log, by default the listed one: a state of its own that later passes go on from."""
        if log is None:
            self.store.refresh()
            log = self.store.log()
        whole = reduced(log, self.window)
        self._put(whole.where(F.col("kind") != RANGE), {s["id"] for s in self.store.manifest["segments"]})
