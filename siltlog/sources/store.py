"""A store: immutable Parquet segments, and a manifest whose newest version says which of them count.

A writer puts a segment under ``_staging``, moves it to ``segments``, claims number N + 1 by a file that only one can create, and then
moves manifest N + 1 to its name. Readers bind to one manifest, so that they see all of a batch or none of it. Once a manifest is out, those more
than ``retain`` versions older go, with the segments that no manifest lists any more; a reader bound to one of them refreshes. Files that no manifest
ever listed are never read, truncated or removed, only reported. One process writes, under a lock file; any number read, hold and refresh.
"""

from __future__ import annotations

import copy
import functools
import json
import os
import socket
import uuid
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, CorruptionError, LockHeldError, RejectedError
from ..operators import accounting, compact, reads, reports
from ..operators.resolve import BROADCAST_COVERS, CARRIED, narrowed, resolve
from ..operators.schema import DATA, LOG, RANGE, ColumnFamily, Registry, Volume
from ..operators.scope import Scope
from ..operators.writes import WriteBatch, batch_rows, bounded, in_order, invalid, log_frame, numbered, plan_batch
from . import codec
from .files import Files
from .volumes import Volumes

#: Segments over one key from which a merge is due.
MERGE_DEPTH = 8
#: Rows from which a segment's files have bloom filters on keys.
BLOOM_ROWS = 4096
# What compaction counts.
COUNTERS = (
    "compaction_bytes", "segments_rewritten", "segments_unlinked_whole", "tombstones_carried", "tombstones_dropped", "scrub_hits", "scrub_bytes", "records_purged", "runs_merged", "segments_pinned_by_rot", "read_bytes", "erased_bytes",
)


class Store:
    def __init__(
        self, spark: SparkSession, root: str, families: Sequence[ColumnFamily], read_only: bool = False, ratio: float = accounting.BASE_RATIO, capacity: int = 0, reserve: int = 0, volumes: Sequence[Volume] = (), retain: int = 0,
        segment_bytes: int = 1 << 30, demote_after: int | None = None,
    ):
        """``capacity`` bytes of segments, of which ``reserve`` are kept for maintenance; 0 is no limit. ``volumes`` are further roots;
        fast segments are rewritten to a capacity root once ``demote_after`` bytes were written after them, in segments of ``segment_bytes``."""
        if not 0 <= ratio <= 1:
            raise ConfigError(f"a ratio of {ratio} is not between 0 and 1")
        if capacity < 0 or reserve < 0 or capacity and reserve >= capacity:
            raise ConfigError(f"a reserve of {reserve} of {capacity} bytes leaves nothing")
        if not 0 < segment_bytes < 1 << 32 or retain < 0:
            raise ConfigError(f"segments of {segment_bytes} bytes, {retain} versions retained")
        self.capacity, self.reserve, self.retain, self.segment_bytes, self.demote_after = capacity, reserve, retain, segment_bytes, demote_after
        self.spark, self.root, self.registry, self.read_only, self.ratio = spark, root.rstrip("/"), Registry(families), read_only, ratio
        self.files = Files(spark, root)
        self.nonce, self.purge_floor, self.tier, self.held = uuid.uuid4().bytes[:8], 0, "relaxed", {}
        self.counters, self.rotten, self.scrubbed = dict.fromkeys(COUNTERS, 0), set(), 0
        if not read_only:
            self.files.make("manifest")
            owner = json.dumps({"host": socket.gethostname(), "pid": os.getpid()})
            if not self.files.create("LOCK", owner):
                raise LockHeldError(self.files.read("LOCK"))
        try:
            self._load()
            self.volumes = Volumes(spark, self.root, volumes, self.manifest["volumes"])
            undeclared = {c for s in self.manifest["segments"] for c in s["spans"]} - set(self.registry.by_name)
            if undeclared and not read_only:
                raise ConfigError(f"the store holds undeclared columns: {sorted(undeclared)}")
            if not read_only:
                for name in self.files.names("manifest"):  # of a publisher that was cut off: the lock is ours
                    if name.endswith(".claim") and int(name[:-6]) > self.manifest["version"]:
                        self.files.delete(f"manifest/{name}")
        except Exception:
            if not read_only:
                self.files.delete("LOCK")
            raise

    # -- manifest

    def _versions(self) -> list[int]:
        return [int(x[:-5]) for x in self.files.names("manifest") if x.endswith(".json") and x[:-5].isdecimal()]

    def _load(self) -> None:
        for _ in range(8):
            versions = self._versions()
            if not versions:
                self.manifest = {"version": 0, "next_lsn": 1, "next_segment": 1, "next_batch": 1, "purge_floor": 0, "segments": [], "volumes": [self.root]}
                return
            name = f"manifest/{max(versions):010d}.json"
            try:
                self.manifest = {"volumes": [self.root]} | json.loads(self.files.read(name))
            except ValueError as e:
                raise CorruptionError(f"manifest: {e}") from e
            except Exception:
                if self.files.exists(name):
                    raise
                continue  # a newer one has taken its place
            self.purge_floor = self.manifest["purge_floor"]
            return
        raise CorruptionError("manifests go faster than they can be read")

    def _publish(self, changed: dict) -> None:
        before = self.manifest["version"]
        changed["version"], changed["volumes"] = before + 1, self.volumes.paths
        taken = RejectedError(f"manifest {before + 1} was published by another writer")
        if max(self._versions(), default=0) != before or not self.files.create(f"manifest/{before + 1:010d}.claim", ""):
            raise taken
        staged = f"manifest/_{uuid.uuid4().hex}"
        self.files.create(staged, json.dumps(changed))
        if not self.files.rename(staged, f"manifest/{changed['version']:010d}.json"):
            self.files.delete(staged)
            raise taken
        self.manifest = changed
        self._expire()

    def _expire(self) -> None:
        """Remove manifests beyond the retained ones, and what only they list."""
        versions = sorted(self._versions())
        old = versions[: -1 - self.retain]
        read = {v: json.loads(self.files.read(f"manifest/{v:010d}.json")) for v in versions if v != self.manifest["version"]} | {self.manifest["version"]: self.manifest}
        where = lambda s: (s.get("volume", 0), s["path"])
        listed = {where(s) for v in versions[-1 - self.retain :] for s in read[v]["segments"]}
        for v in old:
            for at, path in {where(s) for s in read[v]["segments"]} - listed:
                if not self.volumes.is_dead(at):
                    self.volumes.files[at].delete(path)
            for end in ("json", "claim"):
                self.files.delete(f"manifest/{v:010d}.{end}")

    @property
    def sequence(self) -> int:
        """The next sequence number."""
        return self.manifest["next_lsn"]

    def columns(self) -> list[ColumnFamily]:
        return list(self.registry.families)

    def column_spec(self, name: str) -> ColumnFamily | None:
        return self.registry.get(name)

    def refresh(self) -> dict:
        """Bind a reader to the newest manifest; what came and went."""
        if not self.read_only:
            raise RejectedError("a writable store doesn't refresh")
        before = {s["id"] for s in self.manifest["segments"]}
        self._load()
        after = {s["id"] for s in self.manifest["segments"]}
        return {"applied": len(after - before), "retired": len(before - after), "highest_lsn": self.sequence - 1}

    def rebuild(self) -> dict:
        """Refresh, and hold what the manifest says of each segment against the segment's own rows."""
        told = self.refresh()
        found = {r["segment_id"]: r for r in self.log().groupBy("segment_id").agg(F.count("*").alias("n"), F.max("lsn").alias("b")).collect()}
        for s in self._readable():
            row = found.get(s["id"])
            if row is None or (row["n"], row["b"]) != (s["records"], s["max_lsn"]):
                raise CorruptionError(f"segment {s['id']} holds something else than the manifest says")
        return told | {"records": sum(r["n"] for r in found.values())}

    def quarantined(self) -> list[str]:
        """Files beside the listed and retained segments."""
        listed = {(s.get("volume", 0), s["path"].rpartition("/")[2]) for v in self._versions() for s in (self.manifest if v == self.manifest["version"] else json.loads(self.files.read(f"manifest/{v:010d}.json")))["segments"]}
        return [x for i, f in enumerate(self.volumes.files) if not self.volumes.is_dead(i) for x in f.names("segments") if (i, x) not in listed]

    def _readable(self) -> list[dict]:
        """The listed segments but for those on dead roots, whose records are misses."""
        return [s for s in self.manifest["segments"] if not self.volumes.is_dead(s.get("volume", 0))]

    # -- writing

    def _write_segment(self, rows: DataFrame, changed: dict, sort: bool = True, most: int = 0, kind: str = "fast") -> dict | None:
        """Write rows, ``most`` at most (0: unknown), as the next segment and describe it in ``changed``; None, and no file, if there are none."""
        number, volume = changed["next_segment"], self.volumes.draw(kind)
        files, root = self.volumes.files[volume], self.volumes.paths[volume]
        name = f"seg-{number:08d}-{uuid.uuid4().hex[:8]}"
        rows = rows.select(*(F.lit(number).cast("int").alias(c) if c == "segment_id" else F.col(c) for c in LOG.fieldNames()))
        rows = rows.sortWithinPartitions("cf", "k", F.col("lsn").desc()) if sort else rows
        staged = f"_staging/{name}"
        writer = rows.write
        if not most or most >= BLOOM_ROWS:
            writer = writer.option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.expected.ndv#k", str(min(most or 1 << 20, 1 << 20)))
        writer.parquet(f"{root}/{staged}")
        written = self.spark.read.schema(LOG).parquet(f"{root}/{staged}")
        points = F.col("kind") == DATA
        spans = written.groupBy("cf").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n"), F.min("lsn").alias("a"), F.max("lsn").alias("b"), F.count_if(F.col("kind") == RANGE).alias("ranges"), F.count_if(~points).alias("deletes")).collect()
        if not spans:
            files.delete(staged)
            return None
        files.make("segments")
        if not files.rename(staged, f"segments/{name}"):
            raise CorruptionError(f"segment {name} is there already")
        entry = {"id": number, "path": f"segments/{name}", "volume": volume, "bytes": files.size(f"segments/{name}"), "records": sum(r["n"] for r in spans), "min_lsn": min(r["a"] for r in spans), "max_lsn": max(r["b"] for r in spans), "ranges": sum(r["ranges"] for r in spans), "deletes": sum(r["deletes"] for r in spans)}
        entry["spans"] = {r["cf"]: [bytes(r["low"]).hex(), bytes(r["high"]).hex(), r["n"]] for r in spans}
        changed["next_segment"] = number + 1
        changed["segments"].append(entry)
        return entry

    def _writable(self) -> dict:
        if self.read_only:
            raise RejectedError("this store is open for reading")
        return copy.deepcopy(self.manifest)

    def _room_for(self, asked: int) -> None:
        if self.capacity and not accounting.admits(self.listed_bytes(), asked, self.capacity, self.reserve):
            raise RejectedError(f"{asked} bytes don't fit below the reserve")

    def write(self, batch: WriteBatch) -> tuple[int, int]:
        """Apply a batch whole; the first and the one-past-last sequence number it took. An empty one writes nothing."""
        changed = self._writable()
        planned, base = plan_batch(batch, self.registry), self.sequence
        self._room_for(sum(len(k) + len(more or b"") for _, _, k, more in planned))
        if planned:
            changed["next_lsn"], changed["next_batch"] = base + len(planned), changed["next_batch"] + 1
            self._write_segment(batch_rows(self.spark, planned, base, self.manifest["next_batch"], changed["next_segment"], self._packed), changed, most=len(planned))
            self._publish(changed)
        return base, base + len(planned)

    def _packed(self, cf: str, value: bytes) -> tuple[bytes, int]:
        return codec.pack(value) if self.registry[cf].codec == "lz4" else (value, codec.PLAIN)

    def put(self, cf: str, key: bytes, value: bytes) -> int:
        return self.write(WriteBatch().put(cf, key, value))[0]

    #: A published manifest is as durable as its file system: every put is.
    put_durable = put

    def delete(self, cf: str, key: bytes) -> int:
        """Also a missing key's delete is appended."""
        return self.write(WriteBatch().delete(cf, key))[0]

    def delete_range(self, cf: str, start: bytes, end: bytes | None = None) -> None:
        self.write(WriteBatch().delete_range(cf, start, end))

    def append(self, df: DataFrame, order: list[str]) -> tuple[int, int]:
        """A frame (cf, k, kind, v, range_end) of any size as one batch, numbered in the order of these columns, by executors."""
        changed, base = self._writable(), self.sequence
        staged = f"{self.root}/_staging/in-{uuid.uuid4().hex}"
        own = ["cf", "k", "kind", "v", *(["range_end"] if "range_end" in df.columns else [])]
        extra = {c: f"_order{i}" for i, c in enumerate(order) if c not in own}  # their names may be those of a log's columns
        rows = df.select(*own, *(F.col(c).alias(name) for c, name in extra.items()))
        in_order(codec.with_packed(bounded(rows, self.registry), self.registry), [extra.get(c, c) for c in order]).write.parquet(staged)
        try:
            self._room_for(max(1, self.files.size(staged.removeprefix(f"{self.root}/"))))
            read = self.spark.read.parquet(staged).drop(*extra.values())
            bad = F.first(F.when(invalid(self.registry), F.struct("cf", "k")), ignorenulls=True)
            told = log_frame(read.withColumn("lsn", F.lit(base))).agg(F.count("*").alias("n"), bad.alias("bad")).first()  # one pass, all tasks at once
            if told["bad"]:
                self.registry[told["bad"]["cf"]]
                raise RejectedError(f"a row is not admitted: {told['bad']['cf']} {bytes(told['bad']['k'] or b'').hex()}")
            logged = log_frame(numbered(read, base).withColumn("batch_id", F.lit(changed["next_batch"])))
            entry = self._write_segment(logged, changed, most=told["n"])
        finally:
            self.files.delete(staged.removeprefix(f"{self.root}/"))
        if entry:
            changed["next_lsn"], changed["next_batch"] = entry["max_lsn"] + 1, changed["next_batch"] + 1
            self._publish(changed)
        return base, self.sequence

    # -- reading

    def log(self, cf: str | None = None, scope: Scope | None = None, as_of: int | None = None, segments: Sequence[int] | None = None) -> DataFrame:
        """The log of the listed segments. Files without the family, beyond the scope or newer than as_of aren't opened; those with range deletes are."""
        paths = []
        for s in self._readable():
            span = s["spans"].get(cf) if cf else None
            if segments is not None and s["id"] not in segments or cf and not span or as_of is not None and s["min_lsn"] > as_of:
                continue
            if span and scope and not s["ranges"]:
                low, high = bytes.fromhex(span[0]), bytes.fromhex(span[1])
                if scope.locate(high) == "before" or scope.locate(low) == "past":
                    continue
            paths.append(self.volumes.path(s))
        rows = self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)
        return rows.where(F.col("cf") == cf) if cf else rows

    def _few(self) -> bool:
        return sum(s["ranges"] for s in self.manifest["segments"]) <= BROADCAST_COVERS

    def _opened(self, cf: str, live: DataFrame) -> DataFrame:
        """Live rows with their values as they were written."""
        return live.withColumn("v", codec.opened()).drop("codec") if self.registry[cf].codec != "none" else live

    def _carried(self, cf: str) -> tuple[str, ...]:
        return (*CARRIED, "codec") if self.registry[cf].codec != "none" else CARRIED

    def view(self, cf: str, scope: Scope | None = None, as_of: int | None = None) -> DataFrame:
        """The live rows of a family."""
        live = resolve(self.log(cf, scope, as_of), as_of, self._carried(cf), few=self._few())
        return self._opened(cf, live.where(scope(F.col("k"))) if scope else live)

    def view_of(self, cf: str, keys: Sequence[bytes], as_of: int | None = None) -> DataFrame:
        """The live rows of these keys: only segments that reach over them are opened, and only their versions resolved."""
        scope = Scope(min(keys), max(keys), True) if keys else Scope(b"", b"")
        log = narrowed(self.log(cf, scope, as_of).where((F.col("kind") == RANGE) | scope(F.col("k"))), cf, keys)
        return self._opened(cf, resolve(log, as_of, self._carried(cf), few=self._few()))

    def get(self, cf: str, key: bytes, as_of: int | None = None) -> bytes | None:
        if not self.registry[cf].admits(key):
            raise RejectedError(f"a key of {len(key)} bytes is not one of {cf}")
        row = reads.get(self.view(cf, Scope(key, key, True), as_of), cf, key).first()
        return None if row is None else bytes(row["v"])

    def get_many(self, cf: str, keys: Sequence[bytes]) -> list[bytes | None]:
        """A value or None for each key, in the order of keys: as many as the caller holds."""
        self.registry[cf]
        if not keys:
            return []
        rows = reads.get_many(self.view_of(cf, keys), cf, reads.key_list(self.spark, keys)).orderBy("pos").collect()
        return [None if r["v"] is None else bytes(r["v"]) for r in rows]

    def contains(self, cf: str, key: bytes) -> bool:
        return not self.view(cf, Scope(key, key, True)).select("k").isEmpty()

    def iter_prefix(self, cf: str, prefix: bytes = b"") -> DataFrame:
        return reads.iter_prefix(self.view(cf, Scope.prefix(prefix)), cf, prefix)

    def iter_range(self, cf: str, start: bytes, end: bytes) -> DataFrame:
        return reads.iter_range(self.view(cf, Scope.range(start, end)), cf, start, end)

    def iter_from(self, cf: str, start: bytes, ascending: bool = True) -> DataFrame:
        return reads.iter_from(self.view(cf, Scope.from_key(start, ascending)), cf, start, ascending)

    def sweep(self, cf: str, limit: int, mark: bytes | None = None, prefix: bytes = b"", keys_only: bool = False):
        return reads.Sweep(self.nonce).next(self.view(cf, Scope.prefix(prefix)), cf, limit, mark, prefix, keys_only)

    def count_prefix(self, cf: str, prefix: bytes = b"") -> int:
        return reads.count_prefix(self.view(cf, Scope.prefix(prefix)), cf, prefix).first()["n"]

    def bytes_prefix(self, cf: str, prefix: bytes = b"") -> int:
        return reads.bytes_prefix(self.view(cf, Scope.prefix(prefix)), cf, prefix).first()["bytes"]

    def key_count_estimate(self, cf: str) -> int | None:
        """None, not an error, for an undeclared family."""
        return None if self.registry.get(cf) is None else self.count_prefix(cf)

    def totals(self) -> tuple[int, int]:
        row = reads.totals(resolve(self.log(), carry=("len",))).first()
        return row["n"], row["bytes"]

    def get_range(self, cf: str, key: bytes, offset: int, length: int) -> bytes | None:
        """None for a miss, no bytes past the value's end."""
        row = reads.get_range(self.view(cf, Scope(key, key, True)), cf, key, offset, length).first()
        return None if row is None else bytes(row["v"])

    def size_of(self, cf: str, key: bytes) -> int | None:
        row = reads.size_of(self.view(cf, Scope(key, key, True)), cf, key).first()
        return None if row is None else row["len"]

    def iter_keys_prefix(self, cf: str, prefix: bytes = b"") -> DataFrame:
        return reads.iter_keys_prefix(self.view(cf, Scope.prefix(prefix)), cf, prefix)

    def iter_keys_from(self, cf: str, start: bytes | None = None, ascending: bool = True) -> DataFrame:
        return reads.iter_keys_from(self.view(cf, None if start is None else Scope.from_key(start, ascending)), cf, start, ascending)

    def walk(self, cf: str, start: bytes, take, ascending: bool = True, hint: int | None = None) -> int:
        return reads.walk(self.view(cf, Scope.from_key(start, ascending)), cf, start, take, ascending, hint)

    def records(self, segment: int) -> DataFrame:
        """Every record of a segment, dead ones too, with its file and place there."""
        entry = next((s for s in self._readable() if s["id"] == segment), None)
        if entry is None:
            raise RejectedError(f"there is no segment {segment}")
        return self.spark.read.schema(LOG).parquet(self.volumes.path(entry)).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))

    def segment_footer(self, segment: int) -> DataFrame:
        """The key-ordered rows of a segment, without payloads."""
        return self.records(segment).select("cf", "k", "lsn", "kind", "range_end", "len", "file", "row").orderBy("cf", "k", F.col("lsn").desc())

    def register(self, cf: str, name: str, as_of: int | None = None) -> None:
        """The family's live rows as a temporary view, for SQL."""
        self.view(cf, None, as_of).createOrReplaceTempView(name)

    def cf_disk_usage(self) -> DataFrame:
        return reads.cf_disk_usage(resolve(self.log(), carry=("len",)), self.registry)

    def live_data_size_bytes(self) -> int:
        return self.totals()[1]

    def counters_agree(self, cf: str) -> bool:
        """Whether a family's count and bytes by prefix are those of the totals by family."""
        row = next((r for r in reads.column_totals(resolve(self.log(cf), carry=("len",), few=self._few())).collect()), None)
        return (self.count_prefix(cf), self.bytes_prefix(cf)) == ((row["n"], row["bytes"]) if row else (0, 0))

    def dead_volumes(self) -> list[str]:
        return self.volumes.dead()

    def dead_bytes(self) -> int:
        return self.segments().agg(F.coalesce(F.sum("dead"), F.lit(0)).alias("n")).first()["n"]

    # -- snapshots and checkpoints

    def hold(self) -> int:
        """Hold what is there now for reads as of the returned number, until ``release``: a file that writers see, whichever process holds."""
        at, name = self.sequence - 1, f"holds/{self.sequence - 1:020d}-{uuid.uuid4().hex[:8]}"
        self.files.make("holds")
        self.files.create(name, json.dumps({"host": socket.gethostname(), "pid": os.getpid()}))
        self.held.setdefault(at, []).append(name)
        return at

    def release(self, at: int) -> None:
        """Let go of one hold of this handle."""
        if self.held.get(at):
            self.files.delete(self.held[at].pop())

    def holds(self) -> dict[int, int]:
        """How many holds there are at each number, of all processes."""
        return dict(sorted(Counter(int(x[:20]) for x in self.files.names("holds")).items()))

    @property
    def held_floor(self) -> int | None:
        return min(self.holds(), default=None)

    def checkpoint(self, target: str, boundary: int | None = None) -> dict:
        """A store of its own at target, which appears whole or not at all: all segments, or those numbered below the boundary."""
        parent, _, name = target.rstrip("/").rpartition("/")
        out = Files(self.spark, parent)
        if out.exists(name):
            raise RejectedError(f"{target} is there already")
        taken = [s for s in self._readable() if boundary is None or s["id"] < boundary]
        staged = f"_{name}.tmp-{uuid.uuid4().hex[:8]}"
        out.make(f"{staged}/segments")
        out.make(f"{staged}/manifest")
        try:
            for s in taken:
                self.volumes.files[s.get("volume", 0)].copy(s["path"], out, f"{staged}/{s['path']}")
        except Exception as e:
            out.delete(staged)
            raise RejectedError("a segment was retired while the checkpoint copied it") from e
        copied = self.manifest | {"segments": [s | {"volume": 0} for s in taken], "volumes": [target.rstrip("/")]}
        out.create(f"{staged}/manifest/{self.manifest['version']:010d}.json", json.dumps(copied))
        if not out.rename(staged, name):
            out.delete(staged)
            raise RejectedError(f"{target} is there already")
        at = self.sequence - 1 if boundary is None else max((s["max_lsn"] for s in taken), default=0)
        return {"lsn": at, "segments": len(taken), "target": target}

    # -- maintenance

    def segments(self) -> DataFrame:
        return accounting.segment_bytes(self.log())

    def purge_below(self, floor: int) -> None:
        """Records whose mark is below the floor go when their segment is next rewritten; the floor only rises."""
        changed = self._writable()
        self.purge_floor = changed["purge_floor"] = max(floor, changed["purge_floor"])
        self._publish(changed)

    def _around(self, gone: list[dict]) -> DataFrame:
        """What a rewrite of these segments has to see of the log: with range deletes among them all of it, else what lies over their keys."""
        if any(s["ranges"] for s in gone):
            return self.log()
        low, high = {}, {}
        for s in gone:
            for cf, (a, b, _) in s["spans"].items():
                low[cf], high[cf] = min(a, low.get(cf, a)), max(b, high.get(cf, b))
        parts = [self.log(cf, scope := Scope(bytes.fromhex(low[cf]), bytes.fromhex(high[cf]), True)).where((F.col("kind") == RANGE) | scope(F.col("k"))) for cf in low]
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.log(segments=[])

    def compact(self, segments: Sequence[int]) -> dict:
        """Rewrite these segments as one, or drop them if nothing of them is needed."""
        changed, wanted = self._writable(), list(segments)
        floor = self.held_floor
        if floor is not None and any(s["min_lsn"] <= floor for s in changed["segments"] if s["id"] in wanted):
            raise RejectedError("a held snapshot may read these segments")
        gone = [s for s in changed["segments"] if s["id"] in wanted]
        if len({s["id"] for s in self._readable()} & set(wanted)) < len(gone):
            raise RejectedError("a dead root holds one of these segments")
        log = self._around(gone)
        out = compact.rewritten(log, wanted, self.registry, self.purge_floor)
        purged = 0
        if self.purge_floor:
            purged = compact.live_copies(log, wanted).where(compact.purged(self.registry, self.purge_floor)).count()
        changed["segments"] = [s for s in changed["segments"] if s["id"] not in wanted]
        oldest = min(gone, key=lambda s: s["id"]) if gone else None
        behind = sum(s["id"] > oldest["id"] for s in self.manifest["segments"]) if gone else 0
        source = self.volumes.all[oldest.get("volume", 0)].kind if gone else "fast"
        kind = accounting.output_kind(source, self.volumes.has_capacity, behind, self.segment_bytes, self.demote_after)
        entry = self._write_segment(compact.clustered(out), changed, sort=False, most=sum(s["records"] for s in gone), kind=kind)
        self._publish(changed)
        carried = entry["deletes"] if entry else 0
        for name, n in (
            ("segments_rewritten" if entry else "segments_unlinked_whole", len(gone)), ("compaction_bytes", entry["bytes"] if entry else 0), ("read_bytes", sum(s.get("bytes", 0) for s in gone)), ("tombstones_carried", carried),
            ("tombstones_dropped", sum(s.get("deletes", 0) for s in gone) - carried), ("records_purged", purged),
        ):
            self.counters[name] += n
        return {"retired": [s["id"] for s in gone], "segment": entry and entry["id"], "records": entry["records"] if entry else 0}

    def compact_once(self, ratio: float | None = None) -> dict | None:
        """First all segments of which nothing is needed, else the one with the largest share to win; None if there is neither. Segments with faults stay."""
        segs = self.segments().where(~F.col("segment_id").isin(sorted(self.rotten))).cache()
        try:
            floor = self.held_floor
            whole = [r["segment_id"] for r in accounting.whole_dead(segs, floor).select("segment_id").collect()]
            target = whole or [r["segment_id"] for r in accounting.select_target(segs, self.ratio if ratio is None else ratio, floor).collect()]
        finally:
            segs.unpersist()
        return self.compact(target) if target else None

    def drain(self, most: int | None = None) -> int:
        """Compact until there is no target, or ``most`` times; how many passes it took. A rewrite that leaves as many records as there were ends it."""
        done = 0
        while most is None or done < most:
            before = sum(s["records"] for s in self.manifest["segments"])
            if not self.compact_once():
                break
            done += 1
            if sum(s["records"] for s in self.manifest["segments"]) >= before:
                break
        return done

    def merge_when_due(self) -> dict | None:
        """If more than MERGE_DEPTH segments stand over one key, rewrite the smallest, as long as each is at most twice the pile before it, as one clustered segment."""
        rows = [(cf, s["id"], bytearray.fromhex(a), bytearray.fromhex(b)) for s in self._readable() for cf, (a, b, _) in s["spans"].items()]
        spans = self.spark.createDataFrame(rows, "cf string, segment_id int, low binary, high binary")
        depth, floor = accounting.overlap_depth(spans).first()["depth"], self.held_floor
        free = [s for s in self._readable() if s["id"] not in self.rotten and (floor is None or s["min_lsn"] > floor)]
        runs = compact.merge_candidates([(s["id"], s.get("bytes", 0)) for s in free], depth, MERGE_DEPTH)
        if not runs:
            return None
        before = sum(s["records"] for s in free if s["id"] in runs)
        made = self.compact(runs)
        self.counters["runs_merged"] += len(runs)
        return {"runs_merged": len(runs), "segments_covered": len(made["retired"]), "rows_written": made["records"], "rows_shadowed": before - made["records"], "segment": made["segment"]}

    def scrub_next(self) -> dict | None:
        """Check the payloads of the next segment in turn; one with faults is left standing by compaction."""
        turn = sorted(self._readable(), key=lambda s: (s["id"] <= self.scrubbed, s["id"]))
        if not turn:
            return None
        s, self.scrubbed = turn[0], turn[0]["id"]
        faults = reports.faulty(self.records(s["id"])).count()
        (self.rotten.add if faults else self.rotten.discard)(s["id"])
        self.counters["scrub_hits"] += faults
        self.counters["scrub_bytes"] += s.get("bytes", 0)
        self.counters["segments_pinned_by_rot"] = len(self.rotten & {x["id"] for x in self.manifest["segments"]})
        return {"segment": s["id"], "faults": faults}

    def foreground_share(self) -> float:
        """The share of their pace that writers should keep, by how full the store is."""
        return accounting.foreground_throttle(self.listed_bytes(), self.capacity, self.reserve)

    def maintain(self, ingest_is_hot: bool = False) -> dict:
        """One bounded pass: the tier by dead bytes, then compaction and merging unless they are deferred, then a segment's scrub."""
        if self.read_only:
            return {}
        sums = self.segments().agg(F.coalesce(F.sum("dead"), F.lit(0)).alias("dead"), F.coalesce(F.sum("live"), F.lit(0)).alias("live")).first()
        share = sums["dead"] / (sums["dead"] + sums["live"]) if sums["dead"] + sums["live"] else 0.0
        self.tier = accounting.pressure_tier(share, self.tier == "escalated", ingest_is_hot)
        ratio, deferred = accounting.effective_ratio(self.ratio, self.tier), self.tier == "deferred"
        compacted = None if deferred else self.compact_once(ratio)
        merged = None if deferred else self.merge_when_due()
        return {"tier": self.tier, "ratio": ratio, "dead_share": share, "compacted": compacted, "merged": merged, "scrubbed": self.scrub_next(), "move_ratio": self.move_ratio(), "foreground_share": self.foreground_share()}

    def move_ratio(self) -> float:
        return accounting.move_ratio(self.counters["segments_rewritten"], self.counters["segments_unlinked_whole"])

    def compaction_counters(self) -> dict[str, int]:
        return dict(self.counters)

    #: The trait's name of one pass.
    reclaim_space = compact_once

    def evict(self, places: DataFrame) -> dict:
        """Rewrite the segments of these (segment_id, file, row) places without them: no tombstone is written, older versions surface again."""
        wanted = [r[0] for r in places.select("segment_id").distinct().collect()]
        changed = self._writable()
        kept = None
        for number in wanted:
            rows = self.records(number).join(places.where(F.col("segment_id") == number).select("file", "row"), ["file", "row"], "left_anti").drop("file", "row")
            kept = rows if kept is None else kept.unionByName(rows)
        if kept is None:
            return {"evicted": 0}
        before = sum(s["records"] for s in changed["segments"] if s["id"] in wanted)
        changed["segments"] = [s for s in changed["segments"] if s["id"] not in wanted]
        entry = self._write_segment(kept, changed, most=before)
        self._publish(changed)
        self.rotten -= set(wanted)
        return {"evicted": before - (entry["records"] if entry else 0)}

    def repair(self) -> dict:
        """Evict every record whose payload doesn't have its checksum."""
        bad = None
        for s in self._readable():
            rows = reports.faulty(self.records(s["id"])).select(F.lit(s["id"]).alias("segment_id"), "file", "row")
            bad = rows if bad is None else bad.unionByName(rows)
        return self.evict(bad) if bad is not None else {"evicted": 0}

    def scrub(self) -> DataFrame:
        return reports.faulty(self.log()).select("segment_id", "cf", "k", "lsn")

    def verify(self, limit: int = 0) -> DataFrame:
        return reports.verify_report(self.log(), [s["id"] for s in self._readable()], limit)

    def listed_bytes(self) -> int:
        """Bytes of the segments that count."""
        return sum(s.get("bytes", 0) for s in self.manifest["segments"])

    def actual_size_bytes(self) -> int:
        """Bytes of all files of segments, retained and foreign ones too."""
        return sum(self.volumes.used(i) for i in range(len(self.volumes.all)))

    def available_disk_bytes(self) -> int:
        return self.files.free()

    def disk_volumes(self) -> list[dict]:
        return self.volumes.report()

    def flush(self) -> None:
        """Nothing is held back: a published manifest is durable as far as its file system is."""

    def close(self, drain: bool = True) -> None:
        """Compact what is due, then stop; without ``drain``, and at the end of a with block, only stop."""
        if not self.read_only:
            try:
                if drain:
                    self.drain()
            finally:
                self.files.delete("LOCK")
                self.read_only = True
        for at in list(self.held):
            while self.held[at]:
                self.release(at)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *error) -> None:
        self.close(drain=False)


def destroy(spark: SparkSession, root: str) -> None:
    """Remove a store that no writer has open, with all the roots that its manifest names."""
    files = Files(spark, root)
    if files.exists("LOCK"):
        raise LockHeldError(files.read("LOCK"))
    store = Store(spark, root, [], read_only=True)
    for other in store.volumes.files[1:]:
        other.delete()
    files.delete()
