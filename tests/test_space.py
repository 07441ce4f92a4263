"""Space, roots, codecs, upkeep and holds of a store, and a follower of it."""

import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from test_store import FAMILIES, ROOT_DIR, dump, rec

from siltlog.errors import ConfigError, CorruptionError, RejectedError
from siltlog.operators.schema import ColumnFamily, Volume
from siltlog.operators.writes import WriteBatch
from siltlog.sources import codec
from siltlog.sources.store import COUNTERS, Store, destroy
from siltlog.streaming.follower import Follower


def test_rewrites_give_space_back(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), FAMILIES) as store:
        for i in range(4):
            store.put("free", b"k", os.urandom(20_000))
        before = store.actual_size_bytes()
        last = store.get("free", b"k")
        assert before > 80_000 and store.listed_bytes() <= before
        assert store.drain() > 0
        assert store.actual_size_bytes() < before / 2 and len(os.listdir(tmp_path / "s" / "segments")) == len(store.manifest["segments"]) == 1
        assert store.get("free", b"k") == last and store.quarantined() == []
        assert [x for x in os.listdir(tmp_path / "s" / "manifest") if x.endswith(".json") and x[0] != "."] == [f"{store.manifest['version']:010d}.json"]
        assert store.counters["segments_unlinked_whole"] == 3 and store.move_ratio() == 0.0 and set(store.compaction_counters()) == set(COUNTERS)


def test_retained_versions_serve_older_readers(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store(spark, root, FAMILIES, retain=1) as store:
        store.put("free", b"k", b"1")
        store.put("free", b"k", b"2")
        reader = Store(spark, root, FAMILIES, read_only=True)
        store.compact([1, 2])
        assert reader.get("free", b"k") == b"2" and store.quarantined() == []
        store.put("free", b"l", b"3")
        assert len(store.manifest["segments"]) == 2 == len(os.listdir(tmp_path / "s" / "segments"))
        assert reader.refresh()["retired"] == 2 and reader.get("free", b"l") == b"3"
        assert reader.rebuild()["records"] == 2
        path = store.volumes.path(store.manifest["segments"][0])
        one = spark.read.parquet(path).unionByName(spark.read.parquet(path)).collect()
        shutil.rmtree(path)
        spark.createDataFrame(one, spark.read.parquet(store.volumes.path(store.manifest["segments"][1])).schema).write.parquet(path)
        with pytest.raises(CorruptionError):
            reader.rebuild()


def test_a_full_store_writes_again(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), FAMILIES, capacity=100_000, reserve=10_000) as store:
        for _ in range(3):
            store.put("free", b"k", os.urandom(24_000))
        with pytest.raises(RejectedError):
            store.put("free", b"l", os.urandom(24_000))
        frame = spark.createDataFrame([("free", bytearray(b"m"), 0, bytearray(os.urandom(40_000)), 1)], "cf string, k binary, kind int, v binary, n int")
        with pytest.raises(RejectedError):
            store.append(frame, ["n"])
        assert store.foreground_share() < 1.0
        store.drain()
        store.put("free", b"l", b"x")
        assert store.append(frame, ["n"])[1] == store.sequence and store.get("free", b"l") == b"x"


def test_small_segments_have_no_bloom_filter(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), FAMILIES) as store:
        store.put("free", b"k", b"v")
        assert store.listed_bytes() < 20_000
        rows = spark.range(6000).select(F.lit("blobs").alias("cf"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("k"), F.lit(0).alias("kind"), F.lit(b"v").alias("v"), F.col("id").alias("n"))
        store.append(rows, ["n"])
        files = [f for f in (tmp_path / "s" / store.manifest["segments"][1]["path"]).iterdir() if f.suffix == ".parquet"]
        import pyarrow.parquet as pq

        held = b"".join(f.read_bytes() for f in files)
        assert len(held) < 6000 * 80 and sum(pq.read_metadata(f).num_rows for f in files) == 6000
        # a key that isn't there is ruled out by the filter: no row group is read
        plan = store.view("blobs", None)
        assert plan.where(F.col("k") == F.lit(b"\0" * 32)).count() == 0


def test_publishing_is_exclusive_and_recovers(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store(spark, root, FAMILIES) as store:
        store.put("free", b"a", b"1")
        behind = dict(store.manifest)
        for v in (b"2", b"3"):
            store.put("free", b"a", v)
        store.manifest = behind  # two versions behind: the names in between are free again
        with pytest.raises(RejectedError):
            store.put("free", b"a", b"4")
        store._load()
        (tmp_path / "s" / "manifest" / f"{store.manifest['version'] + 1:010d}.claim").touch()  # a publisher that was cut off
        with pytest.raises(RejectedError):
            store.put("free", b"a", b"5")
    with Store(spark, root, FAMILIES) as store:
        store.put("free", b"a", b"6")
        assert store.get("free", b"a") == b"6"


def test_holds_of_other_handles(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store(spark, root, FAMILIES) as store:
        store.put("free", b"a", b"1")
        reader = Store(spark, root, FAMILIES, read_only=True)
        at = reader.hold()
        assert store.holds() == {at: 1} and store.held_floor == at
        store.put("free", b"a", b"2")
        with pytest.raises(RejectedError):
            store.compact([1])
        assert store.drain() == 0 and reader.get("free", b"a", as_of=at) == b"1"
        reader.close()
        assert store.held_floor is None and store.drain() > 0


def test_coded_values(spark, tmp_path):
    families = [ColumnFamily("coded", 1, codec="lz4"), ColumnFamily("plain", 2)]
    same, noise = b"a status of a transaction; " * 40, os.urandom(1000)
    for value in (same, noise, b"", b"x" * 255, b"x" * 256):
        stored, how = codec.pack(value)
        assert (codec.unpack(stored) if how else stored) == value and (len(stored) <= len(value) - len(value) // 8 if how else stored == value)
    assert codec.pack(same)[1] == codec.LZ4 and codec.pack(noise)[1] == codec.PLAIN and codec.pack(b"x" * 255)[1] == codec.PLAIN
    with pytest.raises(CorruptionError):
        codec.unpack(b"\xff\xff\xff\xff" + b"x")
    with Store(spark, str(tmp_path / "s"), families) as store:
        store.write(WriteBatch().put("coded", b"a", same).put("coded", b"b", noise).put("plain", b"a", same).put("coded", b"c", b"short"))
        frame = spark.createDataFrame([("coded", bytearray(b"d"), 0, bytearray(same), 1), ("plain", bytearray(b"d"), 0, bytearray(same), 2)], "cf string, k binary, kind int, v binary, n int")
        store.append(frame, ["n"])
        want = [(b"a", same), (b"b", noise), (b"c", b"short"), (b"d", same)]
        for _ in range(2):
            assert dump(store, "coded") == want and dump(store, "plain") == [(b"a", same), (b"d", same)]
            assert store.get("coded", b"d") == same and store.get_many("coded", [b"b", b"a"]) == [noise, same] and store.get_range("coded", b"a", 2, 6) == same[2:8]
            assert store.size_of("coded", b"a") < len(same) - len(same) // 8 and store.size_of("coded", b"b") == 1000
            assert {r["codec"] for r in store.log("coded").where("k = X'64'").collect()} == {codec.LZ4} and store.scrub().count() == 0
            store.compact([s["id"] for s in store.manifest["segments"]])
        follower = Follower(spark, store.root, str(tmp_path / "state"), families=families)
        follower.advance()
        assert sorted((r["cf"], bytes(r["k"]), bytes(r["v"])) for r in follower.view().collect() if r["cf"] == "coded") == [("coded", k, v) for k, v in want]


def test_several_roots(spark, tmp_path):
    root, far, more = (str(tmp_path / x) for x in ("s", "far", "more"))
    with Store(spark, root, FAMILIES, volumes=[Volume(far)], demote_after=0) as store:
        store.put("free", b"a", b"1")
        store.put("free", b"b", b"2")
        assert {s["volume"] for s in store.manifest["segments"]} == {0}
        store.compact([1])
        assert sorted(s["volume"] for s in store.manifest["segments"]) == [0, 1] and os.listdir(tmp_path / "far" / "segments")
        assert dump(store, "free") == [(b"a", b"1"), (b"b", b"2")] and len(store.disk_volumes()) == 2 and store.dead_volumes() == []
        assert store.checkpoint(str(tmp_path / "copy"))["segments"] == 2
        assert store.checkpoint(str(tmp_path / "part"), 3) == {"lsn": 2, "segments": 1, "target": str(tmp_path / "part")}
    assert dump(Store(spark, str(tmp_path / "copy"), FAMILIES, read_only=True), "free") == [(b"a", b"1"), (b"b", b"2")]
    assert dump(Store(spark, str(tmp_path / "part"), FAMILIES, read_only=True), "free") == [(b"b", b"2")]
    for wrong in ([Volume(more)], [Volume(more), Volume(far)], [Volume(far), Volume(far)]):
        with pytest.raises(ConfigError):
            Store(spark, root, FAMILIES, volumes=wrong)
    with Store(spark, root, FAMILIES, volumes=[Volume(far), Volume(more)]) as store:
        store.put("free", b"c", b"3")
        assert store.manifest["volumes"] == [root, far, more]
    os.makedirs(more, exist_ok=True)
    with Store(spark, root, FAMILIES) as store:
        assert dump(store, "free") == [(b"a", b"1"), (b"b", b"2"), (b"c", b"3")]
    shutil.move(far, far + "-gone")
    with pytest.raises(ConfigError):
        Store(spark, root, FAMILIES)
    with Store(spark, root, FAMILIES, volumes=[Volume(far, dead=True), Volume(more)]) as store:
        assert store.dead_volumes() == [far] and dump(store, "free") == [(b"b", b"2"), (b"c", b"3")]
        store.put("free", b"d", b"4")
        assert store.get("free", b"d") == b"4" and store.get("free", b"a") is None
        with pytest.raises(RejectedError):
            store.compact([3])
    shutil.move(far + "-gone", far)
    destroy(spark, root)
    assert not any((tmp_path / x).exists() for x in ("s", "far", "more"))


def test_upkeep(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), FAMILIES) as store:
        for i in range(10):
            store.write(WriteBatch().put("free", b"a", bytes([i])).put("free", bytes([100 + i]), b"v").put("free", b"z", b"v"))
        assert store.maintain(ingest_is_hot=False)["tier"] == "escalated"
        rows = dump(store, "free")
        done = store.merge_when_due() or {}
        assert done == {} or done["rows_shadowed"] >= 0
        store.drain()
        assert dump(store, "free") == rows and len(rows) == 12
        told = store.maintain(ingest_is_hot=True)
        assert told["tier"] == "deferred" and told["compacted"] is None and told["scrubbed"]["faults"] == 0
        assert store.columns() == FAMILIES and store.column_spec("free").purge_at == 0 and store.column_spec("nope") is None and store.counters_agree("free")


def test_merging_smallest_first(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), FAMILIES) as store:
        for i in range(10):
            store.write(WriteBatch().put("blobs", b"\0" * 32, bytes([i])).put("blobs", b"\xff" * 32, bytes([i])))
        made = store.merge_when_due()
        assert made["runs_merged"] == made["segments_covered"] == 10 and made["rows_written"] == 2 and made["rows_shadowed"] == 18
        assert store.counters["runs_merged"] == 10 and store.merge_when_due() is None


def test_faults_keep_a_segment(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), FAMILIES) as store:
        store.put("free", b"a", b"1")
        path = store.volumes.path(store.manifest["segments"][0])
        rows = spark.read.parquet(path).withColumn("crc", F.col("crc") + 1).collect()
        schema = spark.read.parquet(path).schema
        shutil.rmtree(path)
        spark.createDataFrame(rows, schema).write.parquet(path)
        assert store.scrub_next() == {"segment": 1, "faults": 1} and store.counters["segments_pinned_by_rot"] == 1
        report = store.verify().collect()[0]
        assert report["faults"] == 1 and report["sealed"] and report["fault"] == "checksum of free 61 at 1"
        store.put("free", b"a", b"2")
        assert store.compact_once() is None
        assert store.repair() == {"evicted": 1} and store.rotten == set() and store.get("free", b"a") == b"2"


def test_follower_goes_on_after_a_rebuild(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), FAMILIES) as store:
        follower, offsets = Follower(spark, store.root, str(tmp_path / "state")), str(tmp_path / "offsets")
        seen = lambda: {bytes(r["k"]): bytes(r["v"]) for r in follower.view().collect()}
        store.write(WriteBatch().put("free", b"a", b"1").put("free", b"b", b"2"))
        follower.follow(offsets).awaitTermination()
        assert seen() == {b"a": b"1", b"b": b"2"} and follower.passes[-1]["applied"] == 2
        follower.rebuild()
        store.write(WriteBatch().put("free", b"c", b"3").delete("free", b"a"))
        follower.follow(offsets).awaitTermination()
        assert seen() == {b"b": b"2", b"c": b"3"}
        # a segment that was written and not published, and one that is foreign
        (tmp_path / "s" / "segments" / "seg-00000099-x").mkdir()
        spark.createDataFrame(store.log().withColumn("lsn", F.col("lsn") + 100).withColumn("v", F.lit(b"no")).collect(), store.log().schema).write.mode("overwrite").parquet(str(tmp_path / "s" / "segments" / "seg-00000099-x"))
        store.put("free", b"d", b"4")
        follower.follow(offsets).awaitTermination()
        assert seen() == {b"b": b"2", b"c": b"3", b"d": b"4"}
        # versions that a purge took away are lost, and settled by a rebuild
        store.put("free", (5).to_bytes(8, "big"), b"old")
        follower.follow(offsets).awaitTermination()
        store.purge_below(10)
        store.compact([s["id"] for s in store.manifest["segments"]])
        follower.follow(offsets).awaitTermination()
        told = follower.passes[-1]
        assert told["lost"] > 0 and told["rebuilt"] and len(told["retired"]) == 4
        assert seen() == {bytes(r["k"]): bytes(r["v"]) for r in store.view("free").collect()}
        # range deletes beyond what it holds
        small = Follower(spark, store.root, str(tmp_path / "state2"), most_covers=2)
        store.put("free", b"e", b"5")
        for i in range(4):
            store.delete_range("free", bytes([i]), bytes([i + 1]))
        told = small.advance()
        assert told["is_saturated"] and told["rebuilt"] and small._state(small._newest()).where("kind = 2").count() == 0
        store.put("free", b"f", b"6")
        told = small.advance(1)
        assert not told["is_saturated"] and told["applied"] == 1 and {bytes(r["k"]) for r in small.view().collect()} == {bytes(r["k"]) for r in store.view("free").collect()}


def test_cue_and_verify_reports(spark, tmp_path):
    from siltlog.__main__ import report

    with Store(spark, str(tmp_path / "s"), FAMILIES) as store:
        store.put("free", b"a", b"1")
        at = store.hold()
        store.put("free", b"a", b"2")
        made = json.loads(report(store, "cue")[0].to_json())
        assert made["floor"] == at and made["held"] == [{"at": at, "holders": 1}] and {r["column"]: r["sealed_segments"] for r in made["columns"]} == {"records": 0, "blobs": 0, "free": 2, "unit": 0}
        document, code = report(store, "verify", 1)
        assert code == 0 and document.figures["holding_segments"] == 2 and len(document.tables["segments"]) == 1
        (tmp_path / "s" / "segments" / "foreign").mkdir()
        assert report(store, "verify")[1] == 1


def test_closing_drains(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), FAMILIES)
    store.put("records", rec(1, 1), b"1" * 100)
    store.put("records", rec(1, 1), b"2" * 100)
    store.close()
    reader = Store(spark, str(tmp_path / "s"), FAMILIES, read_only=True)
    assert len(reader.manifest["segments"]) == 1 and dump(reader, "records") == [(rec(1, 1), b"2" * 100)]
    for bad in ({"segment_bytes": 0}, {"segment_bytes": 1 << 32}, {"retain": -1}):
        with pytest.raises(ConfigError):
            Store(spark, str(tmp_path / "t"), FAMILIES, **bad)


def test_core_queries_stay_without_a_package_of_the_optional_part(tmp_path):
    hide = "import sys; sys.modules['xxhash'] = None; sys.modules['tokenizers'] = None; import __spark_entry__ as e; print(*e.queries())"
    said = subprocess.run([sys.executable, "-c", hide], cwd=ROOT_DIR, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert "kv_resolve_live" in said.stdout and "without" in said.stderr, said.stderr
