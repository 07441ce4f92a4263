import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltlog.errors import ColumnFamilyNotFound, ConfigError, LockHeldError, RejectedError
from siltlog.operators.schema import ColumnFamily
from siltlog.operators.writes import WriteBatch
from siltlog.sources.store import Store, destroy
from siltlog.streaming.follower import Follower

ROOT_DIR = Path(__file__).resolve().parent.parent
FAMILIES = [ColumnFamily("records", 1, 34, 2), ColumnFamily("blobs", 2, 32), ColumnFamily("free", 3, purge_at=0), ColumnFamily("unit", 4, 0)]


def rec(group, addr):
    return group.to_bytes(2, "big") + bytes([addr]) * 32


class Model(dict):
    """The oracle: (cf, key) -> value."""

    def apply(self, batch):
        for kind, cf, k, more in batch.ops:
            if kind == 0:
                self[cf, k] = more
            elif kind == 1:
                self.pop((cf, k), None)
            else:
                w = {f.name: f.width for f in FAMILIES}[cf]
                cut = (lambda b: b[:w].ljust(w, b"\0")) if w is not None else (lambda b: b)
                for c, x in [x for x in self if x[0] == cf and x[1] >= cut(k) and (more is None or x[1] < cut(more))]:
                    del self[c, x]

    def dump(self, cf):
        return sorted((k, v) for (c, k), v in self.items() if c == cf)


def dump(store, cf):
    return [(bytes(r["k"]), bytes(r["v"])) for r in store.iter_prefix(cf).collect()]


def observe(store, model):
    for cf in ("records", "free"):
        want = model.dump(cf)
        assert dump(store, cf) == want
        assert store.count_prefix(cf) == len(want)
        assert store.bytes_prefix(cf) == sum(len(v) for _, v in want)
    assert store.totals() == (len(model), sum(map(len, model.values())))


def random_batch(rng):
    b = WriteBatch()
    for _ in range(12):
        g, a, roll = rng.choice([7, 8, 9]), rng.randrange(11), rng.randrange(100)
        if roll < 68:
            b.put("records", rec(g, a), bytes([rng.randrange(256)]) * rng.randrange(1, 300))
        elif roll < 84:
            b.delete("records", rec(g, a))
        elif roll < 92:
            b.delete_range("records", g.to_bytes(2, "big"), (g + 1).to_bytes(2, "big"))
        elif roll < 96:
            b.put("free", bytes([a]) * rng.randrange(0, 12), b"f")
        else:
            b.delete_range("records", rec(g, a), rec(g, rng.randrange(11)))
    return b


def test_operation_stream(spark, tmp_path):
    rng, model, root = random.Random(7), Model(), str(tmp_path / "s")
    with Store(spark, root, FAMILIES) as store:
        for step in range(6):
            batch = random_batch(rng)
            store.write(batch)
            model.apply(batch)
            if step in (2, 5):
                observe(store, model)
        kept = dict(model)
        at = store.hold()
        before = dump(store, "records")
        with pytest.raises(RejectedError):
            store.compact([s["id"] for s in store.manifest["segments"]])
        store.release(at)
        store.compact([s["id"] for s in store.manifest["segments"]][1:4])
        observe(store, model)
        store.drain(4)
        observe(store, model)
        report = store.checkpoint(str(tmp_path / "copy"))
        assert report["lsn"] == store.sequence - 1
        store.write(WriteBatch().delete_range("records", b"", None))
        assert dump(store, "records") == [] and before
    with Store(spark, str(tmp_path / "copy"), FAMILIES) as again:
        assert dump(again, "records") == sorted((k, v) for (c, k), v in kept.items() if c == "records")
        with pytest.raises(LockHeldError):
            Store(spark, str(tmp_path / "copy"), FAMILIES)
        with pytest.raises(LockHeldError):
            destroy(spark, str(tmp_path / "copy"))
    destroy(spark, str(tmp_path / "copy"))
    assert not (tmp_path / "copy").exists()


def test_reads_and_refusals(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store(spark, root, FAMILIES) as store:
        assert store.write(WriteBatch()) == (1, 1)
        first, last = store.write(WriteBatch().put("free", b"a", b"1").put("free", b"b", b"22").put("free", b"a", b"333").put("unit", b"", b"only"))
        assert (first, last) == (1, 5)
        assert store.get("free", b"a") == b"333" and store.get("unit", b"") == b"only" and store.get("free", b"zz") is None
        assert store.get_many("free", [b"b", b"x", b"a", b"b"]) == [b"22", None, b"333", b"22"]
        assert store.contains("free", b"b") and not store.contains("free", b"c")
        lsn = store.delete("free", b"missing")
        assert lsn == 5 and store.sequence == 6
        store.delete_range("free", b"b", b"a")
        assert store.sequence == 6
        for bad in (WriteBatch().put("free", b"x", b"1").put("nope", b"", b""), WriteBatch().put("records", b"short", b"")):
            with pytest.raises((ColumnFamilyNotFound, RejectedError)):
                store.write(bad)
        assert store.get("free", b"x") is None and store.key_count_estimate("nope") is None
        with pytest.raises(ColumnFamilyNotFound):
            store.get("nope", b"")
        store.put("free", b"a", b"new")
        assert store.get("free", b"a", as_of=4) == b"333" and store.get("free", b"a", as_of=1) == b"1" and store.get("free", b"a", as_of=0) is None
        rows, mark = store.sweep("free", 1)
        assert [bytes(r["k"]) for r in rows] == [b"a"] and mark
        rows, mark2 = store.sweep("free", 1, mark)
        assert [bytes(r["k"]) for r in rows] == [b"b"] and mark2
        assert store.sweep("free", 1, mark2) == ([], None) and store.sweep("free", 0, mark) == ([], mark)
        assert [bytes(r["k"]) for r in store.sweep("free", 5, b"otherone" + b"b")[0]] == [b"a", b"b"]
        reader = Store(spark, root, FAMILIES, read_only=True)
        with pytest.raises(RejectedError):
            reader.write(WriteBatch().put("free", b"c", b""))
        store.put("free", b"c", b"")
        assert reader.get("free", b"c") is None
        assert reader.refresh()["applied"] == 1 and reader.get("free", b"c") == b""
        with pytest.raises(RejectedError):
            store.refresh()
        (tmp_path / "s" / "segments" / "foreign").mkdir()
        assert store.quarantined() == ["foreign"]
        assert store.scrub().count() == 0
        assert {r["segment"] for r in store.verify().collect()} == {s["id"] for s in store.manifest["segments"]}
    with pytest.raises(ConfigError):
        Store(spark, root, FAMILIES[:1])
    assert Store(spark, root, FAMILIES[:1], read_only=True).sequence > 1


def test_purge_and_large_append(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), FAMILIES) as store:
        rows = spark.range(500).select(F.lit("free").alias("cf"), F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("k"), F.lit(0).alias("kind"), F.encode(F.col("id").cast("string"), "utf-8").alias("v"), F.col("id").alias("nth_op"))
        assert store.append(rows, ["nth_op"]) == (1, 501)
        lsns = [r["lsn"] for r in store.log("free").orderBy("k").collect()]
        assert lsns == list(range(1, 501))
        with pytest.raises(ColumnFamilyNotFound):
            store.append(rows.withColumn("cf", F.lit("nope")), ["nth_op"])
        store.put("free", b"short", b"s")
        store.purge_below(490)
        assert store.count_prefix("free") == 501
        store.compact([s["id"] for s in store.manifest["segments"]])
        assert store.count_prefix("free") == 10 and store.get("free", b"short") is None


def test_appended_ranges_are_reshaped(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), FAMILIES) as store:
        rows = [("records", rec(7, a), 0, b"v", None, a) for a in range(4)] + [("records", b"\0\x07", 2, None, b"\0\x08", 10), ("records", b"b", 2, None, b"a", 11), ("records", rec(7, 9), 0, b"w", None, 12)]
        df = spark.createDataFrame([(c, bytearray(k), kind, None if v is None else bytearray(v), None if e is None else bytearray(e), n) for c, k, kind, v, e, n in rows], "cf string, k binary, kind int, v binary, range_end binary, n int")
        assert store.append(df, ["n"]) == (1, 7)
        assert dump(store, "records") == [(rec(7, 9), b"w")]


def test_follower(spark, tmp_path):
    rng, model = random.Random(3), Model()
    root = str(tmp_path / "s")
    with Store(spark, root, FAMILIES) as store:
        follower = Follower(spark, root, str(tmp_path / "state"))
        for _ in range(3):
            batch = random_batch(rng)
            store.write(batch)
            model.apply(batch)
            follower.follow(str(tmp_path / "offsets")).awaitTermination()
            seen = sorted((bytes(r["k"]), bytes(r["v"])) for r in follower.view().where("cf = 'records'").collect())
            assert seen == model.dump("records")
        assert follower.passes[-1]["highest_lsn"] == store.sequence - 1
        follower.apply(store.log(segments=[1]), 99)  # late: all of it is older
        assert sorted((bytes(r["k"]), bytes(r["v"])) for r in follower.view().where("cf = 'records'").collect()) == model.dump("records")
        follower.rebuild(store.log())
        assert follower.view().where("cf = 'records'").count() == len(model.dump("records"))


def test_reports_of_the_command_line(spark, tmp_path, capsys):
    import json

    from siltlog.__main__ import report

    with Store(spark, str(tmp_path / "s"), FAMILIES) as store:
        store.write(WriteBatch().put("free", b"a", b"1").put("free", b"a", b"22").delete("free", b"b"))
        made = {v: report(store, v) for v in ("cue", "stat", "spans", "verify")}
        assert [code for _, code in made.values()] == [0] * 4
        stat = json.loads(made["stat"][0].to_json())
        assert stat["sequence"] == 4 and stat["graves"] == 1 and {r["column"]: r["records"] for r in stat["columns"]} == {"records": 0, "blobs": 0, "free": 1, "unit": 0}
        assert "| segment |" in made["cue"][0].to_markdown() and "faults" in made["verify"][0].to_text()
        done, _ = report(store, "checkpoint", target=str(tmp_path / "copy"))
        assert done.figures["lsn"] == 3
        # flip a checksum
        bad = store.log().withColumn("crc", F.col("crc") + 1)
        from siltlog.operators.reports import faulty

        assert faulty(bad).count() == store.log().count()


def test_more_of_the_store(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store(spark, root, FAMILIES) as store:
        store.write(WriteBatch().put("free", b"a", b"12345").put("free", b"b", b"22").put("free", b"b", b"333").delete("free", b"c"))
        assert store.get_range("free", b"a", 1, 3) == b"234" and store.get_range("free", b"a", 9, 3) == b"" and store.get_range("free", b"z", 0, 1) is None
        assert store.size_of("free", b"b") == 3 and store.size_of("free", b"z") is None
        assert [bytes(r["k"]) for r in store.iter_keys_prefix("free").collect()] == [b"a", b"b"]
        assert [bytes(r["k"]) for r in store.iter_keys_from("free", b"b", False).collect()] == [b"b", b"a"]
        seen = []
        assert store.walk("free", b"", lambda k, v: seen.append((k, v)) or len(seen) < 1) == 1 and seen == [(b"a", b"12345")]
        seen.clear()
        assert store.walk("free", b"z", lambda k, v: seen.append(k) or True, ascending=False, hint=1) == 2 and seen == [b"b", b"a"]
        assert store.records(1).count() == 4 and [r["lsn"] for r in store.segment_footer(1).collect()] == [1, 3, 2, 4]
        with pytest.raises(RejectedError):
            store.records(7)
        store.register("free", "free_rows")
        assert spark.sql("SELECT count(*) AS n FROM free_rows").first()["n"] == 2
        assert {r["cf"]: r["blob_bytes"] for r in store.cf_disk_usage().collect()} == {"records": 0, "blobs": 0, "free": 8, "unit": 0}
        assert store.live_data_size_bytes() == 8 and store.dead_bytes() == 12 and store.disk_volumes()[0]["used"] > 0
        newest = store.records(1).where("lsn = 3").select(F.lit(1).alias("segment_id"), "file", "row")
        assert store.evict(newest) == {"evicted": 1} and store.get("free", b"b") == b"22"
        assert store.repair() == {"evicted": 0}


def test_an_unpublished_write_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    with Store(spark, root, FAMILIES) as store:
        store.put("free", b"a", b"1")
        for step in ("_publish", "_write_segment"):
            with monkeypatch.context() as m:
                m.setattr(store, step, lambda *a, **k: (_ for _ in ()).throw(OSError("crash")))
                with pytest.raises(OSError):
                    store.put("free", b"a", b"2")
            assert store.get("free", b"a") == b"1" and Store(spark, root, FAMILIES, read_only=True).get("free", b"a") == b"1"
        stale = dict(store.manifest)
        store.put("free", b"a", b"3")
        store.manifest = stale  # as another writer without the lock would have it
        with pytest.raises(RejectedError):
            store.put("free", b"a", b"4")
        assert Store(spark, root, FAMILIES, read_only=True).get("free", b"a") == b"3"


def test_capacity(spark, tmp_path):
    with pytest.raises(ConfigError):
        Store(spark, str(tmp_path / "s"), FAMILIES, capacity=10, reserve=10)
    with Store(spark, str(tmp_path / "s"), FAMILIES, capacity=20_000, reserve=1_000) as store:
        store.put("free", b"a", b"1")
        with pytest.raises(RejectedError):
            store.put("free", b"b", b"x" * 19_500)
        assert store.get("free", b"b") is None
