"""Resolution against a dict, over random logs; few and many range deletes."""

import random

import pytest
from pyspark.sql import functions as F

from siltlog.operators import compact as C
from siltlog.operators import pieces as P
from siltlog.operators import reads
from siltlog.operators import resolve as R
from siltlog.operators.schema import LOG


def make(spark, ops):
    rows = [("a", bytearray(k), lsn, kind, None if end is None else bytearray(end), bytearray(v) if kind == 0 else None, len(v or b""), 0, 0, False, lsn, 1) for lsn, kind, k, end, v in ops]
    return spark.createDataFrame(rows, LOG)


def oracle(ops, as_of=None):
    live = {}
    for lsn, kind, k, end, v in sorted(ops):
        if as_of is not None and lsn > as_of:
            break
        if kind == 0:
            live[k] = (lsn, v)
        elif kind == 1:
            live.pop(k, None)
        else:
            for x in [x for x in live if x >= k and (end is None or x < end)]:
                del live[x]
    return live


def random_ops(seed, n=300):
    rng, ops = random.Random(seed), []
    for lsn in range(1, n + 1):
        k = bytes([rng.randrange(20)]) * rng.randrange(1, 3)
        roll = rng.random()
        if roll < 0.6:
            ops.append((lsn, 0, k, None, bytes([rng.randrange(256)]) * rng.randrange(0, 5)))
        elif roll < 0.8:
            ops.append((lsn, 1, k, None, None))
        else:
            ops.append((lsn, 2, k, rng.choice([None, bytes([rng.randrange(22)]), bytes([k[0] + 2])]), None))
    rng.shuffle(ops)
    return ops


def got(df):
    return {bytes(r["k"]): (r["lsn"], bytes(r["v"])) for r in df.collect()}


def test_against_a_dict(spark):
    for seed in (1, 2):
        ops = random_ops(seed)
        log = make(spark, ops)
        for as_of in (None, 0, 77, 150):
            want = oracle(ops, as_of)
            assert got(R.resolve(log, as_of)) == want
            assert got(R.resolve(log, as_of, few=False)) == want


def test_a_relocated_copy_is_the_same_version(spark):
    log = make(spark, [(5, 0, b"k", None, b"v")])
    both = log.unionByName(log.withColumn("relocated", F.lit(True)).withColumn("segment_id", F.lit(9)))
    rows = R.resolve(both).collect()
    assert len(rows) == 1 and rows[0]["segment_id"] == 9


def test_covers_hide_only_older_ones(spark):
    log = make(spark, [(1, 0, b"a", None, b"x"), (2, 2, b"a", b"b", None), (3, 0, b"a", None, b"y"), (4, 2, b"z", b"z", None), (5, 2, b"z", b"a", None)])
    assert got(R.resolve(log)) == {b"a": (3, b"y")}
    assert got(R.resolve(log, 2)) == {}
    assert R.covers_of(log).count() == 1


@pytest.mark.parametrize("each", [1, 4])
def test_many_covers_by_pieces(spark, monkeypatch, each):
    """Ranges that end in their own piece, and that lie over many."""
    monkeypatch.setattr(P, "EACH", each)
    rng = random.Random(each)
    ops = []
    for lsn in range(1, 700):
        k = bytes([rng.randrange(256), rng.randrange(256)])
        if rng.random() < 0.5:
            ops.append((lsn, 0, k, None, b"v"))
        else:
            wide = rng.choice([1, 3, 40, 300])
            ops.append((lsn, 2, k, rng.choice([None] * (wide == 300) + [bytes([min(255, k[0] + wide), rng.randrange(256)])]), None))
    log = make(spark, ops).cache()
    want = oracle(ops)
    assert got(R.resolve(log, few=False)) == want and got(R.resolve(log, few=True)) == want
    covers = R.covers_of(log)
    pieces = P.Pieces(covers, covers.count())
    nodes = covers.select(F.size(pieces.nodes(F.col("start"), F.col("end"))).alias("n"), pieces.of(F.col("start")).alias("a"), pieces.last_of(F.col("end")).alias("b")).collect()
    assert len(pieces.cuts) > 20 and max(r["n"] for r in nodes) <= 2 * pieces.size.bit_length() < max(r["b"] - r["a"] for r in nodes)
    ranges, data = log.where("kind = 2 and lsn % 3 = 0"), log.where("kind = 0 and lsn % 2 = 0").select("cf", "k", "lsn")
    older = {(lsn) for lsn, kind, k, end, _ in ops if kind == 2 and lsn % 3 == 0 and any(x == 0 and n % 2 == 0 and n < lsn and j >= k and (end is None or j < end) for n, x, j, _, _ in ops)}
    for few in (False, True, None):
        assert {r["lsn"] for r in C.ranges_over_older(ranges, data, few).collect()} == older


def test_narrowed_lookups(spark, monkeypatch):
    ops = random_ops(8)
    log, want = make(spark, ops), oracle(ops)
    keys = [bytes([i]) for i in range(20)] + [b"\x03"]
    for bound in (R.BROADCAST_KEYS, 0):
        monkeypatch.setattr(R, "BROADCAST_KEYS", bound)
        asked = reads.key_list(spark, keys)
        for listed in (0, 256):
            monkeypatch.setattr(R, "LISTED_KEYS", listed)
            assert got(R.resolve(R.narrowed(log, "a", keys))) == {k: v for k, v in want.items() if k in keys}
        view = R.resolve(R.narrowed(log, "a", asked, len(keys)))
        assert got(view) == {k: v for k, v in want.items() if k in keys}
        rows = reads.get_many(view, "a", asked).collect()
        assert {r["pos"]: r["lsn"] for r in rows} == {i: want.get(k, (None,))[0] for i, k in enumerate(keys)}


def test_lookups_meet_their_keys_below_the_aggregation(spark):
    """Seven keys don't shuffle a family: the semi-join with them lies below the grouping."""
    view = R.resolve(R.narrowed(make(spark, random_ops(1, 20)), "a", reads.key_list(spark, [b"a", b"b"]), 2), few=True)
    plan = view._jdf.queryExecution().optimizedPlan().toString()
    grouped, joined = plan.index("Aggregate [cf"), plan.index("LeftSemi")
    assert grouped < joined


def some_hundred_covers():
    rng, ops = random.Random(5), []
    for lsn in range(1, 1200):
        k = bytes([rng.randrange(256), rng.randrange(256)])
        end = rng.choice([bytes([min(255, k[0] + rng.choice([0, 1, 60])), rng.randrange(256)]), None if lsn < 40 else b"\xff"])
        ops.append((lsn, 2, k, end, None) if lsn % 3 == 0 else (lsn, 0, k, None, b"v"))
    return ops


def test_some_hundred_covers_are_not_held_against_each_row(spark, monkeypatch):
    ops = some_hundred_covers()
    log, want = make(spark, ops).cache(), oracle(ops)
    covers = R.covers_of(log).count()
    assert 256 < covers <= 4096
    view = R.resolve(log)
    assert got(view) == want
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "BroadcastHashJoin" in plan
    monkeypatch.setattr(R, "LISTED_COVERS", 0)
    assert got(R.resolve(log)) == want
    both = make(spark, ops).unionByName(make(spark, ops).withColumn("cf", F.lit("b")))
    for bound in (0, 100_000):
        monkeypatch.setattr(R, "LISTED_COVERS", bound)
        view = R.resolve(both)
        assert all(got(view.where(F.col("cf") == cf)) == want for cf in "ab")


def test_ranges_meet_the_oldest_version_of_each_key(spark, monkeypatch):
    """However many versions a key has, one row of it stands in a piece."""
    ops = some_hundred_covers()
    log = make(spark, ops).cache()
    ranges, data = log.where("kind = 2"), log.where("kind = 0").select("cf", "k", "lsn")
    older = {lsn for lsn, kind, k, end, _ in ops if kind == 2 and any(x == 0 and n < lsn and j >= k and (end is None or j < end) for n, x, j, _, _ in ops)}
    for bound in (100_000, 0):
        monkeypatch.setattr(C, "LISTED_COVERS", bound)
        for few in (None, False):
            out = C.ranges_over_older(ranges, data, few)
            assert {r["lsn"] for r in out.collect()} == older
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert "min(lsn" in plan and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
