"""Rewriting any segments never changes a current read; accounting against a dict."""

import random

from pyspark.sql import functions as F
from test_resolve import got, make, random_ops

from siltlog.operators import accounting as acc
from siltlog.operators import compact
from siltlog.operators.resolve import resolve


def segmented(spark, seed, n=160, each=40):
    ops = random_ops(seed, n)
    return ops, make(spark, ops).withColumn("segment_id", (F.floor((F.col("lsn") - 1) / each) + 1).cast("int"))


def test_rewrites_keep_reads(spark):
    rng = random.Random(1)
    for seed in (3, 4):
        _, log = segmented(spark, seed)
        log = log.cache()
        want = got(resolve(log, few=True))
        for _ in range(2):
            picked = rng.sample([1, 2, 3, 4], rng.randrange(1, 4))
            after = log.where(~F.col("segment_id").isin(picked)).unionByName(compact.rewritten(log, picked).withColumn("segment_id", F.lit(9)))
            assert got(resolve(after, few=True)) == want, picked
            kept = {(r["lsn"], r["kind"]) for r in compact.carried_tombstones(log, picked).collect()}
            alive = {(r["lsn"], r["kind"]) for r in log.where(F.col("segment_id").isin(picked) & (F.col("kind") != 0)).collect()}
            assert kept <= alive


def test_bytes_and_floors(spark):
    ops, log = segmented(spark, 5)
    live = {lsn for lsn, _ in got(resolve(log, few=True)).values()}
    segs = {}
    for lsn, kind, k, end, v in ops:
        s = segs.setdefault((lsn - 1) // 40 + 1, {"live": 0, "dead": 0, "held": 0, "held_lsn": None, "lsns": []})
        span = 10 + (len(v) if kind == 0 else len(end or b"") if kind == 2 else 0)
        s["lsns"].append(lsn)
        if kind == 0 and lsn not in live:
            s["dead"] += span
        else:
            s["live"] += span
        if kind:
            s["held"] += span
            s["held_lsn"] = max(s["held_lsn"] or 0, lsn)
    # a range delete's length is that of its end
    log = log.withColumn("len", F.when(F.col("kind") == 2, F.coalesce(F.octet_length("range_end"), F.lit(0))).otherwise(F.col("len")))
    rows = {r["segment_id"]: r for r in acc.ranked(acc.segment_bytes(log)).collect()}
    for i, s in segs.items():
        r, floor = rows[i], min(min(x["lsns"]) for j, x in segs.items() if j != i)
        drop = s["held"] if s["held_lsn"] is not None and s["held_lsn"] < floor else 0
        assert (r["live"], r["dead"], r["held"], r["held_lsn"], r["floor"], r["droppable"]) == (s["live"], s["dead"], s["held"], s["held_lsn"], floor, drop)
        assert abs(r["fraction"] - (s["dead"] + drop) / (s["live"] + s["dead"])) < 1e-12


def test_overlap_depth_counts_touching_ends(spark):
    rows = [("a", 1, b"a", b"c"), ("a", 2, b"c", b"e"), ("a", 3, b"d", b"f"), ("b", 4, b"a", b"z"), ("b", 5, b"x", b"y")]
    spans = spark.createDataFrame([(c, s, bytearray(x), bytearray(y)) for c, s, x, y in rows], "cf string, segment_id int, low binary, high binary")
    assert acc.overlap_depth(spans).first()["depth"] == 2
    assert acc.overlap_depth(spans, 2).first()["depth"] == 4
    assert acc.overlap_depth(spans.limit(0)).first()["depth"] == 0
