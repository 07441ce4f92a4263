import random
import zlib

from helpers import TEXTS, awkward, empty

from siltlog.llm import sharding as H


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    held = {s: [r for r in rows if r["shard"] == s] for s in range(shards)}
    assert sum(map(len, held.values())) == len(rows)
    for own in held.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    total, largest = sum(s for s, _ in want), max(s for s, _ in want)
    assert all(abs(sum(r["size"] for r in own) - total / shards) <= largest for own in held.values())


def test_awkward_rows(spark):
    check(H.shard_documents(spark, awkward(spark), 3).collect(), [t for _, t in TEXTS], 3)
    assert H.shard_documents(spark, empty(spark), 8).count() == 0


def test_a_hot_group_is_subdivided(spark):
    rng = random.Random(1)
    texts = [f"{rng.random()} " * rng.randrange(1, 30) for _ in range(600)] + ["the same again and again"] * 900
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = H.shard_documents(spark, df, 8).collect()
    check(rows, texts, 8)
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8 + 2 * max(r["size"] for r in rows)


def test_equal_texts_lie_together(spark):
    texts = [f"text {i // 4}" for i in range(400)]
    rows = H.shard_documents(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()
    split = {}
    for r in rows:
        split.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in split.values()) <= 3


def test_range_search(spark):
    from pyspark.sql import functions as F

    cuts = [3, 7, 8, 20, 21]
    got = {r[0]: r[1] for r in spark.range(30).select("id", H.range_of(F.col("id"), cuts)).collect()}
    assert got == {i: sum(c <= i for c in cuts) for i in range(30)}


def test_against_brute_force(spark):
    """Without a hot group, the order is that of the hashes; places, shards and slots follow from plain running sums, whatever the files."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    texts = [f"{rng.random()} " * rng.randrange(1, 40) for _ in range(500)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = df.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 11).alias("h"), F.xxhash64("doc_id", F.lit(7)).alias("salt")).collect()
    order = sorted(keyed, key=lambda r: (r["h"], r["salt"], r["doc_id"]))
    total, at, want, slots = sum(len((t or "").encode()) + 1 for t in texts), 0, {}, {}
    for r in order:
        size = len((r["text"] or "").encode()) + 1
        shard = min(4, (at + size - size // 2 - 1) * 5 // total)
        want[r["doc_id"]] = (shard, slots.get(shard, 0))
        slots[shard] = slots.get(shard, 0) + 1
        at += size
    for given in (df, df.orderBy(F.desc("doc_id")).repartition(7)):
        assert {r["doc_id"]: (r["shard"], r["slot"]) for r in H.shard_documents(spark, given, 5).collect()} == want
