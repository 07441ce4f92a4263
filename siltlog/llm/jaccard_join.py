"""Exact self-join on the Jaccard similarity of word 5-shingles, as components.

Words are what lies between ASCII white space, A-Z lower-cased; a document's set holds its distinct 5-word shingles, or its
whole word sequence if it has fewer; two documents link when 100 * |x & y| >= 75 * |x | y|. Shingles are 64-bit hashes.

1. Equal sets become one class, named by its smallest id; all else is done on classes.
2. Quick links: banded minima of each set; in a band's group each class is compared with one other, so that large groups
   of near copies fall into few provisional components with a number of comparisons that is linear in their size.
3. Token-combination prefixes: shingles are ordered by a table of counters, rare ones first. A set's prefix is extended
   until any e shingles may be missing from it (e: how many a partner at 75 % can lack) and a signature still remains:
   a single shingle of the rare class, or a 2-combination within one of SUBCLASSES parts of the frequent class, where
   n shingles of a part stand for n - 1. Sets too small for that index the first e + 1 shingles of the order as well.
   Two sets that link share a signature. Signatures seen in one provisional component only have nothing to add.
4. What remains are pairs across provisional components that share a signature, within the size ratio; a parity bitmap
   bounds their overlap from above. The rest are verified on their whole sets. No candidate is capped or dropped.

Cases: null and blank texts have an empty set and link with nothing; rows with a null id link with nothing and have no
component; rows with one id are one document; repeated rows link; ties don't matter, as the smallest id names; an empty
table gives an empty result; texts are taken whole; other columns are dropped by name before any are added.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Memo, Scratch, keep_ids, small, tidy

WORDS, PERCENT = 5, 75
BANDS, MINIMA, BITMAP, WIDE = 8, 16, 16, 256
#: The map of signatures seen in several components has 2**SEEN bits: 16 MB.
SEEN = 27
#: Shingles held to be frequent have 256 documents more than the average counter; parts of the frequent class.
FREQUENT, SUBCLASSES = 256, 32
#: Signatures of at most FEW rows give all their pairs; of the others, a row carries the FIRSTS first of its class.
FEW, FIRSTS = 8, 8
_CACHE = 200_000
_CHUNK = 1 << 16
_U = np.uint64
_FACTORS = (np.arange(1, MINIMA + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def shingles(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode().lower().split() if text else []
    w = np.array([known[x] for x in words], _U)
    if not len(w):
        return w
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, _U)
    for i in range(size):
        h = (h + w[i : len(w) - size + 1 + i]) * _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
    h = np.sort(_mixed(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def band_keys(h: np.ndarray) -> np.ndarray:
    least = (h[None, :] * _FACTORS[:, None]).min(axis=1)
    return _mixed(least[0::2] * _U(0x9E3779B97F4A7C15) + least[1::2] + np.arange(BANDS, dtype=_U))


def parity_bitmap(h: np.ndarray, words: int = BITMAP) -> np.ndarray:
    """``words`` words of 64 bits; bit i is the parity of the number of shingles that fall on it."""
    counts = np.bincount((h & _U(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").view(_U)


def missing_at_most(n: int) -> int:
    """How many of n shingles a linked partner can lack."""
    return n - -(-PERCENT * n // 100)


def signatures(h: np.ndarray, levels: np.ndarray, frequent_level: int) -> np.ndarray:
    """The distinct signatures of a set under a table of levels (a power of two long, by the hashes' highest bits)."""
    level = levels[(h >> _U(64 - (len(levels) - 1).bit_length())).astype(np.int64)]
    order = np.lexsort((h, level))
    h, frequent = h[order], level[order] > frequent_level
    need = missing_at_most(len(h)) + 1
    rare = int(len(h) - frequent.sum())
    if rare >= need:
        return np.sort(_mixed(h[:need]))
    more = h[rare:]
    part = (more & _U(SUBCLASSES - 1)).astype(np.int64)
    again = np.ones(len(more), np.int64)
    again[np.unique(part, return_index=True)[1]] = 0
    covered = rare + np.cumsum(again)
    end = int(np.searchsorted(covered, need)) + 1
    out = [_mixed(h[:rare])]
    for p in np.unique(part[:end]):
        own = more[:end][part[:end] == p]
        i, j = np.triu_indices(len(own), 1)
        out.append(_mixed(own[i] * _U(0xA0761D6478BD642F) + own[j]))
    if covered[-1] < need:
        out.append(_mixed(h[:need] ^ _U(0xE7037ED1A0B428DB)))
    return np.unique(np.concatenate(out))


def _longs(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def _list(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _longs(np.concatenate(arrays) if arrays else np.zeros(0, _U)))


def _sets(batches):
    """(batch, the sets of its texts)."""
    known = Memo(xxhash.xxh3_64_intdigest, _CACHE)
    for batch in batches:
        yield batch, [shingles(t, known) for t in batch.column(1).to_pylist()]


def _described(docs: DataFrame, counters: int) -> DataFrame:
    """A row for each of docs, and rows of counters (chunk, counts) for each partition."""
    bits = counters.bit_length() - 1
    names = ["id", "n", "digest", "keys", "bitmap", "chunk", "counts"]

    def describe(batches):
        counts = np.zeros(counters, np.uint32)
        kind = None
        for part, sets in _sets(batches):
            kind = part.column(0).type
            flat = np.concatenate(sets)
            counts += np.bincount((flat >> _U(64 - bits)).astype(np.int64), minlength=counters).astype(np.uint32)
            full = [len(h) > 0 for h in sets]
            none = np.zeros(0, _U)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(h.tobytes()) if f else None for h, f in zip(sets, full)], pa.binary()), _list([band_keys(h) if f else none for h, f in zip(sets, full)]), _list([parity_bitmap(h) if f else none for h, f in zip(sets, full)]), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())],
                names=names,
            )
        if kind is not None:
            chunks = [(i, zlib.compress(counts[i * _CHUNK : (i + 1) * _CHUNK].tobytes(), 1)) for i in range(counters // _CHUNK)]
            m = len(chunks)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64())), pa.array([i for i, _ in chunks], pa.int32()), pa.array([c for _, c in chunks], pa.binary())], names=names)

    return docs.mapInArrow(tidy(describe), "id long, n long, digest binary, keys array<long>, bitmap array<long>, chunk int, counts binary")


def _levels(rows: DataFrame, counters: int) -> tuple[np.ndarray, int]:
    """A level of frequency for each counter (one byte; at most 2**24), and the highest that isn't frequent."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64)
                sums[chunk] = sums[chunk] + own if chunk in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    total = np.zeros(counters, np.int64)
    for chunk, data in rows.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(tidy(add), "chunk int, counts binary").toLocalIterator():
        total[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(zlib.decompress(data), np.int64)
    mean = total.mean()
    over = total - mean
    seen = over > max(4 * math.sqrt(mean), 1)
    levels = np.where(seen, 1 + np.floor(2 * np.log2(np.where(seen, over, 1))), 0).astype(np.uint8)
    return levels, 1 + 2 * int(math.log2(FREQUENT))


def _within(n: Column, m: Column) -> Column:
    return (n * 100 >= m * PERCENT) & (m * 100 >= n * PERCENT)


def _bound(x: str, y: str, n: Column, m: Column) -> Column:
    """Whether bitmaps x and y leave room for a link: |x & y| <= (n + m - differing bits) / 2."""
    differ = sum((F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i))) for i in range(BITMAP)), F.lit(0))
    return (100 + PERCENT) * (n + m - differ) >= 2 * PERCENT * (n + m)


def _verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Those of pairs (a, b) that link, by their whole sets, once a wider bitmap has ruled out most of the long ones."""

    def ends(of: DataFrame, name: str) -> DataFrame:
        return scratch.keep(of.select(F.col("a").alias("id")).union(of.select("b")).distinct(), f"{label}-{name}")

    def wide(batches):
        for part, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(h) for h in sets], pa.int64()), _list([parity_bitmap(h, WIDE) for h in sets])], names=["id", "n", "wide"])

    def whole(batches):
        for part, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _list(sets)], names=["id", "set"])

    maps = scratch.keep(keep_ids(docs, ends(pairs, "ids"), "id").mapInArrow(tidy(wide), "id long, n long, wide array<long>"), f"{label}-wide")
    differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    near = pairs.join(maps.toDF("a", "n", "x"), "a").join(maps.toDF("b", "m", "y"), "b").where((100 + PERCENT) * (F.col("n") + F.col("m") - differ) >= 2 * PERCENT * (F.col("n") + F.col("m")))
    near = scratch.keep(near.select("a", "b").distinct(), f"{label}-near")
    scratch.drop(f"{label}-wide")
    sets = scratch.keep(keep_ids(docs, ends(near, "near-ids"), "id").mapInArrow(tidy(whole), "id long, set array<long>"), f"{label}-sets")
    both = near.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links = both.where((100 + PERCENT) * shared >= PERCENT * (F.size("x") + F.size("y"))).select("a", "b").distinct()
    links = scratch.keep(links, f"{label}-links")
    scratch.drop(f"{label}-ids", f"{label}-near", f"{label}-near-ids", f"{label}-sets")
    return links


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _with_room(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that sizes and bitmaps leave room for a link."""
    ends = classes.select("node", "n", "bitmap")
    both = pairs.join(ends.toDF("a", "n", "x"), "a").join(ends.toDF("b", "m", "y"), "b")
    return both.where(_within(F.col("n"), F.col("m")) & _bound("x", "y", F.col("n"), F.col("m"))).select("a", "b")


def _quick_pairs(classes: DataFrame) -> DataFrame:
    """Each class with one other of every band group that holds both, if their bitmaps leave room for a link."""
    keyed = classes.select("node", F.explode("keys").alias("key"))
    one = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min_by("node", F.xxhash64("node", "key")).alias("other")).where("c > 1").select("key", "other")
    pairs = keyed.join(one, "key").where("node <> other").select(*_ordered("node", "other")).distinct()
    return _with_room(pairs, classes)


def _across(indexed: DataFrame, shingles: int) -> np.ndarray:
    """A bitmap of 2**SEEN bits by the highest bits of signatures: set for those in more than one provisional component.

    Pairs (signature, component) are made distinct batch by batch, cut to the 32 bits below those of their bucket, and dealt
    by bucket, with some half a million to a bucket; each bucket answers for its own stretch of the bitmap. Cut or clashing
    signatures can only set bits too many, which the join on whole signatures undoes.
    """
    bits = min(24, max(4, math.ceil(math.log2(max(1, shingles * (100 - PERCENT) / 100) / (1 << 19)))) if shingles else 4)
    region = SEEN - bits

    def gathered(batches):
        held, n = [], 0
        for batch in batches:
            sigs = batch.column(1)
            held.append((sigs.flatten().to_numpy(zero_copy_only=False).view(_U), np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(sigs.offsets.to_numpy()))))
            n += len(held[-1][0])
            if n > 1_000_000:
                yield held
                held, n = [], 0
        if held:
            yield held

    def deal(batches):
        for held in gathered(batches):
            flat, owner = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((owner, flat))
            flat, owner = flat[order], owner[order]
            first = np.concatenate([[True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])]) if len(flat) else np.zeros(0, bool)
            flat, owner = flat[first], owner[first]
            bucket = (flat >> _U(64 - bits)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            low = (flat >> _U(32 - bits)).astype(np.uint32)
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([low[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()), pa.array([owner[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary())], names=["bucket", "low", "part"])

    def gather(key, table):
        low = np.concatenate([np.frombuffer(x, np.uint32) for x in table["low"].to_pylist()])
        part = np.concatenate([np.frombuffer(x, np.int64) for x in table["part"].to_pylist()])
        order = np.lexsort((part, low))
        low, part = low[order], part[order]
        seen = np.zeros(1 << region, bool)
        seen[low[1:][(low[1:] == low[:-1]) & (part[1:] != part[:-1])] >> np.uint32(32 - region)] = True
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([zlib.compress(np.packbits(seen, bitorder="little").tobytes(), 1)], pa.binary())})

    dealt = indexed.select("part", "sigs").mapInArrow(tidy(deal), "bucket int, low binary, part binary")
    out = np.zeros(1 << (SEEN - 3), np.uint8)
    size = 1 << (region - 3)
    for bucket, data in dealt.groupBy("bucket").applyInArrow(gather, "bucket int, bits binary").toLocalIterator():
        out[bucket * size : (bucket + 1) * size] = np.frombuffer(zlib.decompress(data), np.uint8)
    return out


def _crossing(rows: DataFrame) -> DataFrame:
    """Those of rows (sig, part, ...) whose signature is in more than one provisional component, with the number of its rows."""
    met = rows.groupBy("sig").agg(F.count("*").alias("size"), F.min("part").alias("least"), F.max("part").alias("most"))
    return rows.join(met.where("least <> most").select("sig", "size"), "sig")


def _met(indexed: DataFrame, shingles: int, scratch: Scratch) -> DataFrame:
    """sig, node, part and size: a row for each class and signature of it that is in several provisional components."""
    seen = indexed.sparkSession.sparkContext.broadcast(_across(indexed, shingles))

    def sift(batches):
        for batch in batches:
            sigs = batch.column(2)
            flat = sigs.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(batch), dtype=np.int32), np.diff(sigs.offsets.to_numpy()))
            at = flat.view(_U) >> _U(64 - SEEN)
            hit = (seen.value[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1
            took = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit], pa.int64()), batch.column(0).take(took), batch.column(1).take(took)], names=["sig", "node", "part"])

    held = scratch.keep(indexed.select("node", "part", "sigs").mapInArrow(tidy(sift), "sig long, node long, part long"), "held")
    scratch.drop("indexed")
    met = scratch.keep(_crossing(held), "met")
    scratch.drop("held")
    return met


def _few_pairs(met: DataFrame) -> DataFrame:
    """All pairs across components of signatures with at most FEW rows, of which many have the same members."""
    members = met.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("node", "part"))).alias("m")).select("m").distinct()
    others = lambda x: F.filter("m", lambda y: (y["node"] > x["node"]) & (y["part"] != x["part"]))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(others(x), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    return members.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def _hub_pairs(met: DataFrame) -> DataFrame:
    """One class of each provisional component of a signature with one class of the signature: as many as there are components."""
    own = met.groupBy("sig", "part").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("own"))
    hubs = own.groupBy("sig").agg(F.min("own").alias("hub"))
    return own.join(hubs, "sig").where("own.node <> hub.node").select(*_ordered("own.node", "hub.node")).distinct()


def _many_pairs(met: DataFrame, parts: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of classes of different components ``parts`` that share a signature of met and may link.

    A pair shares many signatures; it is made at the first of them only: a row carries the FIRSTS first signatures of its class,
    and a pair is left out where both have an earlier one in common. The main component of a signature isn't paired with itself.
    """
    rows = met.select("sig", "node").join(parts, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("part"))
    rows = scratch.keep(_crossing(rows).select("sig", "node", "part"), "many")
    firsts = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, FIRSTS).alias("firsts"))
    mains = rows.groupBy("sig", "part").count().groupBy("sig").agg(F.max(F.struct("count", "part"))["part"].alias("main"))
    facts = classes.select("node", "n", "bitmap").join(firsts, "node")
    full = scratch.keep(rows.join(mains, "sig").join(facts, "node"), "full")
    one = full.where("part <> main").select("sig", F.col("node").alias("a"), F.col("n").alias("na"), F.col("part").alias("pa"), F.col("bitmap").alias("x"), F.col("firsts").alias("fa"))
    other = full.select("sig", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("part").alias("pb"), F.col("bitmap").alias("y"), F.col("firsts").alias("fb"), "main")
    once = (F.col("pb") == F.col("main")) | (F.col("a") < F.col("b"))
    room = _within(F.col("na"), F.col("nb")) & _bound("x", "y", F.col("na"), F.col("nb"))
    first = ~F.exists(F.array_intersect("fa", "fb"), lambda s: s < F.col("sig"))
    return one.join(other, "sig").where((F.col("pa") != F.col("pb")) & once & room & first).select(*_ordered("a", "b")).distinct()


def jaccard_components(df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id that links reach) of each row of df."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    counters = 1 << min(24, max(16, math.ceil(math.log2(size / 200 + 1))))  # some 30 shingles a counter, up to 16 MB of levels
    rows = scratch.keep(_described(docs, counters), "rows")
    sets = rows.where("chunk is null")
    classes = scratch.keep(sets.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bitmap").alias("bitmap")), "classes")
    quick = _verified(scratch.keep(_quick_pairs(classes), "quick-pairs"), docs, scratch, "quick")
    parts = connected_components(quick, scratch, "parts")

    levels, highest = _levels(rows, counters)
    members = sets.select("id", "n", "digest").join(classes.select("digest", "node"), "digest", "left").select("id", "n", "node")
    members = scratch.keep(members, "members")
    scratch.drop("rows", "quick-pairs")
    copies = scratch.keep(members.where("id <> node").select("id").distinct(), "copies")
    shared = df.sparkSession.sparkContext.broadcast(levels)

    def index(batches):
        for part, found in _sets(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _list([signatures(h, shared.value, highest) if len(h) else h for h in found])], names=["node", "sigs"])

    indexed = keep_ids(docs.where("id is not null"), copies, "id", "left_anti").mapInArrow(tidy(index), "node long, sigs array<long>").where(F.size("sigs") > 0)
    indexed = indexed.join(F.broadcast(parts) if small(parts) else parts, "node", "left").select("node", F.coalesce("component", "node").alias("part"), "sigs")
    indexed = scratch.keep(indexed, "indexed")
    total = classes.agg(F.sum("n").alias("n")).first()["n"] or 0
    met = _met(indexed, total, scratch)
    few, many = met.where(F.col("size") <= FEW), met.where(F.col("size") > FEW)
    tried = scratch.keep(_with_room(_few_pairs(few).union(_hub_pairs(many)).distinct(), classes), "tried")
    links = scratch.keep(quick.union(_verified(tried, docs, scratch, "tried")), "links")
    if not many.isEmpty():
        left = _many_pairs(many, connected_components(links, scratch, "tried-parts"), classes, scratch)
        left = scratch.keep(left.join(tried, ["a", "b"], "left_anti"), "left")
        links = links.union(_verified(left, docs, scratch, "left"))
    ends = connected_components(links, scratch, "ends")
    scratch.drop("classes", "copies", "met", "tried", "many", "full", "left")
    out = members.join(F.broadcast(ends) if small(ends) else ends, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "node", "id").alias("component_id"))


def keep_one(df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """The rows of df that name their component, each once; rows with a null id all stay."""
    found = scratch.keep(jaccard_components(df, id_col, text_col, scratch).select(id_col, "component_id"), "found")
    gone = scratch.keep(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "gone")
    kept = keep_ids(df, gone, id_col, "left_anti")
    twice = scratch.keep(found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "twice")
    if twice.isEmpty():
        return kept
    return keep_ids(kept, twice, id_col, "left_anti").unionByName(keep_ids(kept, twice, id_col).dropDuplicates([id_col]))
