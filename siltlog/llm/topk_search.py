"""Exact top-k by integer inner product, over a bit-sliced index.

Components become floor(256 * x). A block of rows keeps, for each dimension, the bit slices of its values without
their DROP lowest bits: one bitmap over the rows for each bit. For a query, slices are added with bitmap arithmetic
(carry-save adders, weighted by the bits of the query's components) into the slices of an upper bound of the score.
Going down from the most significant slice, the set of rows that are sure to be above is kept apart from those still
tied, until K rows are certain: this gives the K-th largest bound. A row of the true top-k has a bound no further
below it than the dropped bits can amount to, so that boundary rows are found by one more comparison with the sum's slices
and resolved by their exact scores. Ties go to the smaller id.

Rows are dealt to blocks of at most BLOCK rows and BLOCK_BYTES, whose slices are built and written once; blocks of QUERIES queries,
as large at most, are sent to all of them in turn, so that neither rows nor slices are shuffled again. Only K rows a query and block leave a task.

Cases: vectors that are null or hold null or non-finite components take no part; vectors of other lengths than a
query are no candidates of it, as no inner product is defined; a null id takes no part;
repeated ids are rows of their own, but a query skips all rows with its own id; an empty table gives an empty result.
Finite components of any size count: those beyond NARROW are multiplied as exact integers, apart from the index, and scores are
ranked exactly; one beyond 64 bits is returned as the nearest long.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, tidy

BLOCK, QUERIES, DROP = 16_384, 16_384, 2
#: Bytes of a block's vectors at most, as long as it has 64 rows.
BLOCK_BYTES = 32 << 20
#: Integers below this go into the index: sums of up to 2**14 products stay below 2**62.
NARROW, _LONGEST = 1 << 24, 1 << 14
_MAX = (1 << 63) - 1
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def usable(vector: Column) -> Column:
    """The components as doubles; null if the vector takes no part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, v)


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as exact integers: int64 if all are below NARROW, else Python's."""
    with np.errstate(over="ignore"):
        v = np.floor(256 * x)
    if (np.abs(v) < NARROW).all() and x.shape[-1] <= _LONGEST:
        return v.astype(np.int64)
    return np.array([math.floor(y) if math.isfinite(y) else 256 * int(z) for y, z in zip(v.ravel().tolist(), x.ravel().tolist())], object).reshape(x.shape)


def beyond_key(score: int) -> bytes | None:
    """What orders scores that don't fit a long, as bytes."""
    if abs(score) < _MAX:
        return None
    n = (abs(score).bit_length() + 7) // 8
    if score > 0:
        return (0x8000 + n).to_bytes(2) + score.to_bytes(n)
    return (0x8000 - n).to_bytes(2) + ((1 << 8 * n) - 1 + score).to_bytes(n)


def _bitmap(flags: np.ndarray) -> np.ndarray:
    """Bool rows as uint64 words, 64 rows a word."""
    raw = np.packbits(flags, axis=-1, bitorder="little")
    pad = -raw.shape[-1] % 8
    return np.pad(raw, [(0, 0)] * (raw.ndim - 1) + [(0, pad)]).view(np.uint64)


def _rows(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


class BitSlicedIndex:
    """The slices of one block: vectors is an int array of rows x dimensions; written are the slices as they were made, if any."""

    def __init__(self, vectors: np.ndarray, written: bytes | None = None):
        self.vectors, self.n = vectors, len(vectors)
        self.low = vectors.min(axis=0)
        self.bits = [int(x).bit_length() for x in (vectors.max(axis=0) - self.low) >> DROP]
        if written is None:
            coarse = (vectors - self.low) >> DROP
            self.slices = [[_bitmap((coarse[:, d] >> b) & 1 == 1) for b in range(k)] for d, k in enumerate(self.bits)]
        else:
            each = iter(np.frombuffer(written, np.uint64).reshape(-1, (self.n + 63) // 64))
            self.slices = [[next(each) for _ in range(k)] for k in self.bits]
        self.flipped = [[~s for s in of] for of in self.slices]
        self.valid = _bitmap(np.ones(self.n, bool))

    def bound(self, query: np.ndarray) -> tuple[list[np.ndarray], int, int]:
        """Slices of an unsigned sum, the constant to add for an upper bound of the score, and how far below it the score may be.

        For q > 0 a value v = low + (coarse << DROP) + r gives at most q * (low + 2**DROP - 1 + (coarse << DROP)).
        For q < 0 it gives q * (low + ((2**k - 1) << DROP)) + |q| * (flipped << DROP) at most, flipped being coarse's complement.
        """
        columns: list[list[np.ndarray]] = [[] for _ in range(64)]
        constant = slack = 0
        rest = (1 << DROP) - 1
        for d, q in enumerate(query.tolist()):
            if not q:
                continue
            slack += abs(q) * rest
            if q > 0:
                constant += q * (int(self.low[d]) + rest)
                own = self.slices[d]
            else:
                constant += q * (int(self.low[d]) + (((1 << self.bits[d]) - 1) << DROP))
                own = self.flipped[d]
            weight, j = abs(q), 0
            while weight:
                if weight & 1:
                    for b, s in enumerate(own):
                        columns[j + b].append(s)
                weight >>= 1
                j += 1
        out = []
        for c in range(63):  # carry-save: three bitmaps of a weight become one, and a carry of twice the weight
            at = columns[c]
            while len(at) >= 3:
                x, y, z = at.pop(), at.pop(), at.pop()
                half = x ^ y
                at.append(half ^ z)
                columns[c + 1].append((x & y) | (half & z))
            if len(at) == 2:
                x, y = at
                at[:] = [x ^ y]
                columns[c + 1].append(x & y)
            out.append(at[0] if at else None)
        while out and out[-1] is None:
            out.pop()
        return [np.zeros_like(self.valid) if s is None else s for s in out], constant, slack

    def top(self, query: np.ndarray, k: int, allowed: np.ndarray) -> np.ndarray:
        """Rows that may be among the k best of ``allowed``: at least k, if there are so many."""
        sums, _, slack = self.bound(query)
        sure, tied, kth = np.zeros_like(self.valid), allowed.copy(), 0
        for b in range(len(sums) - 1, -1, -1):
            more = sure | (tied & sums[b])
            if int(np.bitwise_count(more).sum()) >= k:
                tied &= sums[b]
                kth |= 1 << b
            else:
                sure = more
                tied &= ~sums[b]
        # kth, over 2**DROP, is the k-th largest sum; the least that the k-th best score's row may have:
        least = max(0, ((kth << DROP) - slack + (1 << DROP) - 1) >> DROP)
        above, equal = np.zeros_like(self.valid), allowed.copy()
        for b in range(max(len(sums), least.bit_length()) - 1, -1, -1):
            s = sums[b] if b < len(sums) else np.zeros_like(self.valid)
            if least >> b & 1:
                equal &= s
            else:
                above |= equal & s
                equal &= ~s
        return _rows(above | equal, self.n)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Which rows of x go into the index."""
    with np.errstate(over="ignore"):
        return (np.abs(np.floor(256 * x)) < NARROW).all(axis=1) & (x.shape[1] <= _LONGEST)


def _index(key, block: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: ids and components of its rows, those of the index first, and their slices."""
    x, ids = np.stack(block["v"].to_numpy()), block["vec_id"].to_numpy(np.int64)
    narrow = _narrow(x)
    order = np.argsort(~narrow, kind="stable")
    x, ids, n = x[order], ids[order], int(narrow.sum())
    made = BitSlicedIndex(quantised(x[:n])).slices if n else []
    slices = b"".join(s.tobytes() for of in made for s in of)
    return pd.DataFrame({"dims": [x.shape[1]], "n": [n], "ids": [ids.tobytes()], "x": [x.tobytes()], "slices": [slices]})


class _Block:
    def __init__(self, dims: int, n: int, ids: bytes, x: bytes, slices: bytes):
        self.ids, self.n, self.x = np.frombuffer(ids, np.int64), n, np.frombuffer(x).reshape(-1, dims)
        self.index = BitSlicedIndex(quantised(self.x[:n]), slices) if n else None
        self.wide = quantised(self.x[n:]).astype(object)

    def best(self, own: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows for a query."""
        found: list[tuple[int, int]] = []
        if self.n and q.dtype != object:
            rows = self.index.top(q, k, self.index.valid & _bitmap(self.ids[: self.n] != own))
            found += zip((self.index.vectors[rows] @ q).tolist(), self.ids[rows].tolist())
        elif self.n:
            found += ((s, i) for s, i in zip(self.index.vectors.astype(object) @ q, self.ids[: self.n].tolist()) if i != own)
        if len(self.wide):
            found += ((s, i) for s, i in zip(self.wide @ q.astype(object), self.ids[self.n :].tolist()) if i != own)
        return sorted(found, key=lambda f: (-f[0], f[1]))[:k]


def search_top_k(df: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int, scratch: Scratch) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best of all other rows for each row where is_query holds."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), usable(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = scratch.keep(rows.where("v is not null").withColumn("row", F.monotonically_increasing_id()).withColumn("dims", F.size("v")), "rows")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max("dims").alias("dims")).first()
    bounded = lambda most: max(1, min(most, max(64, BLOCK_BYTES // (8 * (sizes["dims"] or 1)))))
    blocks, asked = max(1, math.ceil(sizes["n"] / bounded(BLOCK))), math.ceil(sizes["q"] / bounded(QUERIES))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("b")
    index = rows.select("vec_id", "v", "dims", block).groupBy("b", "dims").applyInPandas(_index, "dims int, n long, ids binary, x binary, slices binary")
    index = scratch.keep(index.repartition(blocks if blocks <= 64 else math.ceil(blocks / 8)), "index")
    queries = rows.where("asks").select("row", "vec_id", "v", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(max(1, asked))).alias("a"))
    kind, found = "row long, query_id long, vec_id long, score long, beyond binary", []
    for a in range(asked):
        sent = df.sparkSession.sparkContext.broadcast([tuple(c.to_numpy(zero_copy_only=False) for c in queries.where(F.col("a") == a).select("row", "vec_id", "v").toArrow().columns)])

        def search(batches, sent=sent):
            asks = [(row, own, quantised(np.asarray(v))) for row, own, v in zip(*sent.value[0])]
            for batch in batches:
                for dims, n, ids, x, slices in zip(*(c.to_pylist() for c in batch.columns)):
                    held, out = _Block(dims, n, ids, x, slices), []
                    for row, own, q in asks:
                        if len(q) == dims:
                            out += [(row, own, i, max(-_MAX - 1, min(_MAX, s)), beyond_key(s)) for s, i in held.best(own, q, k)]
                    columns = list(zip(*out)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["row", "query_id", "vec_id", "score", "beyond"])

        found.append(index.mapInArrow(tidy(search), kind))
    if not found:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    # next to the largest long come those that are beyond it, the same below
    high = F.when(F.col("score") > 0, F.col("beyond")).desc_nulls_last()
    low = F.when(F.col("score") < 0, F.col("beyond")).desc_nulls_first()
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), high, low, "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
