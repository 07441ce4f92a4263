import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltlog.llm import topk_search as K
from siltlog.llm.shared import Scratch


def brute(rows, k, asks):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if asks(q):
            scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b)))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(1, 6), st.integers(1, 7), st.randoms(use_true_random=False))
def test_index_keeps_every_true_row(n, dims, k, rng):
    width = rng.choice([1, 3, 300])
    v = np.array([[rng.randint(-width, width) for _ in range(dims)] for _ in range(n)])
    q = np.array([rng.randint(-width, width) for _ in range(dims)])
    index = K.BitSlicedIndex(v)
    off = rng.randrange(n)
    flags = np.arange(n) != off
    got = set(index.top(q, k, index.valid & K._bitmap(flags)).tolist())
    order = sorted((-int(v[i] @ q), i) for i in range(n) if i != off)
    assert {i for _, i in order[:k]} <= got
    assert off not in got


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 40)
    monkeypatch.setattr(K, "QUERIES", 7)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.12) for _ in range(12)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(300, None), (301, []), (302, [None] * 12), (303, [float("nan")] * 12), (304, [float("inf")] * 12), (None, rows[1][1]), (50, [0.0] * 12), (305, [0.1, 0.2])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in K.search_top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5, Scratch(spark, "t")).collect())
    want = brute(exact, 5, lambda q: q % 50 == 0)
    assert got == sorted(want)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [0.25])], "vec_id long, embedding array<float>")
    ask = F.col("vec_id") % 50 == 0
    assert [tuple(r) for r in K.search_top_k(df, "vec_id", "embedding", ask, 5, Scratch(spark, "t")).collect()] == [(0, 1, 1, 128 * 64)]
    assert K.search_top_k(df.limit(0), "vec_id", "embedding", ask, 5, Scratch(spark, "t")).count() == 0


def clamped(rows):
    return sorted((q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in rows)


def test_large_finite_components(spark):
    """Beyond 32 bits, beyond 64 bits in the sum, and beyond what doubles can hold when multiplied by 256."""
    rows = [(0, [1e7, -1e7, 3.0]), (1, [1e7, 1.0, 2.0]), (2, [-1e7, 5.0, 2.0]), (50, [8e6] * 3), (51, [8e6] * 3), (52, [-8e6] * 3), (100, [1e300, 1.0, -1e300]), (101, [1.7e308, 0.0, 0.0]), (102, [0.5, 0.25, -0.125]), (150, [0.5, 0.5, 0.5]), (53, [8e6, 8e6, 7.9e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in K.search_top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5, Scratch(spark, "t")).collect())
    exact = [(i, [256 * int(x) if abs(x) > 1e300 else x for x in v]) for i, v in rows]
    floor = lambda x: x if isinstance(x, int) else math.floor(256 * x)
    want = []
    for q, a in exact:
        if q % 50 == 0:
            scores = sorted((-sum(floor(x) * floor(y) for x, y in zip(a, b)), i) for i, b in exact if i != q)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert got == clamped(want)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=3, max_size=3), min_size=2, max_size=30), st.integers(1, 5))
def test_blocks_rank_any_floats_exactly(vectors, k):
    x = np.array(vectors)
    made = K._index(None, __import__("pandas").DataFrame({"v": list(x), "vec_id": np.arange(len(x))})).iloc[0]
    block = K._Block(int(made["dims"]), int(made["n"]), made["ids"], made["x"], made["slices"])
    whole = [[math.floor(256 * y) if math.isfinite(256 * y) else 256 * int(y) for y in v] for v in vectors]
    for own in range(min(3, len(x))):
        want = sorted((-sum(a * b for a, b in zip(whole[own], v)), i) for i, v in enumerate(whole) if i != own)[:k]
        assert [(-s, i) for s, i in block.best(own, K.quantised(x[own]), k)] == want


def test_keys_order_scores_beyond_a_long():
    scores = sorted([s * (1 << e) + d for s in (-1, 1) for e in (63, 64, 70, 200, 2000) for d in (-1, 0, 1)])
    keys = [K.beyond_key(s) for s in scores]
    assert keys == sorted(keys) and None not in keys and K.beyond_key(5) is None
