import itertools
import random

import numpy as np
import pytest
from helpers import TEXTS, awkward, empty

from siltlog.llm import jaccard_join as J
from siltlog.llm.components import connected_components
from siltlog.llm.shared import Memo, Scratch


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(x, y):
    return bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)


def brute(rows):
    """(n_shingles, component) of each row; rows with one id are one document."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, x), (j, y) in itertools.combinations(sets, 2):
        if i is not None and j is not None and linked(x, y):
            a, b = sorted((find(i), find(j)))
            up[b] = a
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def got(df, spark):
    return sorted((tuple(r) for r in J.jaccard_components(df, "doc_id", "text", Scratch(spark, "t")).collect()), key=repr)


def near_copies(seed, n=160):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(200)}" for _ in range(60)]
    passage = " ".join(f"p{i}" for i in range(25))
    rows = []
    for i in range(n):
        w = list(base) if i % 3 else [f"w{rng.randrange(200)}" for _ in range(rng.randrange(1, 70))]
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w) + (" " + passage if i % 5 == 0 else "")))
    return rows + [(n, None), (n + 1, ""), (n + 2, "A b"), (n + 3, "a B"), (n + 4, "a b c"), (0, rows[0][1])]


@pytest.mark.parametrize("frequent,few,firsts", [(2, 8, 8), (256, 8, 8), (256, 0, 1), (2, 2, 3)])
def test_against_brute_force(spark, monkeypatch, frequent, few, firsts):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "FEW", few)
    monkeypatch.setattr(J, "FIRSTS", firsts)
    rows = near_copies(frequent)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), spark) == brute(rows)


def test_without_quick_links_nothing_is_lost(spark, monkeypatch):
    """The prefixes alone find every link."""
    monkeypatch.setattr(J, "_quick_pairs", lambda classes: classes.select(J.F.col("node").alias("a"), J.F.col("node").alias("b")).limit(0))
    rows = near_copies(9, 90)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), spark) == brute(rows)


def test_shuffled_joins(spark, monkeypatch):
    from siltlog.llm import shared

    for module in (J, shared):
        monkeypatch.setattr(module, "small", lambda df, rows=0: False)
    rows = near_copies(4, 60)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), spark) == brute(rows)


def test_awkward_rows(spark):
    rows = [(i, t) for i, t in TEXTS]
    assert got(awkward(spark), spark) == brute(rows)
    assert got(empty(spark), spark) == []


def test_linked_sets_share_a_signature():
    rng, checked = np.random.default_rng(2), 0
    for _ in range(1500):
        n = int(rng.integers(1, 150))
        universe = rng.integers(0, 2**63, 320).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 320).astype(np.uint64)
        x = np.unique(rng.choice(universe, n, replace=False))
        y = np.unique(np.concatenate([rng.permutation(x)[int(rng.integers(0, n // 5 + 1)) :], rng.choice(universe, int(rng.integers(0, n // 5 + 1)))]))
        both = len(np.intersect1d(x, y))
        if not both or 100 * both < 75 * (len(x) + len(y) - both):
            continue
        checked += 1
        levels = ((rng.random(1 << 16) < rng.choice([0.05, 0.5, 0.95, 1.0])) * rng.integers(18, 30, 1 << 16)).astype(np.uint8)
        assert len(np.intersect1d(J.signatures(x, levels, 17), J.signatures(y, levels, 17)))
        for w in (J.BITMAP, J.WIDE):
            differ = int(np.bitwise_count(J.parity_bitmap(x, w) ^ J.parity_bitmap(y, w)).sum())
            assert both <= (len(x) + len(y) - differ) / 2
    assert checked > 500


def test_keeping_one(spark):
    rows = near_copies(5, 60) + [(None, "some text without an id"), (None, "some text without an id")]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, component_id string")
    kept = J.keep_one(df, "doc_id", "text", Scratch(spark, "t"))
    assert kept.schema == df.schema
    ids = [r["doc_id"] for r in kept.collect()]
    want = {i for i, _, c in brute(rows) if i is not None and i == c}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (302, 301)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[302] == 300 and 200 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").count() == 0


def test_memo_keeps_what_was_asked_for_twice():
    made = []
    memo = Memo(lambda k: made.append(k) or k * 2, 2)
    assert [memo[x] for x in (1, 1, 2, 3, 3, 4, 1, 3, 5, 5, 6, 5)] == [2, 2, 4, 6, 6, 8, 2, 6, 10, 10, 12, 10]
    assert made == [1, 2, 3, 4, 5, 6, 5] and set(memo) == {1, 3} and len(memo.once) <= 1
