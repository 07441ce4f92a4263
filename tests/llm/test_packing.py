import zlib

import numpy as np
import pytest
from helpers import TEXTS, awkward, empty
from tokenizers import Tokenizer

from siltlog.llm import packing as P
from siltlog.llm.queries import tokenizer_path
from siltlog.llm.shared import Scratch


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


ODD = ["It's DON'T we'll 12 3½ ªb µ ×÷ naïve É", "ΣΑΣ test", "İstanbul", "x<|endoftext|>y", "日本語", "a\x00b", "ẞ ß", "e\u0301x", "", "\x85a\xa0b", "'S 'RE '", "!\x1c!", "a\x0bb", "\x01\x7f!\x9f", "³²¹a", "ǅ ŉ"]


def test_encoder_equals_the_tokenizer(tokenizer):
    encoder = P.TextEncoder(tokenizer_path())
    assert encoder.by_word
    for text, got in zip(ODD, encoder.encode(ODD)):
        assert np.frombuffer(got, encoder.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    other = P.TextEncoder(tokenizer_path("byte_bpe_50k.json"))
    assert not other.by_word
    full = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert [np.frombuffer(x, other.kind).tolist() for x in other.encode(ODD)] == [full.encode(t, add_special_tokens=False).ids for t in ODD]


def test_hilbert_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = P.hilbert_key(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def whole(rows, texts, tokenizer, size):
    """Checks pieces against the texts they are of (a list, as ids may repeat)."""
    want = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for t in texts)
    got, parts = [], {}
    for r in rows:
        ids = np.frombuffer(r["ids"], f"<u{r['width']}")
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"] and len(ids) == r["length"] > 0
        parts.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    # pieces lie end to end along the curve, so documents follow from their order
    pending = []
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        pending += np.frombuffer(r["ids"], f"<u{r['width']}").tolist()
        if r["start"] + r["length"] == r["doc_tokens"]:
            assert len(pending) == r["doc_tokens"]
            got.append(tuple(pending))
            pending = []
    assert not pending and sorted(got) == want
    for s, own in parts.items():
        own.sort()
        assert all(o == sum(n for _, n in own[:i]) for i, (o, _) in enumerate(own))
        assert s == max(parts) or sum(n for _, n in own) == size
    assert sorted(parts) == list(range(len(parts)))


def test_awkward_rows(spark, tokenizer):
    for size in (16, 4096):
        out = P.pack(awkward(spark), "doc_id", "text", tokenizer_path(), Scratch(spark, "t"), size)
        rows = out.collect()
        whole(rows, [t for _, t in TEXTS], tokenizer, size)
    made = P.sequences(out, size).collect()
    for r in made:
        n = r["n_tokens"]
        assert len(r["tokens"]) == (size if n & (n - 1) else n)
    assert P.pack(empty(spark), "doc_id", "text", tokenizer_path(), Scratch(spark, "t")).count() == 0


def test_copies_over_several_ranges(spark, tokenizer, monkeypatch):
    """A group of equal documents is dealt over ranges, and sequences go on from range to range."""
    texts = ["one and the same text of some words"] * 60 + [f"another text, {i} of many" for i in range(60)] + [None]
    rows = spark.createDataFrame([(i % 100, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(P, "RANGE_BYTES", 500)
    scratch = Scratch(spark, "t")
    out = P.pack(rows, "doc_id", "text", tokenizer_path(), scratch, 64).collect()
    assert spark.read.parquet(f"{scratch.root}/curve").select("range").distinct().count() > 3
    whole(out, texts, tokenizer, 64)


def test_neighbours_share_words(spark):
    """Documents of one vocabulary lie closer on the curve than those of two."""
    a, b = "alpha beta gamma delta " * 30, "uno dos tres cuatro " * 30
    df = spark.createDataFrame([(i, (a if i % 2 else b) + str(i)) for i in range(40)], "doc_id long, text string")
    rows = sorted(P.pack(df, "doc_id", "text", tokenizer_path(), Scratch(spark, "t"), 64).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    order = list(dict.fromkeys(r["doc_id"] % 2 for r in rows)), [r["doc_id"] % 2 for r in rows if r["start"] == 0]
    assert sum(x != y for x, y in zip(order[1], order[1][1:])) <= 4
