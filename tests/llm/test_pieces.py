import functools
import hashlib
import random
import time

import pytest
import sentencepiece
from helpers import LONG, TEXTS, awkward, empty

from siltlog.llm import piece_lattice as P
from siltlog.llm.queries import op6_sentencepiece, tokenizer_path
from siltlog.llm.shared import Scratch


@pytest.fixture(scope="module")
def model():
    path = tokenizer_path("piece_bpe_32k.model")
    return P.load_pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)


SAMPLES = ["Hello  world\n\tx  ", " a", "  ", "a　b\xa0c ﬁ", "<s>a</s><0x41>", "naïve café ☃ 日本語", "▁▁ x▁", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 3, "x" * 300, "The quick brown foxes' unbelievable internationalization", "\x00\x01"]


def test_encoding_equals_sentencepiece(spark, model):
    pieces, sp = model
    assert pieces.is_bpe and pieces.longest == 16
    texts = SAMPLES + [t for _, t in TEXTS if t and t != LONG] + [LONG[:3000]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = P.encode_texts(df, ["doc_id"], "text", pieces, Scratch(spark, "t"))
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got == {i: sp.encode(t) for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in P.decode_ids(out, ["doc_id"], "ids", pieces).collect()}
    assert back == {i: sp.decode(sp.encode(t)) for i, t in enumerate(texts)}


def test_awkward_rows(spark, model, monkeypatch):
    monkeypatch.setattr(P, "FREQUENT", 3)
    pieces, sp = model
    rows = P.encode_texts(awkward(spark), ["doc_id", "id"], "text", pieces, Scratch(spark, "t")).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == sorted((str(i), sp.encode(t or "")) for i, t in TEXTS)
    assert all(r["n_ids"] == len(r["ids"]) and r["id"] == 3 for r in rows)
    assert P.encode_texts(empty(spark), ["doc_id"], "text", pieces, Scratch(spark, "t")).count() == 0


def test_query_encodes_and_decodes_every_text(spark, sf_dir, model):
    _, sp = model
    read = lambda name, *keys: {(name, *(r[k] for k in keys)): sp.encode(r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*keys, "text").collect()}
    want = read("documents", "doc_id") | read("conversations", "conv_id", "turn")
    rows = op6_sentencepiece(spark, sf_dir).collect()
    got = {("documents", r["doc_id"]) if r["conv_id"] is None else ("conversations", r["conv_id"], r["turn"]): (r["n_ids"], r["ids"], r["decoded_sha256"]) for r in rows}
    assert len(rows) == len(want) and got == {k: (len(x), x, hashlib.sha256(sp.decode(x).encode()).hexdigest()) for k, x in want.items()}


def test_viterbi_against_every_path(spark):
    rng = random.Random(2)
    parts = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(40)} | {"a", "b"})
    pieces = P.Pieces(tuple((p, i + 1, -rng.random() * 5 - len(p) / 7) for i, p in enumerate(parts)), None, 0, False, dummy_prefix=False)
    score = {p: s for p, _, s in pieces.rows}
    ids = {p: i for p, i, _ in pieces.rows}

    @functools.lru_cache(None)
    def best(word):
        if not word:
            return 0.0, ()
        ways = []
        for n in range(1, min(len(word), pieces.longest) + 1):
            s = score.get(word[:n], -50.0 if n == 1 else None)
            if s is not None:
                rest = best(word[n:])
                ways.append((s + rest[0], (word[:n], *rest[1])))
        return max(ways)

    words = sorted({"".join(rng.choices("abcd", k=rng.randrange(1, 12))) for _ in range(80)})
    got = {r["word"]: r["ids"] for r in P.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces, -50.0).collect()}
    assert got == {w: [ids.get(p, 0) for p in best(w)[1]] for w in words}


def test_best_paths_of_the_bpe_model(spark, model):
    """The path that the query gives has the score it says, spells the text, and no path that merges find scores higher."""
    pieces, sp = model
    texts = ["The quick brown foxes' unbelievable internationalization", "naïve café ☃ 日本語 12,345.67", "x" * 40, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = {i: s for _, i, s in pieces.rows}
    worst = min(score.values()) - 10
    for r in P.encode_texts(df, ["doc_id"], "text", pieces, Scratch(spark, "t")).collect():
        text = texts[r["doc_id"]]
        assert sp.decode(r["best_ids"]) == text and r["ids"] == sp.encode(text)
        unknown = sum(1 for c in text if c != " " and not sp.piece_to_id(c) and c not in {p for p, _, _ in pieces.rows})
        assert r["best_score"] == sum(score.get(i, 0) for i in r["best_ids"]) + unknown * worst
        assert r["best_score"] >= sum(score.get(i, 0) for i in r["ids"]) + unknown * worst


def test_segments_are_what_no_piece_joins(model):
    pieces, _ = model
    cut = P.Cutter(pieces)
    for text in SAMPLES + [LONG[:2000]]:
        parts = cut(text)
        assert "".join(parts) == ("▁" + text.replace(" ", "▁") if text else "")
        whole = "".join(parts)
        at = 0
        for x in parts[:-1]:
            at += len(x)
            assert not any(whole[a : a + n] in {p for p, _, _ in pieces.rows if len(p) == n} for n in (2, 3, 4) for a in range(max(0, at - n + 1), at) if a + n > at)


def test_long_runs_of_letters(spark, model):
    """100,000 characters without a space, by the heap; and the heap and the running best equal the folds by aggregates."""
    pieces, sp = model
    rng = random.Random(3)
    runs = ["".join(rng.choices("etaoinshrdlu", k=100_000)), "a" * 100_000, "日本語" * 3000]
    df = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in P.encode_texts(df, ["doc_id"], "text", pieces, Scratch(spark, "t")).collect()}
    assert got == {i: sp.encode(t) for i, t in enumerate(runs)}
    words = sorted({"".join(rng.choices("etaoin☃é", k=rng.randrange(1, 30))) for _ in range(60)})
    by = P.LongFold(pieces, -50.0)
    rows = P.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces, -50.0).collect()
    assert {r["word"]: (r["ids"], r["best"], r["score"]) for r in rows} == {w: by(w) for w in words}


def test_texts_are_not_written_beside_their_shuffle(spark, model, monkeypatch):
    """Rare segments in copies of texts: no intermediate table holds a text."""
    monkeypatch.setattr(P, "FREQUENT", 3)
    pieces, sp = model
    texts = [f"word{i % 7} unheard{i % 7}of {i % 7} naïve☃{i % 7}日" for i in range(50)]
    plain = lambda frame: {r["doc_id"]: (r["best_ids"], r["best_score"]) for r in frame.collect()}
    kept = {}
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, *more: kept.setdefault(name, keep(self, df, name, *more)))
    out = P.encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"], "text", pieces, Scratch(spark, "t"))
    assert {r["doc_id"]: r["ids"] for r in out.collect()} == {i: sp.encode(t) for i, t in enumerate(texts)}
    long = P.LongFold(pieces, P.unknown_score(pieces))
    want = {t: [long(x) for x in P.Cutter(pieces)(t)] for t in set(texts)}
    assert plain(out) == {i: ([j for x in want[t] for j in x[1]], sum(x[2] for x in want[t])) for i, t in enumerate(texts)}
    assert kept["own"].count() == 7 and kept["met"].columns == ["doc_id", "ids", "best", "score", "_digest", "_row", "rare"]


def test_shuffle_files_go(spark):
    from siltlog.llm.shared import shuffles_removed

    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    run = lambda name: Scratch(spark, "t").keep(spark.range(1000).repartition(5, "id").groupBy("id").count(), name)
    before = files()
    with shuffles_removed(spark):
        run("a")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    run("b")
    assert not files() <= before


def test_compact_codes(model):
    pieces, _ = model
    few = P.Pieces((("a", 70_000, -0.1),), None, 3, False)
    for p, word, ids, best, score in [(pieces, "a", [5], [5], -3.0), (pieces, "\U0001f600" * 64, list(range(256)), list(range(1, 257)), -0.1), (few, "aé", [70_000, 3], [3], 1 / 3)]:
        packed = [P.np.array(x, "<i4").tobytes() for x in (ids, best)]
        c = P.Compact(p)
        assert c.unpack(c.pack(word, *packed, score)) == (word, (*packed, score))


def test_segments_are_cut_in_arrays(model):
    """The segments that arrays of code points give are the cutter's, text by text, whole or in stretches."""
    pieces, _ = model
    texts = [None, "", *SAMPLES, *(t for _, t in TEXTS), "x  ", "  y", "\U0001f600▁ ▁é", ""]
    cut, spans = P.Cutter(pieces), P.Spans(pieces)
    for most in (1, 50, 1 << 20):
        got = []
        for a, b in P.stretches(P.np.array([len(t or "") for t in texts]), most):
            words, at, ends = spans(texts[a:b])
            flat = words.take(P.pa.array(at)).to_pylist()
            got += [flat[x:y] for x, y in zip(ends[:-1], ends[1:])]
        assert got == [cut(t) for t in texts]


def test_only_rare_segments_are_asked_for(spark, model, monkeypatch):
    """Frequent segments come from a sample, whatever it holds: all texts, so that none is asked for, or none."""
    pieces, sp = model
    texts = [f"word{i % 7} unheard{i % 7}of {i % 7} naïve☃{i % 7}日" for i in range(50)]
    kept, keep = {}, Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, *more: kept.setdefault(name, keep(self, df, name, *more)))
    for sampled, own in ((1, 0), (1 << 62, 7)):
        kept.clear()
        monkeypatch.setattr(P, "SAMPLED", sampled)
        out = P.encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"], "text", pieces, Scratch(spark, "t"))
        assert {r["doc_id"]: r["ids"] for r in out.collect()} == {i: sp.encode(t) for i, t in enumerate(texts)}
        assert kept["own"].count() == own


def test_decoding_skips_ids_without_a_piece(spark, model):
    pieces, sp = model
    ids = sp.encode(" naïve ☃ x")
    rows = [(1, [-1, *ids, 10**6, 0]), (2, None), (3, []), (4, [None, *ids])]
    got = {r["doc_id"]: r["text"] for r in P.decode_ids(spark.createDataFrame(rows, "doc_id long, ids array<int>"), ["doc_id"], "ids", pieces).collect()}
    assert got == {1: " naïve ☃ x", 2: "", 3: "", 4: " naïve ☃ x"}
