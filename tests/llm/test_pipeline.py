import __spark_entry__ as entry
import corpus_pipeline as cp
from compare import duck_rows, rows_of
from siltlog.llm.queries import oracle_sql, queries
from siltlog.llm.secrets_scan import base_spans, confirmed_spans
from siltlog.llm.shared import table

from helpers import awkward
from pyspark.sql.functions import length, lit
from test_jaccard import brute

import pytest


def test_registered():
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and [n for n, _ in cp.STAGES] == ["language ID", "n-gram Jaccard join", "secret scans", "packing"]
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    assert rows_of(queries()[name](spark, sf_dir)) == duck_rows(sf_dir, oracle_sql()[name])


def test_each_stage_on_what_the_last_kept(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    one = cp.language_id(spark, docs, sf_dir).cache()
    assert one.schema == docs.schema and 0.97 * docs.count() <= one.count() <= docs.count()
    two = cp.near_duplicates(spark, one, sf_dir).cache()
    assert two.schema == docs.schema
    want = sorted(i for i, _, c in brute([(r["doc_id"], r["text"]) for r in one.collect()]) if i == c)
    assert sorted(r["doc_id"] for r in two.collect()) == want
    three = cp.secrets(spark, two, sf_dir).cache()
    assert three.schema == docs.schema and three.count() == two.count()
    before = {r["doc_id"]: r["text"] for r in two.collect()}
    for r in three.collect():
        t = before[r["doc_id"]]
        assert r["n_chars"] == len(r["text"]) and not confirmed_spans(r["text"])
        assert (r["text"] == t) == (not base_spans(t) + confirmed_spans(t))
    rows = cp.packing(spark, three, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(want)
    ran = cp.run(spark, sf_dir)
    assert sorted(map(repr, ran.collect())) == sorted(map(repr, rows))


def test_secrets_and_pieces_against_brute_force(spark, sf_dir):
    """Redaction by marking characters; pieces by cutting what the tokenizer itself gives."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from siltlog.llm.queries import tokenizer_path

    docs = table(spark, sf_dir, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    cleaned = {r["doc_id"]: r["text"] for r in cp.secrets(spark, docs, sf_dir).collect()}

    def marked(t):
        runs = []
        for a, b, _ in sorted(base_spans(t) + confirmed_spans(t)):
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        for a, b in reversed(runs):
            t = t[:a] + "[SECRET]" + t[b:]
        return t

    assert cleaned == {i: None if t is None else marked(t) for i, t in text.items()}
    tokenizer, seen = Tokenizer.from_file(tokenizer_path()), {}
    for r in cp.packing(spark, docs, sf_dir).collect():
        ids = seen.setdefault(r["doc_id"], (tokenizer.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids + [2], []))
        assert r["doc_tokens"] == len(ids[0]) and r["ids_crc32"] == zlib.crc32(np.array(ids[0][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        ids[1].append((r["start"], r["length"]))
    assert set(seen) == set(text)
    for ids, parts in seen.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) == len(ids)


def test_awkward_rows(spark, tmp_path):
    """Nulls, repeated rows, long texts and columns whose names the stages use themselves."""
    awkward(spark).withColumn("source", lit("s")).withColumn("n_chars", length("text")).write.parquet(str(tmp_path / "documents.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    for _, stage in cp.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == table(spark, str(tmp_path), "documents").columns
    kept = {r["doc_id"] for r in docs.collect()}
    assert {0, 6, 7} <= kept and not {1, 2, 3, 4} & kept and None in kept
    assert {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()} == kept


def test_an_empty_table(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
