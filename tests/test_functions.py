from pyspark.sql import functions as F

from siltlog.errors import ConfigError
from siltlog.functions import keys
from siltlog.operators import accounting as acc
from siltlog.operators.compact import merge_candidates
from siltlog.operators.schema import ColumnFamily, Registry, parse_column, parse_volume
from siltlog.operators.scope import Scope, delete_bounds, is_empty_range
from siltlog.operators.reports import Document, human_bytes, percent, plural

import pytest


def one(spark, column):
    v = spark.range(1).select(column.alias("x")).first()["x"]
    return bytes(v) if isinstance(v, bytearray) else v


def test_binary_functions(spark):
    lit = lambda b: F.lit(b)
    assert one(spark, keys.be(F.lit(258), 4)) == b"\0\0\1\2"
    assert one(spark, keys.pad_or_cut(lit(b"abcdef"), 3)) == b"abc"
    assert one(spark, keys.pad_or_cut(lit(b"a"), 3)) == b"a\0\0"
    assert one(spark, keys.clamped(lit(b"hello"), 1, 3)) == b"ell"
    assert one(spark, keys.clamped(lit(b"hello"), 9, 3)) == b""
    assert int(one(spark, keys.purge_mark(lit(b"\xff" * 8), 0))) == 2**64 - 1
    assert int(one(spark, keys.purge_mark(lit(b"\xff" * 7), 0))) == 0
    assert int(one(spark, keys.purge_mark(lit(b""), 0))) == 0
    assert int(one(spark, keys.shard_of(lit(b"\1"), 2))) == 256
    assert one(spark, keys.record_span(lit(b"k" * 8), F.lit(4096))) == 4106
    assert one(spark, keys.record_span(lit(b"k" * 8), F.lit(4097))) == 4097 + 29
    assert one(spark, keys.dead_fraction(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, keys.droppable(F.lit(5), F.lit(3), F.lit(None).cast("long"))) == 5
    assert one(spark, keys.droppable(F.lit(5), F.lit(3), F.lit(3))) == 0


def test_successor():
    assert keys.successor(b"a\xff") == b"b"
    assert keys.successor(b"\xff\xff") is None
    assert keys.successor(b"ab") == b"ac"


def test_scope_agrees_with_columns(spark):
    scopes = [Scope(), Scope.prefix(b"b"), Scope.prefix(b""), Scope.prefix(b"\xff"), Scope.range(b"a", b"c"), Scope.from_key(b"b"), Scope.from_key(b"b", False), Scope.after(b"b")]
    samples = [b"", b"a", b"b", b"b\0", b"bz", b"c", b"\x7f", b"\x80", b"\xff", b"\xff\x01"]
    df = spark.createDataFrame([(bytearray(s),) for s in samples], "k binary")
    for s in scopes:
        inside = {bytes(r[0]) for r in df.where(s(F.col("k"))).collect()}
        assert inside == {k for k in samples if s.locate(k) == "inside"}
        assert {(bytes(r[0]), r[1]) for r in df.select("k", s.locate_column(F.col("k"))).collect()} == {(k, s.locate(k)) for k in samples}


def test_bounds():
    assert delete_bounds(b"a", b"bcd", 2) == (b"a\0", b"bc")
    assert delete_bounds(b"a", None, 2) == (b"a\0", None)
    assert delete_bounds(b"a", b"bcd", None) == (b"a", b"bcd")
    assert is_empty_range(b"b", b"b") and is_empty_range(b"b", b"a") and not is_empty_range(b"b", None)


def test_declarations():
    assert parse_column("a:3:8") == ColumnFamily("a", 3, 8)
    assert parse_column("a:3") == ColumnFamily("a", 3)
    for bad in ("a", ":1", "a:x", "a:1:y", "a:300", "a:1:7", "a:1:2:3"):
        with pytest.raises(ConfigError):
            parse_column(bad)
    assert parse_volume("/x:fast:dead").dead and parse_volume("/x").kind == "capacity"
    with pytest.raises(ConfigError):
        parse_volume("/x:slow")
    with pytest.raises(ConfigError):
        Registry([ColumnFamily("a", 1), ColumnFamily("b", 1)])


def test_policies():
    assert acc.pressure_tier(0.2, False) == "escalated"
    assert acc.pressure_tier(0.16, True) == "escalated"
    assert acc.pressure_tier(0.16, False) == "relaxed"
    assert acc.pressure_tier(0.1, True, True) == "deferred"
    assert acc.effective_ratio(0.5, "escalated") == 0.2
    assert acc.foreground_throttle(0, 1000, 10) == 1.0
    assert acc.foreground_throttle(990, 1000, 10) == 0.05
    assert abs(acc.foreground_throttle(950, 1000, 10) - 0.525) < 1e-9
    assert acc.draw_volume([5, 50, 9], ["fast"] * 3, [False, True, False], "fast", 6) == 2
    assert acc.draw_volume([5, 50, 9], ["fast"] * 3, [False] * 3, "fast", 6, pinned=2) == 2
    assert acc.output_kind("fast", True, 10, 10, 100) == "capacity"
    assert acc.move_ratio(0, 0) == 0.0
    assert merge_candidates([(1, 10), (2, 15), (3, 100)], 9) == [1, 2]
    assert merge_candidates([(1, 10), (2, 15)], 8) == []


def test_documents():
    d = Document("T", {"a": 1}, {"rows": [{"x": 1, "y": "b"}]}, [("odd", "fix it")])
    assert '"a": 1' in d.to_json() and "| x | y |" in d.to_markdown() and "note: odd; fix it" in d.to_text()
    assert (human_bytes(10), human_bytes(2048), percent(0.125), plural(1, "run"), plural(2, "run")) == ("10 B", "2.0 KiB", "12.5%", "1 run", "2 runs")
