"""Reads of a live view V (cf, k, lsn, v, len, segment_id), each a plan over it.

Ordered results carry no rank; callers that hash results without order add one. Scans of keys don't select ``v``, so that
Parquet doesn't read payloads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import clamped
from .scope import Scope


def family(view: DataFrame, cf: str) -> DataFrame:
    return view.where(F.col("cf") == cf)


def get(view: DataFrame, cf: str, key: bytes) -> DataFrame:
    """k, lsn, v and len of one key: a row or none."""
    return family(view, cf).where(F.col("k") == F.lit(key)).select("k", "lsn", "v", "len")


def key_list(spark: SparkSession, keys: Sequence[bytes]) -> DataFrame:
    return spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(keys)], "pos long, k binary")


def get_many(view: DataFrame, cf: str, keys: DataFrame) -> DataFrame:
    """A row for each of keys (pos, k), in any number and with repeats: v, len and lsn are null for a miss. Order by pos.

    Distinct keys are looked up once: a repeated key doesn't repeat the work on the view's side. For few keys of a large log, take the
    view of ``narrowed`` rows, so that only their versions are resolved.
    """
    found = family(view, cf).join(keys.select("k").distinct(), "k", "left_semi").select("k", "lsn", "v", "len")
    return keys.join(found, "k", "left").select("pos", "k", "lsn", "v", "len")


def get_range(view: DataFrame, cf: str, key: bytes, offset: int, length: int) -> DataFrame:
    """``length`` bytes of a value from ``offset``, as far as there are any."""
    return get(view, cf, key).select("k", clamped(F.col("v"), offset, length).alias("v"))


def contains(view: DataFrame, cf: str, keys: DataFrame) -> DataFrame:
    """pos, k and present for each of keys (pos, k)."""
    live = family(view, cf).select("k").withColumn("present", F.lit(True))
    return keys.join(live, "k", "left").select("pos", "k", F.coalesce("present", F.lit(False)).alias("present"))


def size_of(view: DataFrame, cf: str, key: bytes) -> DataFrame:
    return family(view, cf).where(F.col("k") == F.lit(key)).select("k", "len")


def scan(view: DataFrame, cf: str, scope: Scope = Scope(), ascending: bool = True, columns: Sequence[str] = ("k", "v")) -> DataFrame:
    """Rows within a scope, in key order."""
    order = F.col("k").asc() if ascending else F.col("k").desc()
    return family(view, cf).where(scope(F.col("k"))).select(*columns).orderBy(order)


def iter_all(view: DataFrame, cf: str) -> DataFrame:
    return scan(view, cf)


def iter_prefix(view: DataFrame, cf: str, prefix: bytes) -> DataFrame:
    return scan(view, cf, Scope.prefix(prefix))


def iter_range(view: DataFrame, cf: str, start: bytes, end: bytes) -> DataFrame:
    return scan(view, cf, Scope.range(start, end))


def iter_from(view: DataFrame, cf: str, start: bytes, ascending: bool = True) -> DataFrame:
    return scan(view, cf, Scope.from_key(start, ascending), ascending)


def iter_keys_prefix(view: DataFrame, cf: str, prefix: bytes) -> DataFrame:
    return scan(view, cf, Scope.prefix(prefix), columns=("k",))


def iter_keys_from(view: DataFrame, cf: str, start: bytes | None = None, ascending: bool = True) -> DataFrame:
    return scan(view, cf, Scope() if start is None else Scope.from_key(start, ascending), ascending, ("k",))


def walk(view: DataFrame, cf: str, start: bytes, take: Callable[[bytes, bytes], bool], ascending: bool = True, hint: int | None = None) -> int:
    """Call take(key, value) in order until it returns False; with a hint, so many rows are fetched first. Returns the number of calls."""
    rows, calls = iter_from(view, cf, start, ascending), 0

    def fetch(df: DataFrame) -> Iterator:
        return df.toLocalIterator(prefetchPartitions=False)

    last = None
    if hint:
        for row in fetch(rows.limit(hint)):
            calls, last = calls + 1, bytes(row["k"])
            if not take(last, bytes(row["v"])):
                return calls
        if calls < hint:
            return calls
        rows = rows.where(F.col("k") > F.lit(last) if ascending else F.col("k") < F.lit(last))
    for row in fetch(rows):
        calls += 1
        if not take(bytes(row["k"]), bytes(row["v"])):
            break
    return calls


def page(view: DataFrame, cf: str, limit: int, after: bytes | None = None, scope: Scope = Scope(), ascending: bool = True, columns: Sequence[str] = ("k",)) -> DataFrame:
    """The next ``limit`` rows beyond a key, exclusive: TakeOrderedAndProject, no full sort."""
    rows = family(view, cf).where(scope(F.col("k")))
    if after is not None:
        rows = rows.where(F.col("k") > F.lit(after) if ascending else F.col("k") < F.lit(after))
    return rows.select(*columns).orderBy(F.col("k").asc() if ascending else F.col("k").desc()).limit(limit)


class Sweep:
    """Resumable paging. A mark is the nonce of an opening and the last key returned; a mark of another opening starts over."""

    def __init__(self, nonce: bytes):
        if len(nonce) != 8:
            raise ValueError("a nonce has 8 bytes")
        self.nonce = nonce

    def last_key(self, mark: bytes | None) -> bytes | None:
        return mark[8:] if mark and mark[:8] == self.nonce else None

    def next(self, view: DataFrame, cf: str, limit: int, mark: bytes | None = None, prefix: bytes = b"", keys_only: bool = False) -> tuple[list, bytes | None]:
        """(rows, mark): a page exactly ``limit`` long always has a mark, a shorter one none; a limit of 0 gives the mark back."""
        if limit == 0:
            return [], mark
        rows = page(view, cf, limit, self.last_key(mark), Scope.prefix(prefix), columns=("k",) if keys_only else ("k", "v")).collect()
        return rows, self.nonce + bytes(rows[-1]["k"]) if len(rows) == limit else None


def nth_page(view: DataFrame, cf: str, limit: int, n: int, scope: Scope = Scope(), columns: Sequence[str] = ("k",)) -> DataFrame:
    """Page n (from 0) with the position of each row: the first (n + 1) * limit rows are taken, then the last of them."""
    taken = page(view, cf, limit * (n + 1), scope=scope, columns=columns)
    at = F.row_number().over(Window.orderBy("k"))
    return taken.withColumn("pos", at).where(F.col("pos") > limit * n)


def count_prefix(view: DataFrame, cf: str, prefix: bytes = b"") -> DataFrame:
    return family(view, cf).where(Scope.prefix(prefix)(F.col("k"))).agg(F.count("*").alias("n"))


def bytes_prefix(view: DataFrame, cf: str, prefix: bytes = b"") -> DataFrame:
    """The stored bytes under a prefix; 0, not null, if there are none."""
    return family(view, cf).where(Scope.prefix(prefix)(F.col("k"))).agg(F.coalesce(F.sum("len"), F.lit(0)).alias("bytes"))


def totals(view: DataFrame) -> DataFrame:
    return view.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("bytes"))


def column_totals(view: DataFrame) -> DataFrame:
    return view.groupBy("cf").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


def prefix_totals(view: DataFrame, cf: str, shard_bytes: int) -> DataFrame:
    """Totals by the leading bytes of keys that are wide enough to have them."""
    wide = family(view, cf).where(F.octet_length("k") >= shard_bytes)
    return wide.groupBy(F.substring("k", 1, shard_bytes).alias("prefix")).agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


def cf_disk_usage(view: DataFrame, registry) -> DataFrame:
    """A row for each declared family, also for empty ones."""
    spark = view.sparkSession
    declared = spark.createDataFrame([(f.name, f.id) for f in registry.families], "cf string, id short")
    held = column_totals(view)
    return declared.join(held, "cf", "left").select("cf", "id", F.lit(0).cast("long").alias("sst_bytes"), F.coalesce("bytes", F.lit(0)).alias("blob_bytes"), F.lit("bulk").alias("volume"))
