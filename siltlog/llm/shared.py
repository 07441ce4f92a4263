"""What the operators of this subpackage share: scratch tables, bounded broadcasts, table reads."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import math
import shutil
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id lists up to this many rows may be broadcast (16 bytes a row); longer ones are shuffled.
BROADCAST_ROWS = 500_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; one of our own only where none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        own = tempfile.mkdtemp(prefix="siltlog-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold few rows and bytes, so that workers' memory doesn't follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def _release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its own counsel
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(each):
    """each, a function over Arrow batches, giving a worker's free memory back when a task ends: workers outlive tasks and share an executor."""

    @functools.wraps(each)
    def run(batches):
        try:
            yield from each(batches)
        finally:
            _release()

    return run


class Memo(dict):
    """What ``make`` gives for a key. Up to ``most`` keys that were asked for twice are kept for good, besides the last ones that were asked for once."""

    def __init__(self, make, most: int):
        self.make, self.most, self.once = make, most, {}

    def __missing__(self, key):
        found = self.once.pop(key, None)
        if found is not None and len(self) < self.most:
            self[key] = found
            return found
        if found is None:
            found = self.make(key)
            if len(self.once) >= self.most // 2:
                self.once.clear()
        self.once[key] = found
        return found


class Scratch:
    """Intermediate tables written below the shared folder, so that lineage ends there and a lost executor costs no more than its own tasks."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        bounded_batches(spark)
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """The files of shuffles go as soon as the statement that made them ends, instead of when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df, a materialised table, has at most so many rows."""
    return df.count() <= rows


def _id_bitmap(ids: DataFrame, on: str) -> tuple[np.ndarray, int]:
    """A bitmap of 16 bits an id, 2**27 at most (16 MB), by the highest bits of the ids' hashes; and how many bits of a hash it takes."""
    bits = min(27, max(10, math.ceil(math.log2(16 * max(1, ids.count())))))

    def mark(batches):
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(seen, bitorder="little").tobytes(), 1)], pa.binary())], names=["bits"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for (data,) in ids.select(F.xxhash64(on)).mapInArrow(tidy(mark), "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(data), np.uint8)
    return out, bits


def keep_ids(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Semi- or anti-join with a materialised list of ids: broadcast if its counted size is bounded.

    Else only those rows of df are shuffled that a broadcast bitmap of the ids' hashes can't rule out: the rows that are listed, and
    some sixteenth of the others, as long as the bitmap has room; beyond, more of them, with the same result.
    """
    if small(ids):
        return df.join(F.broadcast(ids), on, how)
    found, bits = _id_bitmap(ids, on)
    seen, names = df.sparkSession.sparkContext.broadcast(found), df.columns

    def sifted(listed: bool) -> DataFrame:
        def sift(batches):
            for batch in batches:
                at = batch.column(len(names)).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
                hit = (seen.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit == listed)) for c in batch.columns[:-1]], names=names)

        return df.withColumn("_hash_of_id", F.xxhash64(on)).mapInArrow(tidy(sift), df.schema)

    met = sifted(True).join(ids.hint("shuffle_hash"), on, how).select(names)
    return met if how == "left_semi" else met.unionAll(sifted(False))
