"""Values of families that declare a codec: packed when written, opened when read, moved as they are by rewrites.

A packed value is its length before packing, in four bytes (little-endian), and an lz4 block. It is kept only where that saves an eighth
of the value; else the value is stored as it is, with codec 0. ``len`` and ``crc`` are of what is stored.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CorruptionError
from ..operators.schema import DATA, Registry

PLAIN, LZ4 = 0, 1
# Values below LEAST bytes aren't packed; no value is longer than MOST.
LEAST, MOST = 256, 1 << 30


def pack(value: bytes) -> tuple[bytes, int]:
    """What is stored for a value, and its codec."""
    if not LEAST <= len(value) <= MOST:
        return value, PLAIN
    packed = len(value).to_bytes(4, "little") + pa.compress(value, codec="lz4_raw", asbytes=True)
    return (packed, LZ4) if len(packed) <= len(value) - len(value) // 8 else (value, PLAIN)


def unpack(stored: bytes) -> bytes:
    size = int.from_bytes(stored[:4], "little")
    if len(stored) < 4 or size > MOST:
        raise CorruptionError(f"a packed value says that it has {size} bytes")
    return pa.decompress(stored[4:], size, codec="lz4_raw", asbytes=True)


def coded(registry: Registry) -> list[str]:
    return [f.name for f in registry.families if f.codec == "lz4"]


@F.pandas_udf(T.StructType([T.StructField("v", T.BinaryType()), T.StructField("codec", T.ByteType())]))
def _packed(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, PLAIN) if v is None else pack(v) for v in values], columns=["v", "codec"])


@F.pandas_udf(T.BinaryType())
def _unpacked(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else unpack(v) for v in values], dtype=object)


def with_packed(rows: DataFrame, registry: Registry) -> DataFrame:
    """rows (cf, kind, v, ...) with the values of coded families packed, and their codec; others don't leave the JVM."""
    names = coded(registry)
    if not names:
        return rows
    mine = F.col("cf").isin(names) & (F.col("kind") == DATA) & (F.octet_length("v") >= LEAST)
    made = rows.withColumn("_made", _packed(F.when(mine, F.col("v"))))
    return made.withColumns({"v": F.when(mine, F.col("_made.v")).otherwise(F.col("v")), "codec": F.when(mine, F.col("_made.codec")).otherwise(F.lit(PLAIN)).cast("byte")}).drop("_made")


def opened(v: str = "v", codec: str = "codec") -> Column:
    """The value as it was written."""
    is_packed = F.col(codec) == LZ4
    return F.when(is_packed, _unpacked(F.when(is_packed, F.col(v)))).otherwise(F.col(v))
